"""Chat formatting by schema fingerprints (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
TURN = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths, arrays marked by []; types don't matter."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at + "[]")
    return [at]


def _digest(paths: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(paths), "\n").cast("binary"), 256)


def fingerprint(paths: list[str]) -> str:
    import hashlib

    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _turn(role, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), text.alias("text"))


def _some(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


#: layout -> (required field paths, turns of an accessor of paths). Mappings are data: another layout is another entry.
LAYOUTS: dict[str, tuple[list[str], str]] = {
    "prompt_response": (["prompt", "response"], "pair:prompt,response"),
    "prompt_completion": (["completion", "prompt"], "pair:prompt,completion"),
    "question_answer": (["answer", "question"], "pair:question,answer"),
    "system_prompt_response": (["prompt", "response", "system"], "system:system,prompt,response"),
    "instruction_output": (["instruction", "output"], "pair:instruction,output"),
    "instruction_input_output": (["input", "instruction", "output"], "input:instruction,input,output"),
    "messages_role_content": (["messages[].content", "messages[].role"], "list:messages,role,content"),
    "messages_role_text": (["messages[].role", "messages[].text"], "list:messages,role,text"),
    "conversations_from_value": (["conversations[].from", "conversations[].value"], "list:conversations,from,value"),
    "turn_rows": (["role", "text", "turn"], "rows:turn,role,text"),
}
FINGERPRINTS = {fingerprint(paths): (name, rule) for name, (paths, rule) in LAYOUTS.items()}
#: The layout of most required paths goes first; of equal ones, the first listed.
BY_SIZE = sorted(LAYOUTS, key=lambda name: -len(LAYOUTS[name][0]))


def layout_of(paths: list[str]) -> tuple[str, str] | None:
    """(layout, rule) by the fingerprint of the paths, or of the most required ones among them; None if unknown."""
    exact = FINGERPRINTS.get(fingerprint(paths))
    return exact or next(((name, LAYOUTS[name][1]) for name in BY_SIZE if set(LAYOUTS[name][0]) <= set(paths)), None)


def canonical_role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(role))), role, F.lit(""))


def _apply(rule: str, value: Column, repeated) -> Column:
    """Turns by a declarative rule; value(name) is a string field, repeated(name, role, text) a list of turns."""
    kind, _, names = rule.partition(":")
    n = names.split(",")
    if kind == "list":
        return repeated(*n)
    if kind == "pair":
        return F.array(_turn("user", value(n[0])), _turn("assistant", value(n[1])))
    if kind == "system":
        body = F.array(_turn("user", value(n[1])), _turn("assistant", value(n[2])))
        return F.when(_some(value(n[0])), F.concat(F.array(_turn("system", value(n[0]))), body)).otherwise(body)
    asked = F.when(_some(value(n[1])), F.concat(F.coalesce(value(n[0]), F.lit("")), F.lit("\n\n"), value(n[1]))).otherwise(value(n[0]))
    return F.array(_turn("user", asked), _turn("assistant", value(n[2])))


def turns_of_table(df: DataFrame) -> Column:
    """The ``turns`` column for a table whose columns hold one of the known layouts, a row a conversation."""
    name_rule = layout_of(field_paths(df.schema))
    if name_rule is None or name_rule[1].startswith("rows:"):
        raise ValueError(f"no mapping for the layout {field_paths(df.schema)}")
    return _apply(name_rule[1], lambda n: F.col(n).cast("string"), lambda n, r, t: F.transform(n, lambda x: _turn(canonical_role(x[r]), x[t])))


def turns_of_json(json: Column) -> tuple[Column, Column, Column]:
    """(fingerprint, layout, turns) of rows of JSON text, each with a layout of its own.

    The fingerprint hashes the field paths of the row. A layout needs its required paths only: other
    fields, nested ones too, change nothing, and an empty list of turns has no turns. An unknown
    layout has null turns; text that is no JSON object has the fingerprint of no paths.
    """
    v = F.try_parse_json(json)
    shape = F.schema_of_variant(v)
    # OBJECT<a: STRING, b: ARRAY<OBJECT<c: ...>>>: one level of lists of objects is what layouts use
    flat = F.regexp_replace(shape, r"ARRAY<OBJECT<([^<>]*)>>", "[$1]")
    inner = F.regexp_extract(flat, r"^OBJECT<(.*)>$", 1)
    lists = F.flatten(F.transform(F.regexp_extract_all(inner, F.lit(r"(\w+: \[[^\]]*\])"), F.lit(1)), lambda x: F.transform(F.regexp_extract_all(F.regexp_extract(x, r"\[(.*)\]", 1), F.lit(r"(\w+): "), F.lit(1)), lambda f: F.concat(F.regexp_extract(x, r"^(\w+): ", 1), F.lit("[]."), f))))
    plain = F.regexp_extract_all(F.regexp_replace(inner, r"\w+: \[[^\]]*\]", ""), F.lit(r"(\w+): "), F.lit(1))
    found = _digest(F.coalesce(F.concat(plain, lists), F.array().cast("array<string>")))
    value = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    repeated = lambda n, r, t: F.transform(F.try_variant_get(v, f"$.{n}", f"array<struct<`{r}`:string,`{t}`:string>>"), lambda x: _turn(canonical_role(x[r]), x[t]))
    has = lambda x, n: F.try_variant_get(x, f"$.{n}", "variant").isNotNull()

    def held(paths: list[str]) -> Column:
        ok = F.lit(True)
        for p in paths:
            outer, _, inner = p.partition("[].")
            items = F.try_variant_get(v, f"$.{outer}", "array<variant>")
            ok &= (items.isNotNull() & ((F.size(items) == 0) | F.exists(items, lambda x: has(x, inner)))) if inner else has(v, p)
        return F.coalesce(ok, F.lit(False))

    turns, layout = F.lit(None).cast(TURN), F.lit(None).cast("string")
    for name in reversed(BY_SIZE):
        paths, rule = LAYOUTS[name]
        if not rule.startswith("rows:"):
            turns = F.when(held(paths), _apply(rule, value, repeated)).otherwise(turns)
            layout = F.when(held(paths), F.lit(name)).otherwise(layout)
    return found, layout, turns


def turns_of_rows(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns) of a table with a row a turn: (key, turn, role, text).

    Turns stand in the order of ``turn``, nulls first; rows that tie go by role and text. A null
    role or text is empty. Roles stay as they are. One conversation is one row, as its formatted
    text is.
    """
    parts = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(parts)).alias("parts")).select(key, F.transform("parts", lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text"))).alias("turns"))


BEGIN, HEAD_END, END = "<turn>", "<text>", "</turn>\n"


def escape(text: Column) -> Column:
    r"""Backslash becomes \b and < becomes \l, so no text holds a mark of the template."""
    text = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_turns(turns: Column) -> Column:
    """One string: <turn>role<text>text</turn> and a line end for each turn, in order; null or no turns: empty."""
    one = lambda t: F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(HEAD_END), escape(t["text"]), F.lit(END))
    return F.coalesce(F.array_join(F.transform(turns, one), ""), F.lit(""))


def read_turns(formatted: Column) -> Column:
    """Turns read back from a formatted string, with the span of each text in it (code points)."""
    pieces = F.filter(F.split(formatted, END, -1), lambda p: p != "")

    def one(p: Column) -> Column:
        body = F.substring(p, F.lit(len(BEGIN) + 1), F.length(p))
        role = F.substring_index(body, HEAD_END, 1)
        text = F.substring(body, F.length(role) + len(HEAD_END) + 1, F.length(body))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"), F.length(p).alias("length"), F.length(text).alias("text_length"))

    return F.transform(pieces, one)


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """(start, length) of each masked text in the formatted string, in code points from 0: the texts of ``role``."""
    turns = read_turns(formatted)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + t["length"] - t["text_length"]
        spans = F.when(t["role"] == role, F.concat(state["spans"], F.array(F.struct(start.cast("int").alias("start"), t["text_length"].alias("length"))))).otherwise(state["spans"])
        return F.struct((state["at"] + t["length"] + len(END)).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step)["spans"]


def format_conversations(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, formatted, loss): each conversation as one string and the spans that are learnt.

    The layout of the columns selects the mapping: rows are turns, or a conversation each.
    """
    found = layout_of(field_paths(rows.schema))
    by_row = found is not None and found[1].startswith("rows:")
    turns = turns_of_rows(rows, key) if by_row else rows.select(key, turns_of_table(rows).alias("turns"))
    return turns.select(key, format_turns(F.col("turns")).alias("formatted")).select(key, "formatted", loss_spans(F.col("formatted")).alias("loss"))
