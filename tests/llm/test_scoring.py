import random
import zlib

import numpy as np
import pytest

from strandflow.llm import chat, html_extract, mixing, packing, quality, toxicity
from strandflow.llm.queries import with_trap


def test_encoder_gives_the_ids_of_tokenizers():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    t, e = Tokenizer.from_file(path), packing.Encoder(path)
    rnd = random.Random(1)
    alphabet = "ab  \t\n\r\x0b  　'sdé1２ß.!​\x1c\x85😀한"
    texts = ["", " ", "a", "<|endoftext|> a", "x <|endoftext|>", "don't stop\n\n  now ", "a" * 5000] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    for x in texts:
        assert np.frombuffer(e(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_string_buffers_with_nulls_and_slices():
    import pyarrow as pa

    from strandflow.llm import tokens

    plain = pa.array(["ab", None, "", "céd", None])
    hidden = pa.Array.from_buffers(pa.string(), 3, [pa.py_buffer(bytes([0b101])), pa.py_buffer(np.array([0, 2, 5, 6], np.int32).tobytes()), pa.py_buffer(b"abXXXc")])
    for column, want in ((plain, ["ab", "", "", "céd", ""]), (plain.slice(1, 3), ["", "", "céd"]), (hidden, ["ab", "", "c"]), (pa.array([None, None], pa.string()), ["", ""]), (pa.array([], pa.string()), [])):
        data, off = tokens.buffers(column)
        assert [bytes(data[a:b]).decode() for a, b in zip(off, off[1:])] == want


def test_lower_bound_and_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = rng.integers(1, 100, rng.integers(1, 60))
        bins, offsets, left = packing.best_fit_decreasing(sizes, 100)
        low = packing.lower_bound(sizes, 100)
        assert -(-sizes.sum() // 100) <= low <= len(left)
        for b in range(len(left)):
            own = sorted((offsets[i], sizes[i]) for i in np.flatnonzero(bins == b))
            assert [o for o, _ in own] == np.cumsum([0, *[s for _, s in own]])[:-1].tolist() and sum(s for _, s in own) + left[b] == 100
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([], int), 100) == 0


def test_pack_covers_every_token_once(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randint(0, 400))) for _ in range(60)] + [None, "", "word " * 3000]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, piece int")
    out = packing.pack(df, 128, group=16).toPandas()
    e = packing.Encoder(packing.tokenizer_path())
    for i, t in enumerate(texts):
        ids = e(t or "") + (2).to_bytes(4, "little")
        own = out[out.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) // 4 and (own.length.iloc[1:] == 128).all() and own.piece.tolist() == list(range(len(own)))
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start * 4 : (r.start + r.length) * 4]) == r.ids_crc32
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist() and g.length.sum() <= 128
    assert out.sequence_id.nunique() <= packing.lower_bound(out.length.to_numpy(), 128) + 2
    assert packing.pack(df.limit(0), 128).count() == 0


def test_packing_spreads_rows_that_share_an_id_and_states_its_gap(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 2**60 + 1, 5]), " ".join(rnd.choice(["alpha", "beta"]) for _ in range(rnd.randint(0, 90)))) for _ in range(120)] + [(None, "same text"), (None, None)] * 30
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = packing.pack(df, 64, group=16).toPandas()
    e = packing.Encoder(packing.tokenizer_path())
    want = sorted((str(i), zlib.crc32(x[a * 4 : b * 4])) for i, t in rows for x in [e(t or "") + (2).to_bytes(4, "little")] for n in [len(x) // 4] for a, b in [(0, n % 64 or 64)] + [(k, k + 64) for k in range(n % 64 or 64, n, 64)])
    got = [(str(r["doc_id"]), r["ids_crc32"]) for r in packing.pack(df, 64, group=16).select("doc_id", "ids_crc32").collect()]
    assert sorted(got) == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist() and g.length.sum() <= 64
    sure = packing.certificate(packing.pack(df, 64, group=256), 64).first()
    assert sure["least"] == packing.lower_bound(out.length.to_numpy(), 64) <= sure["sequences"] <= sure["least"] + 2


def test_sainte_lague_takes_the_highest_quotients():
    rng = np.random.default_rng(4)
    for _ in range(60):
        w = rng.integers(0, 50, rng.integers(1, 8)).astype(float)
        seats = int(rng.integers(0, 40))
        if not w.any():
            continue
        want = np.zeros(len(w), int)
        for _ in range(seats):
            want[int(np.argmax(w / (2 * want + 1)))] += 1
        got = mixing.sainte_lague(w, seats)
        assert got.sum() == seats and np.allclose(np.sort(w / (2 * got + 1)), np.sort(w / (2 * want + 1)))


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rnd.choice([0, 3, 50, 400]))), rnd.choice(["a", "b", "B", "é", None])) for i in range(300)] + [(900, None, "a"), (901, "  \t", "zz")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, shard string, size int")
    out = mixing.mix(df, shard_words=2000).toPandas()
    again = mixing.mix(df.repartition(7), shard_words=2000).toPandas()
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, out[key].values)) == sorted(map(tuple, again[key].values))
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    assert dict(zip(out.doc_id, out["size"])) == sizes and (out.taken <= 3 * out["size"]).all()
    src = {i: s for i, _, s in rows}
    order = sorted(set(src.values()), key=lambda s: (s is None, s or ""))
    assert order[-1] is None
    per = [sum(sizes[i] for i in sizes if src[i] == s) for s in order]
    goal = mixing.targets(per, [1 + k % 3 for k in range(len(order))])
    assert abs(sum(goal) - sum(per)) < 1e-6 and all(g <= 3 * p + 1e-9 for g, p in zip(goal, per))
    for s, g in zip(order, goal):
        taken = out[[src[i] == s for i in out.doc_id]].taken.sum()
        assert abs(taken - g) <= 200
    made = mixing.mixed_documents(df, shard_words=2000)
    assert made.columns == df.columns
    words = {}
    for r in made.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len((r["text"] or "").split())
    assert {k: v for k, v in words.items() if v} == {i: t for i, t in zip(out.doc_id, out.taken) if t}


def test_mixing_deals_copies_of_a_row_over_shards(spark):
    rows = [(7, "w " * 50, "a")] * 400 + [(None, "v " * 20, "a")] * 300 + [(i, "u " * 30, "b") for i in range(100)] + [(1, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(df, shard_words=500).toPandas()
    again = mixing.mix(df.repartition(5), shard_words=500).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, out[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert len(out) == 801 and (out.taken <= 3 * out["size"]).all()
    assert sorted(out["size"]) == sorted(len((t or "").split()) for _, t, _ in rows)
    for target, g in out.groupby("target"):  # a block a shard at most
        assert abs(g.taken.sum() - target) <= 16 * (g.source_size.iloc[0] // 500 + 1)


def labelled(spark, kind):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeiourstn") for _ in range(rnd.randint(2, 7)))
    bad = ["vexjunk", "blorp", "grunk"]
    rows, labels = [], []
    for i in range(900):
        y = int(i % 4 == 0)
        w = [word() for _ in range(rnd.randint(60, 200))]
        if kind == "toxic" and y:
            w[5], w[20], w[40] = rnd.choice(bad), rnd.choice(bad), rnd.choice(bad).upper() + ","
        t = " ".join(w)
        if kind == "quality" and not y:
            t = " | ".join(x.upper() for x in w)
        rows.append((i, t, "x"))
        if i % 2 == 0:
            labels.append((i, y, y))
    rows += [(5000, None, "x"), (5001, "", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize(("kind", "score", "folds", "fold"), [("toxic", toxicity.toxicity_scores, 5, 0), ("quality", quality.quality_scores, 3, 1)])
def test_held_out_accuracy(spark, kind, score, folds, fold):
    df, labels = labelled(spark, kind)
    out = score(df, labels).toPandas()
    assert len(out) == 902 and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % folds == fold for i in out.doc_id]).all()
    held = out[out.held_out & (out.doc_id < 900)]
    assert (held.predicted == (held.doc_id % 4 == 0)).mean() > 0.85
    assert score(df, labels.limit(0)).count() == 902 and score(df.limit(0), labels).count() == 0


def test_drop_toxic_keeps_clean_documents(spark):
    df, labels = labelled(spark, "toxic")
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len([i for i in range(900) if i % 4 and i in ids]) > 660 and len([i for i in range(0, 900, 4) if i in ids]) < 12 and 5000 in ids


def test_quality_sizes_and_calibration_equal_a_direct_computation(spark):
    import zstandard as z

    df, labels = labelled(spark, "quality")
    rows = quality.sample_texts(df, labels, "quality", quality.crc_mod(quality.F.col("doc_id"), 3) == 1, 60, 5000, 3)
    assert len(rows) <= 120 and {v for *_, v in rows} == {0, 1} and all(zlib.crc32(str(i).encode()) % 3 != 1 for i, *_ in rows)
    model = quality.fit(rows, 4096)
    text = (rows[0][1] * 20).encode()
    for way, d in ((1, model.good), (2, model.bad)):
        own = z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        assert model.sizes(text)[way] == sum(len(own.compress(text[i : i + 2048])) for i in range(0, len(text), 2048))
    rest = [(t.encode(), v) for v in (0, 1) for t in [r[1] for r in rows if r[2] == v][1::2]]
    p, y = model.score([t for t, _ in rest]), np.array([v for _, v in rest])
    x = np.c_[(model.features([t for t, _ in rest]) - model.mean) / model.scale, np.ones(len(rest))]
    assert np.abs(x.T @ (y - p) / len(y) - 1e-3 * model.weight).max() < 1e-6, "the gradient of the ridge loss is zero"
    again = df.unionByName(df)
    assert len(quality.sample_texts(again, labels, "quality", quality.F.lit(False), 10, 5000, 3)) == 20


def test_nnpu_minimises_the_risk_it_states():
    rng = np.random.default_rng(7)
    xp, xu = (rng.random((80, 4)) < [0.8, 0.1, 0.5, 0.3]).astype(float), (rng.random((400, 4)) < [0.1, 0.1, 0.5, 0.3]).astype(float)
    prior, decay = 0.1, 1e-3
    w, b = toxicity.nnpu(*[toxicity.Rows(*np.nonzero(x), x.shape) for x in (xp, xu)], prior, decay=decay)

    def direct(w, b):  # the estimator written out row by row
        loss = lambda z: float(np.log1p(np.exp(-z)))
        p = [float(x @ w + b) for x in xp]
        u = [float(x @ w + b) for x in xu]
        negative = sum(loss(-z) for z in u) / len(u) - prior * sum(loss(-z) for z in p) / len(p)
        return prior * sum(loss(z) for z in p) / len(p) + max(0.0, negative)

    assert abs(direct(w, b) - toxicity.risk(xp @ w + b, xu @ w + b, prior)) < 1e-9
    own = direct(w, b) + decay * w @ w / 2
    near = [(w + rng.normal(size=4) * s, b + rng.normal() * s) for s in (0.02, 0.2, 1.0) for _ in range(60)]
    assert all(direct(v, c) + decay * v @ v / 2 > own - 2e-3 for v, c in near) and w[0] > 1


def test_a_toxicity_model_without_evidence_calls_nothing(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("aeiourstn") for _ in range(3))
    rows = [(i, " ".join(word() for _ in range(40))) for i in range(300)] + [(7, "another row of seven"), (None, "x"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(60)], "doc_id bigint, toxic int")
    assert toxicity.drop_toxic(df, labels).count() == len(rows)
    out = toxicity.toxicity_scores(df, labels).toPandas()
    assert len(out) == len(rows) and out.predicted.sum() == 0 and not out.held_out[out.doc_id.isna()].any()


def test_chat_round_trip_and_layouts(spark):
    from pyspark.sql import functions as F

    texts = ["\\### Assistant: </turn> ok", "</turn>\n<turn>user<text>", "\\l\\b<", "", None, "plain\n", "\\"]
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate(zip(["system", "user", "assistant", "assistant", "user", None, "assistant"], texts))]
    df = with_trap(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    out = chat.format_conversations(df).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    for r in out:
        want = [("user", texts[0]), ("assistant", texts[0])] if r["conv_id"] == -7 else [(a or "", b or "") for _, _, a, b in rows[:7]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        raw = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"]]
        assert [x.replace("\\l", "<").replace("\\b", "\\") for x in raw] == [b for a, b in want if a == "assistant"]
    js = ['{"prompt": "p", "response": "r"}', '{"messages": [{"role": "human", "content": "q"}, {"role": "assistant", "content": "a"}]}', '{"conversations": [{"from": "gpt", "value": "v"}]}', '{"instruction": "i", "input": "n", "output": "o"}', '{"other": 1}', "no json", None]
    fp, layout, turns = chat.turns_of_json(F.col("j"))
    got = spark.createDataFrame([(j,) for j in js], "j string").select("j", fp.alias("f"), layout.alias("l"), turns.alias("t")).collect()
    assert [r["l"] for r in got] == ["prompt_response", "messages_role_content", "conversations_from_value", "instruction_input_output", None, None, None]
    assert [(t["role"], t["text"]) for t in got[1]["t"]] == [("user", "q"), ("assistant", "a")] and got[3]["t"][0]["text"] == "i\n\nn" and got[4]["t"] is None
    table = spark.createDataFrame([("s", "p", "r")], "system string, prompt string, response string")
    assert [t["role"] for t in table.select(chat.turns_of_table(table).alias("t")).first()["t"]] == ["system", "user", "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; more</h1><p><b>One<br><p>Two  words\n here &lt;3 {}</p><div class="ad">Buy</div><script>var t="</p>";</script><section class="comments"><p>first!</p></section><p>Last</article>
<aside>Side</aside><form>Mail<input></form><footer>&copy; x</footer></body></html>"""


def test_main_text_of_pages(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.replace("{}", f"n{i}")) for i in range(40)]
    plain = ["<html><body><div id=top>Shop | Home</div><div class=content><p>" + f"Story {i} " * 30 + "</p><p>" + f"More {i * 7} " * 20 + "</p></div><div>All rights here</div></body></html>" for i in range(20)]
    rows += [(100 + i, f"http://plain.org/{i}", h) for i, h in enumerate(plain)] + [(200, None, None), (201, "x", ""), (202, "y", "<article><p>cut &am"), (203, "y", "just text <b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, host string")
    out = {r["page_id"]: r["text"] for r in html_extract.main_text(df).collect()}
    for i in range(40):
        assert out[i] == f"Head & more\nOne\nTwo words here <3 n{i}\nLast"
    for i in range(20):
        assert out[100 + i] == (f"Story {i} " * 30).strip() + "\n" + (f"More {i * 7} " * 20).strip()
    assert out[200] == "" and out[201] == "" and out[202] == "cut &am" and out[203] == "just text"
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_tree_matching_counts_pairs():
    a, b = html_extract.parse("<ul><li>1<li>2<p>x</p></ul>"), html_extract.parse("<ul><li>9<p>y</p><li>3</ul>")
    forest = html_extract.Forest()
    assert forest.match(forest.add(a).shape, forest.add(b).shape) == 4


def test_chat_layouts_take_extra_fields_and_run_the_query(spark):
    from pyspark.sql import functions as F

    rows = [
        ('{"id": 1, "prompt": "a", "response": "b"}', "prompt_response", [("user", "a"), ("assistant", "b")]),
        ('{"messages": [], "id": 2}', "messages_role_content", []),
        ('{"messages": [{"role": "human", "text": "x", "at": {"n": 1}}], "meta": {"a": {"b": [1]}}}', "messages_role_text", [("user", "x")]),
        ('{"instruction": "i", "input": "", "output": "o", "meta": {"a": 1}}', "instruction_input_output", [("user", "i"), ("assistant", "o")]),
        ('{"id": 3}', None, None),
    ]
    _, layout, turns = chat.turns_of_json(F.col("j"))
    got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, j string").select("i", layout.alias("l"), turns.alias("t")).orderBy("i").collect()
    assert [(g["l"], g["t"] and [tuple(t) for t in g["t"]]) for g in got] == [(n, t or (None if t is None else [])) for _, n, t in rows]
    table = spark.createDataFrame([(7, "p", "r", 1)], "conv_id bigint, prompt string, response string, extra int")
    assert [t["role"] for t in table.select(chat.turns_of_table(table).alias("t")).first()["t"]] == ["user", "assistant"]
    assert "p" in chat.format_conversations(table).first()["formatted"]
    assert chat.layout_of(["conv_id", "role", "text", "turn"])[0] == "turn_rows"


def test_pages_with_null_and_large_ids_keep_them(spark):
    rows = [(None, "http://a.org/1", PAGE), (2**62 + 1, "http://a.org/2", PAGE.replace("{}", "z")), (2**62 + 1, "http://a.org/2", None), (None, None, None)] * 3
    out = html_extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((str(r["page_id"]), str(r["url"])) for r in out) == sorted((str(a), str(b)) for a, b, _ in rows)
    assert {r["text"].split("\n")[0] for r in out} == {"", "Head & more"}


def stripped_pages(n=12, body=None):
    """Pages without article tags or telling names: menus, adverts and footers that vary, a notice that does not."""
    rnd = random.Random(11)
    some = lambda k: " ".join(rnd.choice(["river", "stone", "cloud", "field", "light"]) + str(rnd.randrange(1000)) for _ in range(k))
    out = []
    for i in range(n):
        paras = [some(rnd.randint(8, 60)) for _ in range(rnd.randint(2, 9))]
        extra = f'<div id="related-work"><p>Own {i} words</p></div>' if i == 3 else ""
        html = f"""<html><body><div class=a1><ul>{"".join(f"<li><a href=x>{some(1)}</a></li>" for _ in range(5))}</ul></div><div class=b7>{some(6)}</div>
        <div class=c3><h1>Title {i}</h1><div class=z><p>We keep what you read for ninety days</p></div>{"".join(f"<p>{p}</p>" for p in paras)}{extra}<div class="related-posts"><p>{some(4)}</p></div></div><div class=d9>made by {some(3)}</div></body></html>"""
        out.append((html, "\n".join([f"Title {i}", *paras, *([f"Own {i} words"] if extra else [])])))
    return out


def test_the_wrapper_finds_articles_without_telling_tags_or_names():
    pages = stripped_pages()
    assert html_extract.extract([h for h, _ in pages]) == [t for _, t in pages]
    plain = html_extract.extract([h for h, _ in pages], wrapper=False)
    assert sum(p != t for p, (_, t) in zip(plain, pages)) == len(pages), "without the wrapper no page comes out right"
    same = [pages[0][0].replace("Title 0", f"Title {i}") for i in range(9)]  # copies of one article are no template
    assert [x.split("\n", 1)[0] for x in html_extract.extract(same)] == [f"Title {i}" for i in range(9)]
    assert all(len(x) > 60 for x in html_extract.extract(same))


def test_hostile_pages_do_not_crash_or_hang():
    import time

    began = time.time()
    deep = ["<div>" * 10000 + f"<{t}>end {t}" for t in ("i", "b", "p", "u")]
    assert html_extract.extract(deep) == [f"end {t}" for t in ("i", "b", "p", "u")]
    assert html_extract.extract(["<div>" * 20000 + "</span>" * 20000 + "x"] * 2) == ["x", "x"]
    wide = ["<article>" + "".join(f"<{t}>{i}</{t}>" for i, t in enumerate(rows)) + "</article>" for rows in (["p", "h2", "ul"] * 1000, ["p", "ul", "p"] * 1100, ["h2", "p"] * 1500)]
    assert [len(x.split("\n")) for x in html_extract.extract(wide)] == [3000, 3300, 3000]
    assert html_extract.extract(["<p " + "b" * 5000, "<p " + "b='" * 500, "a <b" + " c" * 3000 + ">d"])[2] == "a d"
    assert time.time() - began < 60


def test_matching_by_divide_and_conquer_is_as_good_as_the_table():
    rng = np.random.default_rng(5)
    for _ in range(40):
        w, ix, iy = rng.integers(0, 9, (4, 3)), rng.integers(0, 4, rng.integers(1, 40)), rng.integers(0, 3, rng.integers(1, 40))
        value = lambda pairs: sum(int(w[ix[u], iy[v]]) for u, v in pairs)  # noqa: E731, B023
        table, parts = html_extract._trace(w, ix, iy), html_extract._trace(w, ix, iy, cells=6)
        assert value(table) == value(parts) == html_extract._last_row(w, ix, iy)[-1]
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(parts, parts[1:]))
