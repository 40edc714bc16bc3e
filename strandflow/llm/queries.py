"""The ten operators over their whole tables, with the digests their contracts name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embed_dedup, exact_dedup, html_extract, line_dedup, mixing, ngram_join, packing, quality, toxicity
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("digest", "text_sha256")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "removed", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def with_trap(rows: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts look like the template."""
    text = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    trap = rows.sparkSession.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(text).alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(trap)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chat.format_conversations(with_trap(table(spark, sf_dir, "conversations")))
    done = done.withColumn("turns", chat.read_turns(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss", lambda s: chat.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), sha(learnt).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_exact_dedup, op3_quality_classifier, op4_best_fit_packing, op5_toxicity, op6_source_mixing, op7_line_dedup, op8_embedding_dedup, op9_ngram_jaccard_join, op10_chat_formatting)}

ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256 FROM t""",
    "op10_chat_formatting": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        g AS (SELECT conv_id, count(*) AS n_turns,
                     string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                     coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
                     sum(length(replace(replace(role, '\', '\b'), '<', '\l')) + length(replace(replace(text, '\', '\b'), '<', '\l')) + 20) AS f
              FROM c GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM g""",
    "op9_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3])) END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
              HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
        SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = s.doc_id""",
    "op8_embedding_dedup": r"""
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        f AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
        SELECT v.vec_id, coalesce(d.n, 0) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
        FROM v JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) d ON d.a = v.vec_id""",
}
