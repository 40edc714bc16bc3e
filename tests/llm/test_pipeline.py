import random
import re
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from strandflow.llm import packing  # noqa: E402

WS = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, d string, f_block int, size bigint, token bigint, q int"


def corpus():
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("aeiourstn") for _ in range(rnd.randint(2, 6)))
    texts, toxic = [], set()
    for i in range(420):
        w = [word() for _ in range(rnd.randint(40, 120))]
        if i % 6 == 0:
            toxic.add(i)
            for at in (3, 17, 30):
                w[at] = rnd.choice(["vexjunk", "blorp", "grunk"])
        texts.append(" ".join(w))
    clean = [i for i in range(420) if i not in toxic]
    for i in rnd.sample(clean, 40):
        texts.append(texts[i].replace(" ", "\t ", 2))  # equal after white space is folded
    for i in rnd.sample(clean, 40):
        w = texts[i].split()
        w[rnd.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [None, "", " ", "x", "word " * 30000, "word " * 30000 + "more"]
    rows = [(i, t, "en", rnd.choice(["a", "b", None]), len(t or ""), "x", "y", i, 1, 2, 3) for i, t in enumerate(texts)]
    labels = [(i, 1, int(i in toxic)) for i in range(420) if i % 2 == 0]
    return rows, labels, toxic


def written(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def shingles(t, k=5):
    w = [x for x in WS.split((t or "").lower()) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_stages_keep_what_they_should(spark, tmp_path):
    rows, labels, toxic = corpus()
    sf = written(spark, tmp_path, rows, labels)
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "source_mixing", "best_fit_packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/out-{name}")
        docs = spark.read.parquet(f"{sf}/out-{name}")
        kept[name] = docs.collect()
    text = {r[0]: r[1] for r in rows}
    one = {r["doc_id"] for r in kept["toxicity"]}
    assert not one & toxic and {i for i in text if i not in toxic} == one
    first = {}
    for i in sorted(one):
        first.setdefault(WS.sub(" ", text[i] or ""), i)
    two = {r["doc_id"] for r in kept["exact_dedup"]}
    assert two == set(first.values()) and len(kept["exact_dedup"]) == len(two)
    ids = sorted(two)
    sets, root = {i: shingles(text[i]) for i in ids}, {i: i for i in ids}
    for a in ids:  # ids ascend, so each group ends at its smallest
        for b in ids:
            if b > a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    three = {r["doc_id"] for r in kept["ngram_jaccard_join"]}
    assert three == set(root.values()) and len(three) < len(two)
    four = [(r["doc_id"], r["text"]) for r in kept["source_mixing"]]
    assert {i for i, _ in four} <= three and all((t or "") in (text[i] or "") or set((t or "").split()) <= set((text[i] or "").split()) for i, t in four)
    e, tokens = packing.Encoder(packing.tokenizer_path()), 0
    for _, t in four:
        tokens += len(e(t or "")) // 4 + 1
    last = kept["best_fit_packing"]
    assert sum(r["length"] for r in last) == tokens and max(r["length"] for r in last) <= 1024
    by: dict = {}
    for r in last:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 1024
    assert zlib.crc32(b"") == 0


def test_the_pipeline_runs_whole_and_on_empty_tables(spark, tmp_path):
    rows, labels, _ = corpus()
    (tmp_path / "some").mkdir()
    (tmp_path / "none").mkdir()
    odd = [(None, "p p p", None, None, None, None, None, None, None, None, None)] * 3 + [(5, None, None, None, None, None, None, None, None, None, None)] * 2
    out = corpus_pipeline.run(spark, written(spark, tmp_path / "some", rows[:60] + odd, labels[:30]))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.filter("doc_id is null").count() >= 1 and out.count() > 40
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "none", [], [])).count() == 0
