import random
import re

import pytest

from strandflow.llm import embed_dedup, exact_dedup, line_dedup, ngram_join

WS = re.compile(r"[\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, run string, f_block int")


def rows_of(texts, start=0):
    return [(i + start, t, "en", f"s{i % 3}", len(t or ""), "x", i) for i, t in enumerate(texts)]


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


TEXTS = ["a b", "a\tb", "a  b", None, "", " ", "x", "x", "long " * 20000, "long " * 20000, "é", "e"]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: __import__("pyspark.sql.functions", fromlist=["x"]).length(t).cast("string")])
def test_exact_duplicates_follow_bytes_even_when_digests_collide(spark, digest):
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs(spark, rows_of(TEXTS)), digest).collect()}
    norm = [WS.sub(" ", t or "") for t in TEXTS]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(same), len(same), min(same) == i)


def test_exact_dedup_keeps_columns_and_folds_repeated_rows(spark):
    rows = rows_of(TEXTS) + [rows_of(TEXTS)[6]]
    df = docs(spark, rows)
    out = exact_dedup.drop_exact_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 3, 5, 6, 8, 10, 11]
    assert exact_dedup.drop_exact_duplicates(docs(spark, [])).count() == 0
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: __import__("pyspark.sql.functions", fromlist=["x"]).length(t).cast("string")])
def test_exact_dedup_loses_no_text_with_null_and_repeated_ids(spark, digest):
    rows = [(None, "p"), (None, "p"), (1, "r"), (None, None), (None, ""), (None, " "), (2, "q"), (2, "r"), (2, "s s"), (3, "s  s"), (4, "q"), (None, "q"), (5, "alone"), (5, "alone"), (5, "other"), (6, "o"), (None, "nobody")]
    df = spark.createDataFrame([(a, b, "x", i) for i, (a, b) in enumerate(rows)], "doc_id bigint, text string, d string, k_text int")
    out = exact_dedup.drop_exact_duplicates(df, digest)
    assert out.columns == df.columns
    key = lambda i: (i is None, i or 0)
    want = {}
    for a, b in rows:
        t = WS.sub(" ", b or "")
        want[t] = min(want.get(t, (True, 10**9)), key(a)) if t in want else key(a)
    got = [(WS.sub(" ", r["text"] or ""), key(r["doc_id"])) for r in out.collect()]
    assert sorted(got) == sorted(want.items())


def shingles(t, k):
    w = [x for x in WS.split((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_texts(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(4):
        base = [word() for _ in range(rnd.choice([12, 40, 90]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randint(0, 5)):
                at = rnd.randrange(len(w))
                if rnd.random() < 0.5:
                    w[at] = word()
                elif rnd.random() < 0.5:
                    del w[at]
                else:
                    w.insert(at, word())
            out.append(" ".join(w))
    out += [" ".join(passage + [word() for _ in range(8)]) for _ in range(15)]
    return [*out, "", None, "one", "One", "one two", "a b c d", "A  b\tc d"]


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (2, 5, 80), (3, 3, 70)])
def test_jaccard_components_equal_brute_force(spark, seed, words, percent):
    texts = near_texts(seed)
    sets = [shingles(t, words) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = components(len(texts), links)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(docs(spark, rows_of(texts)), words, percent).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]


def test_drop_near_duplicates_keeps_one_of_each_group(spark):
    texts = near_texts(4)
    sets = [shingles(t, 5) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    df = docs(spark, rows_of(texts))
    out = ngram_join.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(components(len(texts), links)))
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0


def test_line_dedup_removes_later_copies_of_multi_line_chunks(spark):
    rnd = random.Random(5)
    line = lambda: " ".join(str(rnd.randrange(1000)) for _ in range(6))
    shared = [line() for _ in range(40)]
    texts = ["\n".join([line() for _ in range(rnd.randint(0, 9))] + shared + [line() for _ in range(3)]) for _ in range(6)] + ["single", "single", "", None]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, rows_of(texts))).collect()}
    assert out[0]["text"] == texts[0] and out[6]["text"] == "single" and out[7]["text"] == "single" and out[9]["text"] is None
    for i in range(1, 6):
        assert out[i]["removed"] > 20, "most of the shared passage goes whatever stands before it"
        kept = out[i]["text"].split("\n")
        assert len(kept) == out[i]["n_lines"] - out[i]["removed"]
        assert [x for x in kept if x not in shared] == [x for x in texts[i].split("\n") if x not in shared]


def lines_left(texts, least=2, words=50):
    seen, out = set(), []
    for t in texts:
        ls, gone = (t or "").split("\n"), set()
        for i in range(len(ls)):
            for n in [least] * (i + least <= len(ls)) + [1] * (len(ls[i].split()) >= words):
                run = (n, *ls[i : i + n])
                gone |= set(range(i, i + n)) if run in seen else set()
                seen.add(run)
        out.append((None if t is None else "\n".join(x for i, x in enumerate(ls) if i not in gone), len(gone)))
    return out


def test_line_dedup_removes_short_passages_and_long_lines_whole(spark):
    rnd = random.Random(6)
    line = lambda n=6: " ".join(str(rnd.randrange(1000)) for _ in range(n))
    some = lambda n: [line() for _ in range(n)]
    texts = []
    for size in (2, 3, 4, 6, 10):
        shared = some(size)
        texts += ["\n".join(some(rnd.randint(1, 4)) + shared + some(rnd.randint(1, 4))) for _ in range(4)]
    long, short, almost = line(50), line(), line(49)
    texts += ["\n".join([line(), x, line()]) for x in (long, short, almost) for _ in range(3)] + [long, long, texts[0], "\n".join(["a"] * 4)]
    # without a mask every line is a boundary, so every run of two lines is a chunk
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, rows_of(texts)), mask=0).collect()}
    want = lines_left(texts)
    assert [(out[i]["text"], out[i]["removed"]) for i in range(len(texts))] == want
    assert sum(n for _, n in want) == 3 * (2 + 3 + 4 + 6 + 10) + 2 + 2 + len(texts[0].split("\n")) + 3


def chunks_of(text, least=2, words=50, mask=1, most=8):
    """(at, lines) of each content-defined chunk, from the rule as stated."""
    import struct

    import xxhash

    lines = (text or "").split("\n")
    hs = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in lines]
    size = [x.count(" ") + 1 for x in lines]

    def edge(at):
        if at < 0 or at + least > len(lines):
            return False
        h = 42
        for x in hs[at : at + least]:
            h = xxhash.xxh64(struct.pack("<Q", x), seed=h).intdigest()
        return h & mask == 0

    out = set()
    for i in range(len(lines)):
        for way in (1, -1):
            w, j = 0, i
            for k in range(1, most + 1):
                if not 0 <= j < len(lines):
                    break
                w += size[j]
                if w >= words or k == most or (k >= least and edge(j - least + 1 if way == 1 else j)):
                    out.add((min(i, j), k))
                    break
                j += way
    return out


def chunks_left(rows, **options):
    import xxhash

    order = {}
    for key, t in rows:
        h = xxhash.xxh64((t or "").encode(), seed=42).intdigest()
        order[(key is None, key or 0, h - (1 << 64) if h >> 63 else h)] = t
    seen, out = set(), {}
    for place in sorted(order):
        lines, gone = (order[place] or "").split("\n"), set()
        for at, k in sorted(chunks_of(order[place], **options)):
            run = tuple(lines[at : at + k])
            gone |= set(range(at, at + k)) if run in seen else set()
            seen.add(run)
        out[(None if place[0] else place[1], order[place] or "")] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return sorted(((a, None if t is None else out[a, t or ""][0], *out[a, t or ""][1:]) for a, t in rows), key=str)


def test_line_dedup_equals_brute_force_with_repeated_and_null_ids(spark):
    rnd = random.Random(9)
    pool = [" ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.choice([0, 1, 4, 9, 20, 60]))) for _ in range(25)]
    rows = []
    for i in range(160):
        lines = [rnd.choice(pool) if rnd.random() < 0.3 else f"own {rnd.random()}" for _ in range(rnd.randint(0, 12))]
        if i % 3 == 0:  # a passage of the pool in its order
            at = rnd.randrange(15)
            lines[len(lines) // 2 : 0] = pool[at : at + rnd.randint(2, 10)]
        rows.append((rnd.choice([None, 5, 6, 7, 100 + i, 100 + i, 100 + i]), "\n".join(lines)))
    twelve = "\n".join(f"line number {i} of a text that stands twice" for i in range(12))
    rows += [(900, twelve), (901, twelve), (901, "\n".join(f"alone {i}" for i in range(12))), (902, None), (902, None), (None, None), (903, ""), rows[0], rows[0], (904, "\n" * 30), (905, "\n" * 30)]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id bigint, text string, th int, body string")
    for options in ({}, {"mask": 3, "least": 3}):
        got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["removed"]) for r in line_dedup.dedup_lines(df, **options).collect()), key=str)
        assert got == chunks_left(rows, **options)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_removes_every_later_copy_of_passages_of_fifty_words(spark):
    rnd = random.Random(10)
    line = lambda n: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(n))
    texts, passages = [], []
    for size in (1, 2, 3, 5, 8, 20):
        for _ in range(6):
            p = [line(max(1, -(-52 // size))) for _ in range(size)]
            passages += [p] * 3
            texts += ["\n".join([line(rnd.randint(1, 12)) for _ in range(rnd.randint(0, 5))] + p + [line(rnd.randint(1, 12)) for _ in range(rnd.randint(0, 5))]) for _ in range(3)]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, rows_of(texts))).collect()}
    for i, (t, p) in enumerate(zip(texts, passages)):
        want = t if i % 3 == 0 else "\n".join(x for x in t.split("\n") if x not in p)
        assert out[i]["text"] == want


def test_embedding_links_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    vecs = [base[rng.integers(60)] * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.5]) for _ in range(400)]
    vecs += [vecs[0]] * 5
    rows = [(i, [float(x) for x in v], i % 2, "x") for i, v in enumerate(vecs)]
    rows += [(1000, None, 0, "x"), (1001, [0.0] * 16, 0, "x"), (1002, [float("nan")] * 16, 0, "x"), (1003, rows[0][1], None, "x"), (1004, [1.0, None], 1, "x"), (1005, [], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, cell string")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df, per_cell=80, block=64).collect()}
    x = np.array(vecs)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = (x @ x.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(sim, False)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found <= sim.sum() and found >= 0.9 * sim.sum()
    assert all(got[i]["n_links"] <= sim[i].sum() for i in range(len(x)))
    for i in (1000, 1001, 1002, 1003, 1004, 1005):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    whole = embed_dedup.near_duplicates(df, per_cell=10**6)
    assert {r["vec_id"]: r["n_links"] for r in whole.collect() if r["vec_id"] < 1000} == {i: int(sim[i].sum()) for i in range(len(x))}
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_links_are_complete_with_dozens_of_cells_and_a_hot_group(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    hot = rng.normal(size=24)
    x = np.concatenate([hot + rng.normal(size=(500, 24)) * rng.choice([0.1, 0.25], (500, 1)), rng.normal(size=(600, 24))])
    x = np.concatenate([x, x[500:900] + rng.normal(size=(400, 24)) * 0.3])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, [float(z) for z in v], 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    sim = x @ x.T >= 0.93
    np.fill_diagonal(sim, False)
    want = components(len(x), [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(sim)), strict=True)])
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df, per_cell=25, block=64).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == sim.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == want


def test_crowded_cells_are_divided_without_losing_a_pair(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 12))
    x = np.concatenate([base[rng.integers(30, size=700)] + rng.normal(size=(700, 12)) * rng.choice([0.15, 0.4], (700, 1)), rng.normal(size=(300, 12))])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(z) for z in v], i % 3 == 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label boolean")
    sim = (x @ x.T >= 0.93) & ((np.arange(1000)[:, None] % 3 == 0) == (np.arange(1000) % 3 == 0))
    np.fill_diagonal(sim, False)
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(df, per_cell=12, most_cells=5, sample=200, block=32).collect()}
    assert [got[i] for i in range(1000)] == sim.sum(1).tolist() and sim.sum() > 1000


def test_vectors_that_do_not_cluster_are_shuffled_once(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64)).astype("f4")
    x[2500:] = x[:500] + rng.normal(size=(500, 64)) * 0.02
    df = spark.createDataFrame([(i, [float(z) for z in v], 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()

    before = written()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df, per_cell=30, block=128, chunk_mb=0).collect()}
    assert written() - before < 4 * x.nbytes  # with visits to other cells it was 299 times the input
    assert got == {i: (int(i < 500 or i >= 2500), i - 2500 if i >= 2500 else i) for i in range(3000)}


def test_links_of_a_group_whose_pivot_has_shingles_of_its_own(spark):
    rng, rows = random.Random(8), []
    for g in range(50):
        n = rng.choice([40, 80, 160])
        base = [f"g{g}w{i}" for i in range(n)]
        for c in range(rng.choice([6, 12, 25])):
            own = [f"g{g}c{c}t{i}" for i in range(rng.randrange(max(2, n // 7)))]
            rows.append((len(rows), " ".join(base[: n - rng.randrange(max(2, n // 12))] + own)))
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (t.split() for _, t in rows)]
    group = [int(t[1 : t.index("w")]) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if group[a] == group[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), words=4, percent=85)
    got = {r["doc_id"]: r["component_id"] for r in out.collect()}
    assert [got[i] for i in range(len(rows))] == components(len(rows), links)


def test_components_of_a_long_path(spark):
    from strandflow.llm.components import connected_components

    ids = list(range(4000))
    random.Random(7).shuffle(ids)
    path, ring = ids[:3000], sorted(ids[3000:])
    edges = [*zip(path, path[1:], strict=False), *zip(ring, ring[1:] + ring[:1], strict=True), (5, 5), (None, 3), (path[0], path[1])]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: min(path) for i in path} | {i: min(ring) for i in ring}
