"""Compression classifier: zstandard dictionaries from good and bad text, their size difference calibrated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

BLOCK = 2048


class Model:
    """Two dictionaries and a logistic calibration of what they save."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        self.good, self.bad, self.level = good, bad, level
        self.mean, self.scale, self.weight = np.zeros(3), np.ones(3), np.zeros(4)
        self._tools = None

    def __getstate__(self):
        return self.__dict__ | {"_tools": None}

    def sizes(self, text: bytes) -> tuple[int, int, int]:
        """Bytes of the whole text: plain, and compressed by the good and by the bad dictionary, block by block."""
        import zstandard as z

        if self._tools is None:
            self._tools = [z.ZstdCompressor(level=self.level, dict_data=z.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress for d in (self.good, self.bad)]
        g, b = self._tools
        sg = sb = 0
        for at in range(0, len(text), BLOCK):
            piece = text[at : at + BLOCK]
            sg += len(g(piece))
            sb += len(b(piece))
        return len(text), sg, sb

    def features(self, texts: list[bytes]) -> np.ndarray:
        """The size difference over both sizes and over the text's, and the smaller size over the text's.

        The last says how far either dictionary fits at all; without it the difference of a text that
        neither fits reads like that of a text both fit (README: figures with and without).
        """
        n, g, b = np.array([self.sizes(t) for t in texts], float).reshape(-1, 3).T
        n = np.maximum(n, 1)
        return np.stack([(g - b) / np.maximum(g + b, 1), (g - b) / n, np.minimum(g, b) / n], 1)

    def calibrate(self, texts: list[bytes], y: np.ndarray, ridge: float = 1e-3) -> None:
        """Logistic regression of the label on the size differences, by Newton steps."""
        x = self.features(texts)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (y - p) / len(x) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weight = w

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        x = np.c_[(self.features(texts) - self.mean) / self.scale, np.ones(len(texts))]
        return 1 / (1 + np.exp(-np.clip(x @ self.weight, -30, 30)))


def sample_texts(docs: DataFrame, labels: DataFrame, label: str, held: Column, most: int, longest: int, seed: int) -> list:
    """Up to ``most`` labelled texts of each class, by a hash of doc_id: a bounded sample, the only text the driver gets.

    Texts of more than ``longest`` characters are not learnt from; of rows that share a doc_id the
    least text counts.
    """
    usable = labels.filter(~held & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("y2")).filter("y = y2").select("doc_id", "y")
    picked = [usable.filter(F.col("y") == v).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most) for v in (0, 1)]
    ids = docs.sparkSession.createDataFrame([tuple(r) for p in picked for r in p.collect()], usable.schema)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= longest)
    rows = found.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return sorted(((r["doc_id"], r["text"], r["y"]) for r in rows), key=lambda r: (zlib_key(r[0]), r[1]))


def zlib_key(doc_id) -> int:
    import zlib

    return zlib.crc32(f"order{doc_id}".encode())


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of ``size`` bytes trained on all of the texts; of few texts, equal shares of each as raw content."""
    import zstandard as z

    texts = [t for t in texts if t]
    try:
        return z.train_dictionary(size, texts).as_bytes()
    except (z.ZstdError, ValueError):  # too little text to train on
        share = max(16, size // max(len(texts), 1))
        return b"\n".join(t[:share] for t in texts)[:size].ljust(8, b"\n")


def fit(rows: list, size: int = 65536) -> Model:
    """Every second text of a class trains its dictionary, the others calibrate."""
    by = {v: [r[1].encode() for r in rows if r[2] == v] for v in (0, 1)}
    model = Model(dictionary(by[1][::2], size), dictionary(by[0][::2], size))
    rest = [(t, v) for v in (0, 1) for t in by[v][1::2]]
    y = np.array([v for _, v in rest], float)
    if len(set(y.tolist())) == 2:
        model.calibrate([t for t, _ in rest], y)
    else:  # one class alone: its share is the score
        known = [v for v in (0, 1) for _ in by[v]]
        model.weight = np.array([0, 0, 0, 0.0 if len(set(known)) != 1 else (4.0 if known[0] else -4.0)])
    return model


def _score(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(x.as_py() or "").encode() for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(model.score(texts), pa.float64())], keep)

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = 2000, longest: int = 65536, seed: int = 3, folds: int = 3, held_fold: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted): how likely a whole text is of label 1.

    Labels are learnt only from rows whose crc32 of doc_id is not ``held_fold`` modulo ``folds``, at
    most ``most`` of each class. Texts are compressed whole, block by block, by two dictionaries;
    the normalised size difference is calibrated to 0..1. An empty or null text has a difference of
    0 and gets that score. Without labels every score is 0.5. Rows labelled both ways are not learnt
    from. Equal texts score alike; other columns are not read.
    """
    model = fit(sample_texts(docs, labels, "quality", crc_mod(F.col("doc_id"), folds) == held_fold, most, longest, seed))
    scored = docs.select("doc_id", "text").mapInArrow(_score(model, ["doc_id", "score"]), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == held_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
