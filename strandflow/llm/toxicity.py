"""Toxicity by non-negative positive-unlabelled learning (numpy logistic model over words)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back
from .tokens import SPACE, buffers, lists, slices, word_hashes

#: words end at white space and at any other ASCII character that is no letter or digit
CUT = SPACE.copy()
for _c in range(128):
    CUT[_c] |= not chr(_c).isalnum()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = buffers(b.column(1))
        for lo, hi in slices(off):
            h, n = word_hashes(data, off[lo : hi + 1], CUT)
            parts = np.split(h.view(np.int64), np.cumsum(n)[:-1]) if hi > lo else []
            yield pa.record_batch([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), lists([np.unique(p) for p in parts])], ["doc_id", "y", "words"])


class Model:
    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        h, n = word_hashes(data, off, CUT)
        total = np.full(len(n), self.bias)
        if len(h) and len(self.words):
            h = h.view(np.int64)
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == h)
            row = np.repeat(np.arange(len(n)), n)[hit]
            pairs = np.unique(row * len(self.words) + at[hit])
            np.add.at(total, pairs // len(self.words), self.weights[pairs % len(self.words)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


class Rows:
    """0/1 features of some rows, by the places of the ones."""

    def __init__(self, row: np.ndarray, column: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.shape = row, column, shape

    @classmethod
    def of(cls, docs: list[np.ndarray], words: np.ndarray) -> Rows:
        flat, row = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
        hit = words[at] == flat
        return cls(row[hit], at[hit], (len(docs), len(words)))

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        """Sums of g over the rows of each column."""
        return np.bincount(self.column, g[self.row], self.shape[1])


def nnpu(xp: Rows, xu: Rows, prior: float, steps: int = 1500, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of a linear model under the non-negative risk estimator.

    Risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss. Where the
    negative part falls under zero, the step climbs it again instead, so the model can't fit the
    unlabelled rows into a negative risk. Adam on full batches; the weights of least risk stay.
    """
    d = xp.shape[1]
    w, b = np.zeros(d), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    best, kept = np.inf, (w, b)
    for t in range(1, steps + 1):
        zp, zu = xp @ w + b, xu @ w + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        risk = prior * np.logaddexp(0, -zp).mean() + max(0.0, negative) + decay * float(w @ w) / 2
        if risk < best:
            best, kept = risk, (w, b)
        gp, gu = sig(zp), sig(zu)
        rows_p, rows_u = xp.shape[0], xu.shape[0]
        neg = np.r_[xu.back(gu) / rows_u - prior * xp.back(gp) / rows_p, gu.mean() - prior * gp.mean()]
        pos = prior * np.r_[xp.back(gp - 1) / rows_p, (gp - 1).mean()]
        g = pos + neg if negative >= 0 else -neg
        g[:d] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:d], b - step[d]
    return kept[0], float(kept[1])


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The non-negative risk of scores of confirmed and of unlabelled rows, with the logistic loss."""
    return prior * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def cut_off(zp: np.ndarray, zu: np.ndarray, prior: float, floor: float = -np.inf) -> float | None:
    """Where above ``floor`` to call a text toxic: the least non-negative risk of the zero-one loss, the highest place on a tie; None without a place."""
    z = np.unique(np.r_[zp, zu])
    at = (z[1:] + z[:-1]) / 2
    at = at[at > floor]
    if not len(at):
        return None
    missed = np.searchsorted(np.sort(zp), at) / len(zp)
    called = 1 - np.searchsorted(np.sort(zu), at) / len(zu)
    value = prior * missed + np.maximum(0, called - prior * (1 - missed))
    return float(at[np.flatnonzero(value <= value.min() + 1e-12)[-1]])


#: the model that calls nothing
SILENT = (np.zeros(0, np.int64), np.zeros(0), -4.0)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least: int = 3, z_least: float = 4.0) -> Model:
    """Words that confirmed examples hold far more often than unlabelled text, all of them, weighed by nnPU.

    A word takes part if at least ``least`` confirmed texts hold it, their share exceeds that of the
    unlabelled ones by ``z_least`` standard errors, and unlabelled text holds it no more than twice
    as often as the prior lets toxic text do. The prior is lowered to what the unlabelled texts with
    such words allow. A text without any of them is never called toxic; without words, or where no
    cut-off above that leaves confirmed texts apart, the model abstains: it calls nothing.
    """
    if not positive or not unlabelled:
        return Model(*SILENT)
    wp, cp = np.unique(np.concatenate(positive), return_counts=True)
    wu, cu = np.unique(np.concatenate(unlabelled), return_counts=True)
    wp, cp = wp[cp >= least], cp[cp >= least]
    at = np.minimum(np.searchsorted(wu, wp), max(len(wu) - 1, 0))
    base = np.where(wu[at] == wp, cu[at], 0) if len(wu) else np.zeros(len(wp))
    fp, fu = cp / len(positive), base / len(unlabelled)
    pool = (cp + base) / (len(positive) + len(unlabelled))
    z = (fp - fu) / np.sqrt(pool * (1 - pool) * (1 / len(positive) + 1 / len(unlabelled)) + 1e-12)
    # a word of toxic text alone stands in unlabelled text as often as the prior says, give or take
    words = np.sort(wp[(z >= z_least) & (fu <= 2 * prior * fp + 2 / len(unlabelled))])
    if not len(words):
        return Model(*SILENT)

    xp, xu = Rows.of(positive, words), Rows.of(unlabelled, words)
    some = lambda x: len(np.unique(x.row)) / x.shape[0]
    prior = min(prior, max(0.005, some(xu) / some(xp)))
    w, b = nnpu(xp, xu, prior)
    cut = cut_off(xp @ w + b, xu @ w + b, prior, b + 1e-9)
    return Model(*SILENT) if cut is None else Model(words, w, b - cut)


def learn(docs: DataFrame, labels: DataFrame, most: int = 3000, seed: int = 5, folds: int = 5, held_fold: int = 0) -> Model:
    """Fit on at most ``most`` confirmed toxic and 3 * ``most`` unlabelled texts outside the held-out fold, picked by a hash of doc_id.

    The driver gets the distinct word hashes of these texts alone. Of rows that share a doc_id the
    least text counts.

    The class prior is the share of toxic rows among the labels outside the held-out fold, or what
    the unlabelled texts' words allow, whichever is less.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    known = labels.filter((crc_mod(F.col("doc_id"), folds) != held_fold) & F.col("toxic").isin(0, 1))
    n, pos = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    order = lambda df: df.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    picked = [(r[0], 1) for r in order(known.filter("toxic = 1").select("doc_id").distinct()).limit(most).collect()]
    pool = docs.select("doc_id").filter((crc_mod(F.col("doc_id"), folds) != held_fold) & F.col("doc_id").isNotNull())
    # confirmed rows stay in: unlabelled text stands for the whole population, of which the prior speaks
    unlabelled = [(r[0], 0) for r in order(pool).limit(3 * most).collect()]
    if not picked or not unlabelled:
        return Model(*SILENT)
    ids = spark.createDataFrame(picked + unlabelled, f"doc_id {kind}, y int")
    # of rows that share a doc_id one text counts, so the sample is bounded whatever the ids
    texts = docs.select("doc_id", "text").join(F.broadcast(ids.groupBy("doc_id", "y").count()), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
    got = texts.mapInArrow(_words, f"doc_id {kind}, y int, words array<bigint>").toArrow()
    y = got["y"].to_numpy()
    words = [x.values.to_numpy() for x in got["words"].combine_chunks()] if len(got) else []
    prior = min(0.9, max(0.005, pos / n))
    p = [w for w, v in zip(words, y, strict=True) if v == 1]
    u = [w for w, v in zip(words, y, strict=True) if v == 0]
    model = fit(p, u, prior)
    del got, y, words, p, u
    give_back()
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(1))
            for lo, hi in slices(off):
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(model.score(data, off[lo : hi + 1]), pa.float64())], ["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted): how likely a whole text is toxic.

    Labels are learnt only from rows whose crc32 of doc_id is not ``held_fold`` modulo ``folds``. A
    null or empty text has no words and gets the score of the bias, which is under one half. The
    model weighs all words that confirmed texts hold far more often (:func:`fit`); without confirmed
    examples, or without such words, it abstains: all scores are low and alike. Equal texts score
    alike; rows that repeat are scored each; other columns are not read.
    """
    model = learn(docs, labels, folds=folds, held_fold=held_fold, **options)
    scored = docs.select("doc_id", "text").mapInArrow(_score(model), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == held_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Documents whose score stays under ``threshold``, all their columns; all of them where the model abstains."""
    model = learn(docs, labels, **options)

    # only the text goes to Python; the rest of a row waits beside it
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            data, off = buffers(column)
            yield pa.array(np.concatenate([np.zeros(0), *(model.score(data, off[lo : hi + 1]) for lo, hi in slices(off))]), pa.float64())

    return docs.filter(score(F.col("text")) < threshold)
