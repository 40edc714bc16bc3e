"""Allele lists: alignment of two records' alleles, trimming, trio genotypes."""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def extended(ref: str, other_ref: str) -> str | None:
    """What the longer of two compatible reference alleles has beyond the shorter; null if they disagree."""
    a, b = ref.upper(), other_ref.upper()
    if a.startswith(b):
        return a[len(b) :]
    return b[len(a) :] if b.startswith(a) else None


def find_allele(alleles: list[str], other: list[str], which: int) -> int:
    """Index in ``alleles`` of ``other[which]`` once both lists have one reference; -1 if it isn't there."""
    tail = extended(alleles[0], other[0])
    if tail is None:
        return -1
    mine = [x.upper() + (tail if len(other[0]) > len(alleles[0]) else "") for x in alleles]
    want = other[which].upper() + (tail if len(alleles[0]) > len(other[0]) else "")
    return mine.index(want) if want in mine else -1


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def allele_map(alleles: pd.Series, other: pd.Series) -> pd.Series:
    """For each allele of ``other`` its index in ``alleles`` or -1."""
    return pd.Series([[find_allele(list(a), list(b), i) for i in range(len(b))] for a, b in zip(alleles, other, strict=True)])


def trim_likelihoods(pl: Column, kept: Column) -> Column:
    """PL values of the genotypes among the kept allele indices, in order."""
    n = F.size(kept)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(0), i), lambda j: F.struct(kept[j].alias("a"), kept[i].alias("b")))))
    return F.transform(pairs, lambda g: F.get(pl, (g["b"] * (g["b"] + 1) / 2 + g["a"]).cast("int")))


def trim_values(values: Column, kept: Column) -> Column:
    return F.transform(kept, lambda i: F.get(values, i.cast("int")))


def allele_mask(kept: Column) -> Column:
    return F.aggregate(kept, F.lit(0), lambda a, i: a.bitwiseOR(F.pow(F.lit(2), i).cast("int")))


def mendelian_prior(father: tuple[int, int], mother: tuple[int, int], child: tuple[int, int], novel: float = 1e-8) -> float:
    """P(child | parents): a quarter for each way to inherit; what nobody passes on is new."""
    ways = [tuple(sorted(p)) for p in itertools.product(father, mother)]
    p = ways.count(tuple(sorted(child))) / 4
    return p if p else novel


@lru_cache(maxsize=32)
def trio_prior(alleles: int, novel: float = 1e-8) -> np.ndarray:
    """P(child | father, mother) for all genotypes in PL order, indexed (father, mother, child)."""
    gts = [(a, b) for b in range(alleles) for a in range(b + 1)]
    return np.array([[[mendelian_prior(f, m, c, novel) for c in gts] for m in gts] for f in gts])


def trio_genotypes(father: np.ndarray, mother: np.ndarray, child: np.ndarray, alleles: int = 2, novel: float = 1e-8) -> tuple:
    """The jointly most likely (father, mother, child) genotypes from likelihoods in PL order; the first of equals."""
    gts = [(a, b) for b in range(alleles) for a in range(b + 1)]
    joint = trio_prior(alleles, novel) * np.asarray(father)[:, None, None] * np.asarray(mother)[None, :, None] * np.asarray(child)[None, None, :]
    return tuple(gts[i] for i in np.unravel_index(int(joint.argmax()), joint.shape))


def trios(calls: DataFrame, families: DataFrame, novel: float = 1e-8) -> DataFrame:
    """(tid, p, sample, father, mother, gt, father_gt, mother_gt, mendelian) of called sites and families.

    ``calls`` hold samples with their likelihoods (pl) over the kept alleles; ``families`` a row a
    child. A child's row meets its parents' rows of the site by equi-joins; a site that lacks one of
    the three gives no row. mendelian: the child's genotype is one its parents can pass on.
    """
    people = calls.select("tid", "p", (F.size("alt") + 1).alias("alleles"), F.explode("samples").alias("s")).select("tid", "p", "alleles", F.col("s.sample").alias("sample"), F.col("s.pl").alias("pl"))
    side = lambda name: people.select("tid", "p", F.col("sample").alias(name), F.col("pl").alias(f"{name}_pl"))
    rows = people.join(families.select("sample", "father", "mother"), "sample").join(side("father"), ["tid", "p", "father"]).join(side("mother"), ["tid", "p", "mother"])

    def run(batches):
        for b in batches:
            lk = lambda x: 10.0 ** (-np.asarray(x, float) / 10)
            best = [trio_genotypes(lk(f), lk(m), lk(c), int(n), novel) for f, m, c, n in zip(b["father_pl"], b["mother_pl"], b["pl"], b["alleles"], strict=True)]
            text = lambda i: ["/".join(map(str, g[i])) for g in best]  # noqa: E731, B023
            fits = [mendelian_prior(*g, 0.0) > 0 for g in best]
            yield b[["tid", "p", "sample", "father", "mother"]].assign(gt=text(2), father_gt=text(0), mother_gt=text(1), mendelian=fits)

    return rows.mapInPandas(run, "tid int, p int, sample string, father string, mother string, gt string, father_gt string, mother_gt string, mendelian boolean")
