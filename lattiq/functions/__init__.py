"""Scalar functions on columns: subsets and numbers of cliques, the h-index of counted values."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, functions as F


def subsets(c: str, size: int, r: int) -> Column:
    """All sorted ``r``-subsets of a sorted array of known ``size``."""
    return F.array(*[F.array(*[F.col(c)[i] for i in x]) for x in combinations(range(size), r)])


def subsets_with(c: str, size: int, r: int, must: str) -> Column:
    """The ``r``-subsets of a sorted array that have a member of the array ``must``."""
    return F.filter(subsets(c, size, r), lambda x: F.arrays_overlap(x, F.col(must)))


def rank(c: str, size: int) -> Column:
    """Combinatorial number of a sorted tuple: the sum of C(c_i, i + 1) (F4), exact in decimals."""
    total = F.lit(0).cast("decimal(38,0)")
    for i in range(size):
        term = F.lit(1).cast("decimal(38,0)")
        for j in range(i + 1):  # the product of j + 1 consecutive numbers divides by (j + 1)!
            term = F.floor(term * (F.col(c)[i] - j) / F.lit(j + 1)).cast("decimal(38,0)")
        total = total + term
    return total.cast("decimal(38,0)")


def h_index(counted: str) -> Column:
    """Of an array of ``(value, n)``: the largest k with k values of at least k."""
    none = F.struct(F.lit(0).cast("long").alias("met"), F.lit(0).cast("long").alias("best"))

    def add(so_far: Column, x: Column) -> Column:
        met = so_far["met"] + x["n"]
        return F.struct(met.alias("met"), F.greatest(so_far["best"], F.least(x["value"], met)).alias("best"))

    return F.aggregate(F.sort_array(counted, asc=False), none, add, lambda x: x["best"])
