"""k-cliques by joins, and what is counted on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lattiq.functions import rank, subsets

from .basic import oriented


def k_cliques(edges: DataFrame, k: int, order: DataFrame | None = None) -> DataFrame:
    """``c array<long>`` (sorted ids) of each ``k``-clique, once.

    A clique grows along an orientation by degree: its candidates are the common forward
    neighbours, so a step is one equi-join with the adjacency of the vertex added last, and the
    lists are bounded by the out-degree, not the degree.
    """
    if k < 2:
        raise ValueError("k is at least 2")
    dag = oriented(edges, order)
    adj = dag.groupBy("u").agg(F.collect_list("v").alias("adj"))
    rows = adj.select(F.array("u").alias("c"), F.explode("adj").alias("last"), F.col("adj").alias("left"))
    for size in range(2, k):
        nxt = adj.select(F.col("u").alias("last"), "adj")
        rows = rows.join(nxt, "last").select(F.concat("c", F.array("last")).alias("c"), F.array_intersect("left", "adj").alias("left"))
        rows = rows.where(F.size("left") >= k - size).select("c", F.explode("left").alias("last"), "left")
    return rows.select(F.sort_array(F.concat("c", F.array("last"))).alias("c"))


def numbering_faults(cliques: DataFrame, c: str, size: int) -> DataFrame:
    """One row: how many cliques there are, how many numbers :func:`rank` gives them, and how many
    numbers stand for two (F9); without a fault the first two are equal and the last is 0."""
    each = cliques.select(c).distinct().groupBy(rank(c, size).alias("number")).agg(F.count("*").alias("k"))
    return each.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("cliques"), F.count("*").alias("numbers"), F.coalesce(F.sum((F.col("k") > 1).cast("long")), F.lit(0)).alias("shared"))


def incidence(cliques: DataFrame, s: int, r: int) -> DataFrame:
    """``s_id array, rc array``: which ``r``-cliques lie in which ``s``-clique."""
    return cliques.select(F.col("c").alias("s_id"), F.explode(subsets("c", s, r)).alias("rc"))


def count_cliques(edges: DataFrame, k: int) -> DataFrame:
    return k_cliques(edges, k).agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n")


def per_subset(edges: DataFrame, k: int, r: int) -> DataFrame:
    """``rc, n``: ``k``-cliques around each ``r``-clique that lies in one."""
    return incidence(k_cliques(edges, k), k, r).groupBy("rc").agg(F.count("*").alias("n"))
