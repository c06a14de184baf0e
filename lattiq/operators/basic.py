"""Degrees, orders and set operations on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lattiq import scratch
from lattiq.sources.graphs import canonical, numbered, symmetric


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``id, degree``; with ``vertices``, isolated ones have 0 (A1)."""
    d = symmetric(edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))
    if vertices is None:
        return d
    return vertices.join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def graph_stats(edges: DataFrame) -> DataFrame:
    d = degrees(edges).agg(F.count("*").alias("n"), (F.sum("degree") / 2).cast("long").alias("m"), F.max("degree").alias("max_degree"))
    return d.withColumn("avg_degree", 2 * F.col("m") / F.col("n"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("n"))


def size_triple(edges: DataFrame) -> DataFrame:
    """Vertices, ends and wedges (A3)."""
    return degrees(edges).agg(F.count("*").alias("n"), F.sum("degree").alias("ends"), F.sum(F.expr("degree * (degree - 1) div 2")).alias("wedges"))


def over_degree(edges: DataFrame, least: int) -> DataFrame:
    return degrees(edges).agg(F.sum((F.col("degree") > least).cast("long")).alias("n"))


def degree_order(edges: DataFrame, ascending: bool = True) -> DataFrame:
    """``id, rank`` from 0; ties by id (O1)."""
    d = degrees(edges).withColumn("by", F.col("degree") if ascending else -F.col("degree"))
    return numbered(d, ["by", "id"]).select("id", "rank")


def degeneracy_order(edges: DataFrame, cores: DataFrame) -> DataFrame:
    """``id, rank`` by core, degree and id (O3).  Any total order gives equal counts."""
    return numbered(degrees(edges).join(cores, "id"), ["core", "degree", "id"]).select("id", "rank")


def random_order(edges: DataFrame, seed: int = 1) -> DataFrame:
    """By a seeded hash of the id, so it is the same for any layout."""
    ids = degrees(edges).select("id", F.xxhash64("id", F.lit(seed)).alias("h"))
    return numbered(ids, ["h", "id"]).select("id", "rank")


def bfs_order(edges: DataFrame) -> DataFrame:
    """``id, root, depth, rank``: breadth first from the least id of each component, last first (O2)."""
    from .components import components

    both = scratch.written(symmetric(edges), "bfs")
    roots = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("node").alias("id"), F.col("label").alias("root"))
    seen = scratch.written(roots.where("id = root").withColumn("depth", F.lit(0)), "bfs")
    depth = 0
    while True:
        step = seen.where(F.col("depth") == depth).join(both, F.col("id") == F.col("u")).select(F.col("v").alias("id"), "root", F.lit(depth + 1).alias("depth")).distinct()
        new = scratch.written(step.join(seen.select("id"), "id", "left_anti"), "bfs")
        if not new.head(1):
            break
        seen, depth = scratch.written(seen.unionByName(new), "bfs"), depth + 1
    down = seen.select("*", *[(-F.col(c)).alias(f"_{c}") for c in ("root", "depth", "id")])
    return numbered(down, ["_root", "_depth", "_id"]).select("id", "root", "depth", "rank")


def oriented(edges: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """``u, v`` from the lower to the higher rank (P3, O5); without an order by degree, then id."""
    if order is None:
        d = degrees(edges)
        order = d.select("id", F.struct("degree", "id").alias("rank"))
    x = order.select(F.col("id").alias("src"), F.col("rank").alias("r1"))
    y = order.select(F.col("id").alias("dst"), F.col("rank").alias("r2"))
    e = edges.join(x, "src").join(y, "dst")
    up = F.col("r1") < F.col("r2")
    return e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"))


def dag_degrees(dag: DataFrame) -> DataFrame:
    """``id, n_in, n_out`` of oriented edges."""
    ends = dag.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("v").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.i").alias("n_in"), F.sum("x.o").alias("n_out"))


def relabelled(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Edges on ranks."""
    x = order.select(F.col("id").alias("src"), F.col("rank").alias("a"))
    y = order.select(F.col("id").alias("dst"), F.col("rank").alias("b"))
    return canonical(edges.join(x, "src").join(y, "dst"), "a", "b")


def contains(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``is_edge`` (P7); either direction."""
    found = edges.select("src", "dst", F.lit(True).alias("is_edge"))
    p = pairs.withColumns({"_a": F.least("src", "dst"), "_b": F.greatest("src", "dst")})
    joined = p.join(found.withColumnsRenamed({"src": "_a", "dst": "_b"}), ["_a", "_b"], "left")
    return joined.select("src", "dst", F.coalesce("is_edge", F.lit(False)).alias("is_edge"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def end_minima(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Each edge's value is the lesser of its ends' (``id, value``)."""
    x = values.select(F.col("id").alias("src"), F.col("value").alias("a"))
    y = values.select(F.col("id").alias("dst"), F.col("value").alias("b"))
    return edges.join(x, "src").join(y, "dst").select("src", "dst", F.least("a", "b").alias("value"))


def vertex_maxima(valued: DataFrame) -> DataFrame:
    """Each vertex's value is the largest of its edges' (A16)."""
    return valued.select(F.explode(F.array("src", "dst")).alias("id"), "value").groupBy("id").agg(F.max("value").alias("value"))
