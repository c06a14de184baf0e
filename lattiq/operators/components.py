"""Connected components of an edge table, without gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lattiq import scratch


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of each node of ``edges`` (``a, b``): the least node it can reach.

    Rounds of least label among neighbours and of pointer jumping, until nothing changes; each
    round is a written table.  All reductions combine on the map side, and the joins are plain
    two-sided ones that adaptive execution splits where a node has very many neighbours.
    """
    both = scratch.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    now = scratch.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = now.join(near, now["node"] == near["a"]).select("node", "label", F.least("label", "m").alias("new"))
        step = scratch.written(step, "labels")
        far = step.select(F.col("node").alias("at"), F.col("new").alias("jump"))
        jumped = step.join(far, step["new"] == far["at"], "left")
        jumped = jumped.select("node", F.least("new", "jump").alias("label"), (F.least("new", "jump") != F.col("label")).alias("changed"))
        jumped = scratch.written(jumped, "labels")
        more = bool(jumped.where("changed").head(1))
        scratch.dropped(now, step)
        now = jumped
        if not more:
            scratch.dropped(both)
            return now.select("node", "label")
