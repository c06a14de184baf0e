"""Edge tables: from text, from the driver's tables, from generators; and text sinks.

An edge table is ``src long, dst long`` with ``src < dst``, each pair once.
"""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lattiq import scratch


def canonical(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Undirected simple edges: no loops, the lesser end first, no repeats."""
    u, v = F.col(a), F.col(b)
    return pairs.where(u != v).select(F.least(u, v).alias("src"), F.greatest(u, v).alias("dst")).distinct()


def _fields(lines: DataFrame, separator: str) -> DataFrame:
    text = F.trim(F.regexp_replace("value", r"\r$", ""))
    return lines.select(text.alias("line")).where("line <> '' and not line like '#%' and not line like '\\%%'").select(F.split("line", separator).alias("f"), "line")


def parse_edges(lines: DataFrame, separator: str = r"[\s,]+", header: bool = False, strict: bool = False) -> DataFrame:
    """Edges of a table of lines (``value``): comments, blank lines and further columns are
    skipped (S1).

    ``header``: the first line gives ``n`` and maybe ``m``, and is no edge; an equal line further
    on is one.  ``strict`` (S2, S3) fails on a line without two whole numbers, on a loop, and on
    an id that is negative or, with a header, not less than ``n``.
    """
    rows, n = _fields(lines, separator), None
    if header:
        first = rows.first()
        if first is not None:
            same = F.col("line") == first["line"]
            if rows.where(same).limit(2).count() == 1:  # of equal lines one is left: an edge counts once
                rows = rows.where(~same)
            n = int(first["f"][0]) if first["f"][0].isdigit() else None
    ends = rows.select(*[F.expr(f"try_cast(try_element_at(f, {i + 1}) as bigint)").alias(c) for i, c in enumerate(("src", "dst"))], "line")
    if strict:
        bad = F.col("src").isNull() | F.col("dst").isNull() | (F.col("src") == F.col("dst")) | (F.least("src", "dst") < 0)
        if n is not None:
            bad = bad | (F.greatest("src", "dst") >= n)
        ends = ends.withColumn("src", F.when(bad, F.raise_error(F.concat(F.lit("not an edge: "), "line"))).otherwise(F.col("src")))
    return canonical(ends.where("src is not null and dst is not null"))


def parse_named(lines: DataFrame, separator: str = r"\s+") -> DataFrame:
    """``a string, b string``: ends as they are written, of lines with two of them at least (S4);
    repeated lines stay, so their number is that of raw edges."""
    rows = _fields(lines, separator).where(F.size("f") >= 2)
    return rows.select(F.col("f")[0].alias("a"), F.col("f")[1].alias("b"))


def read_edges(spark: SparkSession, path: str, **how) -> DataFrame:
    return parse_edges(spark.read.text(path), **how)


def vertices(edges: DataFrame, n: int | None = None) -> DataFrame:
    """Ids with an edge; or ``0 .. n - 1``, so isolated ones appear as well."""
    if n is not None:
        return edges.sparkSession.range(n).select("id")
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def numbered(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with their place from 0 in the order of some columns, without one task for all:
    range partitions are sorted, and their sizes, a row a partition, give where each begins.
    The order should be total; equal rows come in any order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = scratch.written(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_begin")))
    return dealt.withColumn("_part", part).join(begins, "_part").withColumn(name, (F.col("_begin") + place).cast("long")).drop("_at", "_part", "_begin")


def dense_ids(pairs: DataFrame, order: str, a: str = "a", b: str = "b") -> tuple[DataFrame, DataFrame]:
    """String ends to numbers from 0 in order of first appearance, ties by name (S5): ``(name, id)`` and edges."""
    seen = pairs.select(order, F.posexplode(F.array(a, b)).alias("side", "name"))
    firsts = seen.groupBy("name").agg(F.min(F.struct(order, "side")).alias("first"))
    ids = numbered(firsts, ["first", "name"], "id").select("name", "id")
    x, y = ids.alias("x"), ids.alias("y")
    ends = pairs.join(x, pairs[a] == F.col("x.name")).join(y, pairs[b] == F.col("y.name"))
    return ids, canonical(ends.select(F.col("x.id").alias("src"), F.col("y.id").alias("dst")))


def defects(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Loops and repeated pairs of a raw table, as one row."""
    loops = F.sum((F.col(a) == F.col(b)).cast("long"))
    each = pairs.groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.count("*").alias("k"), loops.alias("l"))
    return each.agg(F.sum("k").alias("n_rows"), F.sum("l").alias("n_loops"), F.sum(F.when(F.col("u") != F.col("v"), F.col("k") - 1).otherwise(0)).alias("n_repeats"))


def random_graph(spark: SparkSession, n: int, p: float, seed: int = 42) -> DataFrame:
    """Each pair with probability ``p`` (S8).  Gaps between chosen pairs are drawn per vertex, so
    work follows the edges, not the pairs."""

    def rows(batches):
        for pdf in batches:
            out = []
            for u in pdf["id"]:
                r, v = random.Random(seed * 1_000_003 + int(u)), int(u)
                while p > 0 and v < n:
                    v += 1 if p >= 1 else 1 + int(math.log(1 - r.random()) / math.log(1 - p))
                    if v < n:
                        out.append((int(u), v))
            yield pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return spark.range(n).mapInPandas(rows, "src long, dst long")


def weighted_graph(spark: SparkSession, n: int, m: int, sigma: float = 1.0, seed: int = 1) -> DataFrame:
    """Edges whose ends are drawn by log-normal weights (S7); ``m`` is jittered by 0.9 to 1.2.

    A sample without replacement, by the product of the ends' weights: each pair draws an
    exponential time of that rate, and the first pairs are taken.  So the work follows the pairs,
    and a nearly complete graph costs no more than another.
    """
    want = min(n * (n - 1) // 2, int(m * random.Random(seed).uniform(0.9, 1.2)))

    def rows(batches):
        for pdf in batches:
            for u in map(int, pdf["id"]):
                rest = n - u - 1
                if rest <= 0:
                    continue
                weights = np.exp(sigma * np.random.default_rng(seed).standard_normal(n))
                time = np.random.default_rng([seed, u]).exponential(size=rest) / (weights[u] * weights[u + 1 :])
                yield pd.DataFrame({"src": u, "dst": np.arange(u + 1, n), "time": time})

    pairs = spark.range(n).mapInPandas(rows, "src long, dst long, time double")
    return pairs.orderBy("time", "src", "dst").limit(want).select("src", "dst")


def uniform_graph(spark: SparkSession, n: int, m: int, seed: int = 12345) -> DataFrame:
    """``m`` different edges drawn evenly (S9): the first ``m`` numbers under a keyed permutation of
    all pairs, so none repeats, nothing is rejected and every row is made by itself."""
    total = n * (n - 1) // 2
    half = 1 << max(1, (max(total - 1, 1).bit_length() + 1) // 2)

    def shuffled(i: int) -> int:
        while True:  # a Feistel network over a square that has all pairs, walked until it is in range
            left, right = divmod(i, half)
            for r in range(6):
                digest = hashlib.blake2b(f"{seed}|{r}|{right}".encode(), digest_size=8).digest()
                left, right = right, (left + int.from_bytes(digest, "big")) % half
            i = left * half + right
            if i < total:
                return i

    def rows(batches):
        for pdf in batches:
            out = []
            for i in map(shuffled, map(int, pdf["id"])):
                v = (1 + math.isqrt(1 + 8 * i)) // 2  # pair (u, v) has the number v (v - 1) / 2 + u
                out.append((i - v * (v - 1) // 2, v))
            yield pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return spark.range(min(m, total)).mapInPandas(rows, "src long, dst long")


def write_edges(edges: DataFrame, path: str, separator: str = " ") -> None:
    edges.select(F.concat_ws(separator, "src", "dst").alias("value")).write.mode("overwrite").text(path)


def adjacency_lines(edges: DataFrame) -> DataFrame:
    """``id: neighbours`` lines."""
    return neighbours(edges).select(F.concat(F.col("id"), F.lit(": "), F.array_join(F.sort_array("adj"), " ")).alias("value"))


def degree_lines(histogram: DataFrame) -> DataFrame:
    """``degree, value``: how many vertices have each degree from 0 up, zeros included."""
    widest = histogram.agg(F.max("degree").alias("top"))
    every = widest.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("degree"))
    return every.join(histogram, "degree", "left").select("degree", F.coalesce("n", F.lit(0)).cast("string").alias("value"))


def count_lines(counts: DataFrame) -> DataFrame:
    """Lines of counts by size (S11): ``k, Ck`` of ``k, n``; ``(v, k): Ck`` of ``id, k, n``;
    ``(u, v, k): Ck`` of ``src, dst, k, n``.  Sizes that no clique has give no line."""
    keys = [c for c in ("id", "src", "dst", "k") if c in counts.columns]
    n = F.col("n").cast("string")
    line = F.concat_ws(", ", "k", n) if keys == ["k"] else F.concat(F.lit("("), F.concat_ws(", ", *keys), F.lit("): "), n)
    return counts.where("n <> 0").select(*keys, line.alias("value"))


def write_counts(counts: DataFrame, folder: str, graph: str, max_k: int | None = None) -> str:
    """Write :func:`count_lines` under the name of the graph, the largest size and the sort (S11);
    returns the path.  Lines stand by key, in range partitions."""
    sort = "A" if "id" not in counts.columns and "src" not in counts.columns else "V" if "id" in counts.columns else "E"
    path = f"{folder}/{graph}{f'_{max_k}' if max_k else ''}_{sort}.txt"
    lines = count_lines(counts)
    keys = [c for c in lines.columns if c != "value"]
    lines.orderBy(*keys).select("value").write.mode("overwrite").text(path)
    return path


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``k int, n decimal(38,0)`` of lines ``k, count`` (S14); other lines are skipped."""
    fields = F.split(F.trim("value"), r"\s*,\s*")
    lines = spark.read.text(path).where(F.trim("value").rlike(r"^\d+\s*,\s*\d"))
    return lines.select(fields[0].cast("int").alias("k"), fields[1].cast("decimal(38,0)").alias("n"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))).alias("e")).select("e.*")


def neighbours(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("u").alias("id")).agg(F.collect_list("v").alias("adj"))


def binomials(spark: SparkSession, n: int) -> DataFrame:
    """``n int, k int, c decimal(38,0)`` up to ``n`` (S16); its size is known from ``n``."""
    rows = [(i, j, math.comb(i, j)) for i in range(n + 1) for j in range(i + 1) if math.comb(i, j) < 10**38]
    return spark.createDataFrame([(i, j, str(c)) for i, j, c in rows], "n int, k int, c string").select("n", "k", F.col("c").cast("decimal(38,0)").alias("c"))


def part_coorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were returned in one order."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    return _paired(line, "l_orderkey", F.col("l_partkey"))


def user_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an event in the same minute."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_trunc("minute", "ts").alias("minute"), "user_id").distinct()
    return _paired(events, "minute", F.col("user_id"))


def _paired(rows: DataFrame, key: str, member: Column) -> DataFrame:
    x = rows.select(F.col(key).alias("k"), member.alias("src"))
    y = rows.select(F.col(key).alias("k"), member.alias("dst"))
    return x.join(y, "k").where("src < dst").select("src", "dst").distinct()
