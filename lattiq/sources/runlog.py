"""Logs of experiment runs as tables.

A log is blocks of a head (``name : value`` lines), what the program printed, what ``time -v``
printed, and an end line.  The small parameter of a run is printed under either name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The lines of the log format, as patterns.  Case does not count.
BLOCK = r"(?s)={2,} *RUN *={2,}(.*?)={2,} *END OF RUN *={2,}"
NUMBER = r"([\d.]+(?:[eE][+-]?\d+)?)"
FIELDS = {
    "timestamp": (r"(?mi)^\s*timestamp\s*:\s*(.+?)\s*$", "string"),
    "dataset": (r"(?mi)^\s*dataset\s*:\s*(.+?)\s*$", "string"),
    "s": (r"(?mi)^\s*s\s*:\s*(\d+)\s*$", "int"),
    "r": (r"(?mi)^\s*r\s*:\s*(\d+)\s*$", "int"),
    "cmd": (r"(?mi)^\s*cmd\s*:\s*(.+?)\s*$", "string"),
    "n": (r"(?i)node size\s*:\s*(\d+)", "bigint"),
    "m": (r"(?i)edge size\s*:\s*(\d+)", "bigint"),
    "max_degree": (r"(?i)max degree\s*:\s*(\d+)", "bigint"),
    "max_clique": (r"(?i)max clique\s*:\s*(\d+)", "bigint"),
    "tree_build_ms": (r"(?i)tree\s*build\s*took\s*:\s*" + NUMBER + r"\s*ms", "double"),
    "clique_index_ms": (r"(?i)clique\s*index\s*build\s*took\s*:\s*" + NUMBER + r"\s*ms", "double"),
    "prog_time_ms": (r"(?i)(?:\btime\s*:|decomposition\s+took\s*:)\s*" + NUMBER + r"\s*ms\b", "double"),
    "num_leaves": (r"(?i)\bnu[nm]?\s*leaf\s*:\s*(\d+)", "bigint"),
    "max_rss_kb": (r"(?i)maximum resident set size \(kbytes\)\s*:\s*(\d+)", "bigint"),
    "exit_status": (r"(?i)exit[ _]status\s*:\s*(-?\d+)", "int"),
}
METRICS = ["tree_build_ms", "prog_time_ms", "num_leaves", "clique_index_ms", "max_rss_kb", "exit_status"]
TIMINGS = ["tree_build_ms", "clique_index_ms", "prog_time_ms"]
KILLED = r"(?i)command\s+terminated\s+by\s+signal"
ROUND = rf"(?i)minCore\s*:\s*{NUMBER}\s+heap size\s*:\s*(\d+)\s+num Leaf\s*:\s*(\d+)\s+(\d+)-Clique count\s*:\s*{NUMBER}"
HEAP = rf"(?i)minCore\s*:\s*{NUMBER}\s*,\s*heap\s*size\s*:\s*(\d+)"
ENDINGS = r"(\.(edges|txt|graph|csv|gz|clean))+$"
SIZES = (20, 40, 60, 80, 100)
SIZED = r"[-_ (.]*p?(20|40|60|80|100)\s*%?\)?$"


def blocks(logs: DataFrame, text: str = "value") -> DataFrame:
    """``run, block`` beside the other columns: complete runs of whole log texts (E1).  A start
    without an end, and an end without a start, give none; null and empty texts give none."""
    keys = [c for c in logs.columns if c != text]
    # a start that meets another start before its end was cut off: the match is from the last one
    each = F.posexplode(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1))).alias("run", "block")
    last = F.element_at(F.split("block", r"={2,} *RUN *={2,}"), -1)
    return logs.select(*keys, each).withColumn("block", last)


def records(runs: DataFrame) -> DataFrame:
    """The fields of each block, null where missing.

    A run killed by a signal has exit status -1.  ``heap_series``: the short form of the peel
    loop's lines as ``array<struct<core, heap>>``, null if there are none.
    """
    out = []
    for name, (pattern, kind) in FIELDS.items():
        found = F.nullif(F.regexp_extract("block", pattern, 1), F.lit(""))
        value = found if kind == "string" else found.try_cast(kind)
        if name == "cmd":
            value = F.regexp_replace(value, r"\s+", " ")
        if name == "exit_status":
            value = F.when(F.col("block").rlike(KILLED), F.lit(-1)).otherwise(value)
        out.append(value.alias(name))
    lines = F.regexp_extract_all("block", F.lit(HEAP), F.lit(0))
    part = lambda x, i, kind: F.regexp_extract(x, HEAP, i).try_cast(kind)
    series = F.transform(lines, lambda x: F.struct(part(x, 1, "double").alias("core"), part(x, 2, "bigint").alias("heap")))
    out.append(F.when(F.size(lines) > 0, series).alias("heap_series"))
    return runs.select(*[c for c in runs.columns if c != "block"], *out)


def rounds(runs: DataFrame) -> DataFrame:
    """Rows of the peel loop (E6): level, heap, leaves, clique size and count; level and count are
    doubles, as they may be printed in powers of ten."""
    line = F.posexplode(F.regexp_extract_all("block", F.lit(ROUND), F.lit(0))).alias("round", "line")
    rows = runs.select(*[c for c in runs.columns if c != "block"], line)
    part = lambda i, kind: F.regexp_extract("line", ROUND, i).try_cast(kind)
    return rows.select("*", part(1, "double").alias("level"), part(2, "bigint").alias("heap"), part(3, "bigint").alias("leaves"), part(4, "int").alias("size"), part(5, "double").alias("cliques")).drop("line")


def normalised(rows: DataFrame) -> DataFrame:
    """The smaller parameter as ``r``, the larger as ``s``."""
    return rows.withColumns({"r": F.least("r", "s"), "s": F.greatest("r", "s")})


def most_complete(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: most of ``METRICS`` there, then the earliest timestamp."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in METRICS if c in rows.columns), F.lit(0))
    w = Window.partitionBy(*keys).orderBy(filled.desc(), F.col("timestamp").asc_nulls_last())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with their number (E5)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("runs")).where("runs > 1")


def of_parameter(rows: DataFrame, r: int) -> DataFrame:
    """The sub-table of one small parameter, by data set and the other parameter (E5)."""
    return rows.where(F.col("r") == r).drop("r")


def write_csv(rows: DataFrame, path: str) -> None:
    """Flat columns as CSV with a header (E5)."""
    flat = [c for c, kind in rows.dtypes if not kind.startswith(("array", "struct", "map"))]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def seconds(c: str) -> Column:
    """``h:mm:ss``, ``m:ss`` or seconds (E7); null where a part is no number."""
    return F.aggregate(F.transform(F.split(c, ":"), lambda x: x.try_cast("double")), F.lit(0.0), lambda a, x: a * 60 + x)


def nice_name(c: str) -> Column:
    """The last part of a path without known endings."""
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), ENDINGS, "")


def pair_code(c: str) -> Column:
    """``34`` to (3, 4) and ``114`` to (1, 14): the first digit, then the rest (E8); null if there
    are not two digits."""
    good = F.col(c).rlike(r"^\d{2,}$")
    part = lambda i, n: F.when(good, F.substring(c, i, n)).try_cast("int")
    return F.struct(part(1, 1).alias("r"), part(2, 99).alias("s"))


def total_ms(*parts: str, least: int = 2) -> Column:
    """The sum of the parts that are there, null under ``least`` of them."""
    there = sum((F.col(p).isNotNull().cast("int") for p in parts), F.lit(0))
    return F.when(there >= least, sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts), F.lit(0.0)))


def measured(rows: DataFrame) -> DataFrame:
    """``ms``: the whole time, null for failed runs; ``mb``: memory."""
    ok = F.coalesce(F.col("exit_status"), F.lit(0)) == 0
    return rows.withColumns({"ms": F.when(ok, total_ms(*TIMINGS)), "mb": F.col("max_rss_kb") / 1024})


def best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Least time and least memory per key, each by itself; failed runs count as null."""
    ok = F.coalesce(F.col("exit_status"), F.lit(0)) == 0
    least = lambda c: F.min(F.when(ok, F.col(c)))
    return rows.groupBy(*keys).agg(least("prog_time_ms").alias("ms"), least("max_rss_kb").alias("kb"), F.count("*").alias("runs"))


def speedups(rows: DataFrame, keys: list[str], ours: str, theirs: str) -> DataFrame:
    """Least times by ``source`` in columns and the per cent saved."""
    wide = rows.groupBy(*keys).pivot("source", [ours, theirs]).agg(F.min("ms"))
    return wide.withColumn("saved_percent", 100 * (F.col(theirs) - F.col(ours)) / F.col(theirs))


def size_suffix(c: str) -> Column:
    """20, 40, 60, 80 or 100 at the end of a name (``x-20``, ``x_20``, ``x(20)``, ``x-20%``,
    ``x.p20``), 100 if none (E12)."""
    return F.coalesce(F.nullif(F.regexp_extract(c, SIZED, 1), F.lit("")).try_cast("int"), F.lit(100))


def base_name(c: str) -> Column:
    """A name without its size and what follows the first dot."""
    return F.element_at(F.split(F.regexp_replace(c, SIZED, ""), r"\."), 1)


def best_per_size(rows: DataFrame, keys: list[str], size: str = "size") -> DataFrame:
    """Per key and size the run of least time (``ms``), with its memory (``mb``); where no run has
    a time, one of them with null (E12)."""
    order = F.struct(F.col("ms").isNull(), F.col("ms"), F.col("mb").isNull(), F.col("mb"))
    first = F.min_by(F.struct("ms", "mb"), order)
    return rows.where(F.col(size).isin(*SIZES)).groupBy(*keys, size).agg(first.alias("_x")).select(*keys, size, "_x.ms", "_x.mb")


def filled_at_full_size(rows: DataFrame, keys: list[str], parameter: str = "s", size: str = "size") -> DataFrame:
    """Rows of the full size that have no ``parameter`` are given each one that their key has
    elsewhere, without a time (J12); a row that is there already stays as it is."""
    grid = rows.where(F.col(parameter).isNotNull()).select(*keys, parameter).distinct()
    lone = rows.where((F.col(size) == 100) & F.col(parameter).isNull()).select(*keys).distinct()
    asked = lone.join(grid, keys, "left").where(F.col(parameter).isNotNull())
    there = rows.where(F.col(size) == 100).select(*keys, parameter).distinct()
    new = asked.join(there, [*keys, parameter], "left_anti").withColumn(size, F.lit(100))
    return rows.where(F.col(parameter).isNotNull()).unionByName(new, allowMissingColumns=True)
