"""What the operators of this package share: Arrow batches in, record batches out."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of a batch that goes to Python.  Spark's own bound, of 64 MB and 10,000 rows, is too much
#: for a worker that makes objects of the rows.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Bound the batches of the session by bytes, unless its user has set a bound of their own."""
    if spark.conf.get(_BATCH_CONF) == "67108864b":
        spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")


def given_back() -> None:
    """Return freed memory to the system: workers live on after their tasks, beside those of others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, and memory given back at the end of a task."""
    bounded(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            given_back()

    return df.mapInArrow(task, schema)


def arrow_schema(ddl: str) -> tuple[StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _parse_datatype_string(ddl)
    return schema, to_arrow_schema(schema)


def mapped(df: DataFrame, make: Callable[[], Callable[[list[pa.Array]], Iterator[list]]], ddl: str) -> DataFrame:
    """``mapInArrow`` over the columns of ``df``.  ``make`` runs once per task and returns a
    function from the columns of a batch to lists of columns in the order of ``ddl``."""
    schema, arrow = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = make()
        for batch in batches:
            if batch.num_rows:
                for columns in rows(batch.columns):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return arrow_mapped(df, run, schema)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def streamed_groups(df: DataFrame, key: list[str], order: list[str], rest: list[str], fn: Callable, ddl: str) -> DataFrame:
    """Rows of ``df`` dealt by ``key`` and sorted; ``fn(key, rows)`` yields output tuples of each
    group.  Unlike a grouped map it costs nothing per group but the call."""
    schema, arrow = arrow_schema(ddl)
    n = len(key)

    def run(batches):
        out: list[tuple] = []
        now, rows = None, []

        def batch():
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:n] != now:
                    if rows:
                        out += fn(now, rows)
                        if len(out) > 20_000:
                            yield batch()
                    now, rows = row[:n], []
                rows.append(row[n:])
        if rows:
            out += fn(now, rows)
        yield batch()

    dealt = df.repartition(partitions(df), *key).sortWithinPartitions(*key, *order)
    return arrow_mapped(dealt.select(*key, *rest), run, schema)
