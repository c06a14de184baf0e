"""Tables written to the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  Only where it is unset and Spark runs in
this one machine's process (tests, a laptop) a temporary folder takes its place.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="lattiq-")
        spark.sparkContext.setCheckpointDir(_own)
    return _own


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a reader of it.

    This cuts the lineage: after an executor is lost, later stages read files, not tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattiq/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lattiq_path = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing will read any more."""
    for df in tables:
        spark, path = df.sparkSession, df._lattiq_path
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def released(spark: SparkSession) -> None:
    """Let the driver drop shuffle files of finished jobs now rather than at its next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
