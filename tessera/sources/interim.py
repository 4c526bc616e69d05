"""Interim tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. In local mode, where driver and tasks share a disk, a folder of our own if that is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "folder" not in _OWN:
            _OWN["folder"] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        conf = _OWN["folder"]
    return conf


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a parquet table in the shared folder: lineage ends here and lost executors cost nothing before it.

    Shuffle files of this write go with it. A table stays until the application ends or discard() removes it, as lazy results
    may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._written)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
