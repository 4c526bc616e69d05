"""Columnar inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table by any path that Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
