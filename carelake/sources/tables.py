"""Stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Parquet table ``<base_dir>/<name>.parquet`` (a file or a folder, in any store)."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")
