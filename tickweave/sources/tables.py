"""Scans of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet table ``name`` of ``folder``; projection and filters reach the scan through Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
