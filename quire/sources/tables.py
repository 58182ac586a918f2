"""Readers for the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of the folder; columns are pruned and filters pushed by the plan that uses it."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
