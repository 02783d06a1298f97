"""Reading the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of the library; `root` is a directory of `<name>.parquet` files or folders."""
    return spark.read.parquet(f"{root}/{name}.parquet")
