from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read ``<root>/<name>.parquet``, one file or a directory of part files."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
