"""Shared helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, names: list[str] | dict[str, int], digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; ``+ 0.0`` folds a negative zero."""
    wanted = names if isinstance(names, dict) else dict.fromkeys(names, digits)
    return df.withColumns({n: F.round(F.col(f"`{n}`"), d) + F.lit(0.0) for n, d in wanted.items()})
