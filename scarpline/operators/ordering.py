"""Exact ranks inside groups of any size.

A plain ``row_number() over (partition by label order by key)`` puts a whole class into one task.
Here every group is first split into ordered buckets: bucket sizes are counted map-side, their
running totals give each bucket's offset, and the rank is offset + position inside the bucket. The
result equals the plain window; the largest task holds one bucket of one group.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000
_BUCKET, _OFFSET, _SIZE = "__bucket", "__offset", "__size"


def rank_in_buckets(df: DataFrame, groups: list[str], order: list[Column], bucket: str) -> DataFrame:
    """Adds ``rank`` (1-based) and ``group_size``; ``bucket`` must rise with ``order``.

    Rows with a null group keep their place in the result, unranked.
    """
    counts = df.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias(_SIZE))
    ordered = Window.partitionBy(*groups).orderBy(bucket)
    offsets = counts.select(
        *groups,
        bucket,
        (F.sum(_SIZE).over(ordered) - F.col(_SIZE)).alias(_OFFSET),
        F.sum(_SIZE).over(Window.partitionBy(*groups)).alias("group_size"),
    )
    position = F.row_number().over(Window.partitionBy(*groups, bucket).orderBy(*order))
    ranked = df.withColumn("__position", position)
    return (
        ranked.join(offsets, [*groups, bucket], "left")
        .withColumn("rank", F.col(_OFFSET) + F.col("__position"))
        .drop(bucket, _OFFSET, "__position")
    )


def shuffled_rank(
    df: DataFrame, group: str, key: str, seed: int | None = None, digits: int = 3
) -> DataFrame:
    """Rank inside ``group`` by the md5 of the key: a repeatable shuffle.

    The first ``digits`` hex digits of the hash split every group evenly into 16^digits buckets; the
    ranks do not depend on their number. Raise it where a class holds more than some 10^10 rows.
    """
    text = F.col(key).cast("string")
    if seed is not None:
        text = F.concat(F.lit(f"{seed}:"), text)
    hashed = df.withColumn("__md5", F.md5(text)).withColumn(_BUCKET, F.substring("__md5", 1, digits))
    order = [F.col("__md5"), F.col(key)]
    return rank_in_buckets(hashed, [group], order, _BUCKET).drop("__md5")


def ordered_rank(
    df: DataFrame, group: str, key: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Rank inside ``group`` by a numeric key; buckets follow approximate quantiles of the key.

    The quantiles only decide how even the buckets are, never the ranks. Their number follows the
    table without a limit, so no task sorts much more than ``rows_per_bucket`` rows.
    """
    buckets = df.count() // rows_per_bucket + 2
    cuts = df.select(F.col(key).cast("double").alias(key)).approxQuantile(
        key, [i / buckets for i in range(1, buckets)], 1.0 / (4 * buckets)
    )
    if cuts:
        splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
        bucketed = Bucketizer(splits=splits, inputCol="__key", outputCol=_BUCKET).transform(
            df.withColumn("__key", F.col(key).cast("double"))
        ).drop("__key")
    else:  # no row, or no row with a key
        bucketed = df.withColumn(_BUCKET, F.lit(0.0))
    return rank_in_buckets(bucketed, [group], [F.col(key)], _BUCKET)
