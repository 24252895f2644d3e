"""Exact quantiles, class medians and box-plot statistics without gathering a group in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scarpline import schema as S
from scarpline.operators.columns import quoted
from scarpline.session import broadcast_if_small

FAN_OUT = 1 << 16  # counts per group and prefix in one pass of a selection
_QUARTILES = [0.25, 0.5, 0.75]


def melt(
    df: DataFrame, features: list[str], target: str = S.TARGET,
    name: str = "Feature", value: str = "value",
) -> DataFrame:
    """(target, Feature, value) rows stacked over the features."""
    wide = df.select(quoted(target), *[quoted(f).cast("double").alias(f) for f in features])
    return wide.unpivot([quoted(target)], [quoted(f) for f in features], name, value)


@F.pandas_udf(T.LongType())
def ordered_bits(values: pd.Series) -> pd.Series:
    """64 bits of every double as an integer that sorts as the values do; both zeros are one."""
    bits = (values.to_numpy(dtype=np.float64) + 0.0).view(np.int64)
    return pd.Series(bits ^ (bits >> 63 & np.int64(0x7FFF_FFFF_FFFF_FFFF)))


@F.pandas_udf(T.DoubleType())
def from_ordered_bits(bits: pd.Series) -> pd.Series:
    plain = bits.to_numpy(dtype=np.int64)
    return pd.Series((plain ^ (plain >> 63 & np.int64(0x7FFF_FFFF_FFFF_FFFF))).view(np.float64))


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], fan_out: int = FAN_OUT
) -> DataFrame:
    """(keys, n, q0, q1, ...): linearly interpolated quantiles of ``value`` per group, exact.

    Radix descent on the ordered bits of the values. The first pass counts the rows of every group by
    the first bits; running sums show which prefix holds each wanted rank. Each later pass reads only
    rows with such a prefix and counts them by the next bits, until all 64 are known. Counts are combined
    map-side, at most ``fan_out`` per group and prefix, so no task sorts or holds the rows of a group,
    however many agree; all groups and quantiles share a pass. Rows with a null value or a null key
    belong to no group.
    """
    group = [quoted(k) for k in keys]
    rows = df.na.drop(subset=[value, *keys]).select(*group, ordered_bits(F.col(value).cast("double")).alias("__o"))

    def index(q: float) -> Column:
        return (F.col("n") - 1) * F.lit(float(q))

    wanted = F.array(*[
        F.struct(F.lit(i).alias("q"), F.lit(upper).alias("upper"),
                 F.least(F.floor(index(q)) + upper, F.col("n") - 1).alias("rank"))
        for i, q in enumerate(probs) for upper in (0, 1)
    ])

    def descended(counts: DataFrame, within: list[str], ranks: Column) -> DataFrame:
        """The ranks (q, upper, rank) of every prefix, each below the child prefix that holds it."""
        before = F.col("__upto") - F.col("__c")
        held = F.filter(ranks, lambda r: (r["rank"] >= before) & (r["rank"] < F.col("__upto")))
        running = Window.partitionBy(*within).orderBy("__child")
        placed = counts.withColumn("__upto", F.sum("__c").over(running)).select(
            *keys, "n", F.col("__child").alias("__p"),
            F.transform(held, lambda r: r.withField("rank", r["rank"] - before)).alias("ranks"))
        return placed.where(F.size("ranks") > 0)

    digit = max(fan_out.bit_length() - 1, 1)
    shift = 64 - digit
    counts = rows.groupBy(*group, F.shiftright("__o", shift).alias("__child")).agg(F.count(F.lit(1)).alias("__c"))
    counts = counts.withColumn("n", F.sum("__c").over(Window.partitionBy(*group)))
    found = descended(counts, keys, wanted)
    while shift:
        prefixes = broadcast_if_small(found)
        last, shift = shift, max(shift - digit, 0)
        inside = rows.withColumn("__p", F.shiftright("__o", last)).join(
            prefixes.select(*group, "__p"), [*keys, "__p"], "left_semi")
        counts = inside.groupBy(*group, "__p", F.shiftright("__o", shift).alias("__child")).agg(
            F.count(F.lit(1)).alias("__c"))
        found = descended(counts.join(prefixes, [*keys, "__p"]), [*keys, "__p"], F.col("ranks"))
    picked = found.select(*group, "n", from_ordered_bits("__p").alias("__v"), F.explode("ranks").alias("r")).groupBy(
        *group, "n").agg(*[
            F.max(F.when((F.col("r.q") == i) & (F.col("r.upper") == upper), F.col("__v"))).alias(f"__{i}_{upper}")
            for i in range(len(probs)) for upper in (0, 1)])
    return picked.select(*group, "n", *[
        (F.col(f"__{i}_0") + (F.col(f"__{i}_1") - F.col(f"__{i}_0")) * (index(q) - F.floor(index(q)))).alias(f"q{i}")
        for i, q in enumerate(probs)])


def class_medians(
    df: DataFrame, features: list[str], target: str = S.TARGET
) -> DataFrame:
    """(target, Feature, median), the heat-map data of the top features."""
    long = melt(df, features, target)
    return exact_quantiles(long, [target, "Feature"], "value", [0.5]).select(
        target, "Feature", F.col("q0").alias("median")
    )


def box_stats(
    df: DataFrame, features: list[str], target: str = S.TARGET, by_class: bool = False
) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 IQR and the outlier count per box."""
    keys = ["Feature", target] if by_class else ["Feature"]
    long = melt(df, features, target).filter(F.col("value").isNotNull()).select(*keys, "value")
    boxes = exact_quantiles(long, keys, "value", _QUARTILES).select(
        *keys, "n",
        F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"),
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        long.join(broadcast_if_small(boxes), keys)
        .groupBy(*keys, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )
