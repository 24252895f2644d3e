"""Stratified folds and splits, assigned by exact distributed ranks inside each class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline import schema as S
from scarpline.operators.ordering import ordered_rank, shuffled_rank


def shuffled_folds(
    df: DataFrame,
    label: str = S.TARGET,
    key: str = S.ROW_ID,
    n_folds: int = S.N_FOLDS,
    seed: int | None = None,
) -> DataFrame:
    """``fold`` 0..n-1, dealt round-robin over each class in hash order of the unique key."""
    ranked = shuffled_rank(df, label, key, seed)
    fold = F.pmod(F.col("rank") - 1, F.lit(n_folds)).cast("int")
    return ranked.withColumn("fold", fold).drop("rank", "group_size")


def contiguous_folds(
    df: DataFrame, label: str = S.TARGET, key: str = S.ROW_ID, n_folds: int = S.N_FOLDS
) -> DataFrame:
    """``fold`` 0..n-1 as equal runs of each class in key order, the longer runs first."""
    ranked = ordered_rank(df, label, key)
    position = F.col("rank") - 1
    short = F.expr(f"group_size div {n_folds}")
    extra = F.pmod(F.col("group_size"), F.lit(n_folds))
    in_long = position < (short + 1) * extra
    fold = F.when(in_long, F.floor(position / (short + 1))).otherwise(
        extra + F.floor(F.try_divide(position - (short + 1) * extra, short))
    )
    return ranked.withColumn("fold", fold.cast("int")).drop("rank", "group_size")


def stratified_split(
    df: DataFrame,
    label: str = S.TARGET,
    key: str = S.ROW_ID,
    test_share: float = S.TEST_SHARE,
    seed: int | None = None,
) -> DataFrame:
    """``is_test`` for the first ``test_share`` of each class in hash order of the unique key."""
    ranked = shuffled_rank(df, label, key, seed)
    relative = F.coalesce(
        F.try_divide(F.col("rank") - 1, F.col("group_size") - 1), F.lit(0.0)
    )
    return ranked.withColumn("is_test", relative < test_share).drop("rank", "group_size")
