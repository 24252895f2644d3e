"""Merging the feature ranks of several models into one ranking.

``importances`` is the long table (model, feature, importance, rank) and ``scores`` the table
(model, cv_score); with ``by`` both carry further grouping columns, e.g. ``dataset``, and one job
ranks all groups. The tables are as long as features x models, so the windows here are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scarpline import schema as S
from scarpline.functions import min_max_score
from scarpline.session import broadcast_if_small


def rank_importances(
    importances: DataFrame, by: list[str] | None = None, value: str = "importance"
) -> DataFrame:
    """Dense sequence 1..n per model by falling importance, ties by feature name."""
    order = Window.partitionBy(*(by or []), "model").orderBy(F.desc(value), F.asc("feature"))
    return importances.withColumn("rank", F.row_number().over(order))


def percent_importances(importances: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Importances as percent of their model's sum."""
    total = F.sum("importance").over(Window.partitionBy(*(by or []), "model"))
    return importances.withColumn("importance", F.try_divide(F.col("importance"), total) * 100)


def select_by_mean(importances: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Features at least as important as the mean of their model."""
    mean = F.avg("importance").over(Window.partitionBy(*(by or []), "model"))
    return importances.withColumn("__mean", mean).filter(F.col("importance") >= F.col("__mean")) \
        .drop("__mean")


def all_features(importances: DataFrame, by: list[str] | None = None) -> DataFrame:
    return importances.select(*(by or []), "feature").distinct()


def linear_weights(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Score share of each model."""
    total = F.sum("cv_score").over(Window.partitionBy(*(by or [])))
    return scores.withColumn("weight", F.col("cv_score") / total)


def softmax_weights(
    scores: DataFrame, by: list[str] | None = None, sharpness: float = S.SOFTMAX_SHARPNESS
) -> DataFrame:
    """Weights growing exponentially with the score; the best score is taken out for safety."""
    group = Window.partitionBy(*(by or []))
    raised = F.exp(sharpness * (F.col("cv_score") - F.max("cv_score").over(group)))
    return scores.withColumn("__e", raised).withColumn(
        "weight", F.col("__e") / F.sum("__e").over(group)
    ).drop("__e")


def dense_ranks(
    importances: DataFrame, by: list[str] | None = None, absent: str = "model"
) -> DataFrame:
    """Every feature with every model: (feature, model, rank, seen).

    A feature a model did not list takes the worst rank: one more than that model's own length
    (``absent="model"``), or than the largest rank of all models (``absent="global"``).
    """
    by = by or []
    # Read three times below, and at most features x models long: evaluate it once.
    importances = broadcast_if_small(importances)
    lengths = importances.groupBy(*by, "model").agg(
        F.count(F.lit(1)).alias("__length"), F.max("rank").alias("__worst")
    )
    # One array with an entry per model stands for the list of models of a group.
    models = lengths.groupBy(*by).agg(
        F.collect_list(F.struct("model", "__length")).alias("__models"),
        F.max("__worst").alias("__worst"),
    )
    features = all_features(importances, by)
    if by:
        scaffold = features.join(models, by)
    else:
        scaffold = features.withColumn("__k", F.lit(0)).join(
            models.withColumn("__k", F.lit(0)), "__k"
        ).drop("__k")
    scaffold = scaffold.withColumn("__m", F.explode("__models")).select(
        *by, "feature", F.col("__m.model").alias("model"),
        F.col("__m.__length").alias("__length"), "__worst",
    )
    known = importances.select(*by, "feature", "model", F.col("rank").alias("__rank"))
    worst = F.col("__length") if absent == "model" else F.col("__worst")
    return scaffold.join(known, [*by, "feature", "model"], "left").select(
        *by, "feature", "model",
        F.coalesce(F.col("__rank"), worst + 1).cast("double").alias("rank"),
        F.col("__rank").isNotNull().alias("seen"),
    )


def weighted_mean_rank(
    importances: DataFrame, scores: DataFrame, by: list[str] | None = None
) -> DataFrame:
    """(feature, weighted_mean_rank, final_rank), best first."""
    by = by or []
    weights = linear_weights(scores, by).select(*by, "model", "weight")
    merged = dense_ranks(importances, by).join(weights, [*by, "model"])
    means = merged.groupBy(*by, "feature").agg(
        (F.sum(F.col("weight") * F.col("rank")) / F.sum("weight")).alias("weighted_mean_rank")
    )
    order = Window.partitionBy(*by).orderBy("weighted_mean_rank", "feature")
    return means.withColumn("final_rank", F.row_number().over(order)).orderBy(*by, "final_rank")


def consensus_rank(
    importances: DataFrame, scores: DataFrame, by: list[str] | None = None
) -> DataFrame:
    """(feature, agg_rank, consensus_score, selection_freq), best first."""
    by = by or []
    weights = softmax_weights(scores, by).select(*by, "model", "weight")
    merged = dense_ranks(importances, by, absent="global").join(weights, [*by, "model"])
    ranks = merged.groupBy(*by, "feature").agg(
        F.sum(F.col("weight") * F.col("rank")).alias("agg_rank"),
        F.avg(F.col("seen").cast("double")).alias("selection_freq"),
    )
    group = Window.partitionBy(*by)
    score = min_max_score(
        F.col("agg_rank"), F.min("agg_rank").over(group), F.max("agg_rank").over(group)
    )
    return ranks.withColumn("consensus_score", score).select(
        *by, "feature", "agg_rank", "consensus_score", "selection_freq"
    ).orderBy(*by, F.desc("consensus_score"), "feature")


def ranking_summary(ranking: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of features and the first and last of each ranking."""
    order = F.col("final_rank")
    return ranking.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("features_ranked"),
        F.min_by("feature", order).alias("best_feature"),
        F.min_by("weighted_mean_rank", order).alias("best_rank"),
        F.max_by("feature", order).alias("worst_feature"),
        F.max_by("weighted_mean_rank", order).alias("worst_rank"),
    )


def top_features(ranking: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k best lines of a ranking, or of each ranking with ``by``."""
    if not by:
        return ranking.orderBy("final_rank").limit(k)
    return ranking.filter(F.col("final_rank") <= k)


def top_importances(importances: DataFrame, k: int, value: str = "importance") -> DataFrame:
    return importances.orderBy(F.desc(value), "feature").limit(k)


def union_features(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("feature").union(right.select("feature")).distinct()


def shared_features(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("feature").intersect(right.select("feature"))
