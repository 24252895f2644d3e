"""The complete analysis: datasets, selection, models, rankings and the data behind the plots."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline import schema as S
from scarpline.operators import models, ranking
from scarpline.operators.columns import clean_for_evaluation
from scarpline.operators.distribution import box_stats, class_medians
from scarpline.plans.datasets import (
    Datasets, OptimizedPair, model_features, optimize_both, prepare, prepare_datasets,
)
from scarpline.sources import save_analysis

DATASET_A, DATASET_B = "no_nans", "optimal"
PLOT_FEATURES = {DATASET_A: 6, DATASET_B: 8}


@dataclass(frozen=True)
class PlotData:
    """Tables that a drawing tool needs: boxes, medians, drop importances."""

    boxes: DataFrame
    class_boxes: DataFrame
    medians: DataFrame
    drop_importances: DataFrame


@dataclass(frozen=True)
class Analysis:
    datasets: Datasets
    optimized: OptimizedPair
    basic: dict[str, DataFrame]
    evaluations: dict[str, models.Evaluations]
    rankings: DataFrame
    plots: dict[str, PlotData]

    def ranking(self, dataset: str) -> DataFrame:
        return self.rankings.filter(F.col("dataset") == dataset).drop("dataset")


def rank_datasets(evaluations: Mapping[str, models.Evaluations]) -> DataFrame:
    """Weighted mean ranks of all datasets in one job, told apart by ``dataset``."""
    def stacked(pick) -> DataFrame:
        parts = [pick(e).withColumn("dataset", F.lit(n)) for n, e in evaluations.items()]
        return reduce(DataFrame.unionByName, parts)

    return ranking.weighted_mean_rank(
        stacked(lambda e: e.importances), stacked(lambda e: e.scores), by=["dataset"]
    )


def evaluate_dataset(
    df: DataFrame, target: str = S.TARGET, key: str = S.ROW_ID,
    registry: Mapping[str, models.Fit] | None = None,
) -> models.Evaluations:
    clean = clean_for_evaluation(df)
    return models.evaluate_all(clean, model_features(clean, target, key), target, key, registry)


def plot_data(
    df: DataFrame, features: list[str], top: list[str], target: str = S.TARGET,
    fit: models.Fit | None = None,
) -> PlotData:
    return PlotData(
        box_stats(df, top, target),
        box_stats(df, top, target, by_class=True),
        class_medians(df, top, target),
        models.drop_importances(df, features, target, fit),
    )


def run_analysis(
    source: DataFrame | Datasets, target: str = S.TARGET, key: str = S.ROW_ID,
    registry: Mapping[str, models.Fit] | None = None, with_plots: bool = True,
) -> Analysis:
    """Everything from one event table; a missing plot table never stops the analysis."""
    datasets = source if isinstance(source, Datasets) else prepare(source, key)
    if datasets.optimal is None:
        raise ValueError("no null threshold keeps any column")
    registry = registry or models.registry()
    boosting = registry.get("gb")
    pair = optimize_both(datasets.no_nulls, datasets.optimal, target, key, boosting)
    basic = models.basic_importances(
        {"a": (pair.a.data, pair.a.features), "b": (pair.b.data, pair.b.features)}, target,
        {name: registry[name] for name in ("gb", "rf") if name in registry},
    )
    parts = {DATASET_A: pair.a, DATASET_B: pair.b}
    with ThreadPoolExecutor(len(parts)) as pool:
        evaluations = dict(zip(parts, pool.map(
            lambda part: evaluate_dataset(part.data, target, key, registry), parts.values())))
    rankings = rank_datasets(evaluations)
    plots = {}
    if with_plots:
        def plotted(name: str) -> PlotData | None:
            best = ranking.top_features(
                rankings.filter(F.col("dataset") == name), PLOT_FEATURES[name])
            top = [row["feature"] for row in best.collect()]
            try:
                return plot_data(parts[name].data, parts[name].features, top, target, boosting)
            except Exception as error:  # plot tables are extras
                warnings.warn(f"no plot data for {name}: {error}", stacklevel=2)

        with ThreadPoolExecutor(len(parts)) as pool:
            plots = {name: found for name, found in zip(parts, pool.map(plotted, parts)) if found}
    return Analysis(datasets, pair, basic, evaluations, rankings, plots)


def run_complete_analysis(
    spark: SparkSession, path: str, output_dir: str | None = None, **options
) -> Analysis:
    reader = {k: options.pop(k) for k in ("schema", "fmt", "id_col") if k in options}
    analysis = run_analysis(prepare_datasets(spark, path, **reader), **options)
    if output_dir is not None:
        save_results(analysis, output_dir)
    return analysis


def save_results(analysis: Analysis, output_dir: str, fmt: str = "csv") -> list[str]:
    """Two rankings, two optimized datasets and four importance tables."""
    return save_analysis(
        output_dir,
        {name: analysis.ranking(name) for name in (DATASET_A, DATASET_B)},
        {"a": analysis.optimized.a.data, "b": analysis.optimized.b.data},
        analysis.basic, fmt,
    )


def summary(analysis: Analysis, k: int = 5) -> dict[str, DataFrame]:
    """Top features and ranking summary per dataset, and every model's score."""
    scores = reduce(DataFrame.unionByName, [
        e.scores.withColumn("dataset", F.lit(n)) for n, e in analysis.evaluations.items()
    ])
    return {
        "top_features": ranking.top_features(analysis.rankings, k, by=["dataset"]),
        "rankings": ranking.ranking_summary(analysis.rankings, by=["dataset"]),
        "scores": scores,
    }
