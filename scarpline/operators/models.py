"""The six classifiers, feature selection, cross-validation and importances.

A classifier is any function ``fit(df, features, label) -> Fitted``; the registry maps names to
such functions, so other estimators are plugged in by adding an entry. The six also fit many ``Job``s of
one table at once (``fit_many``): folds, selections and left-out features share their passes. The driver
sees models, metrics and one number per feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from math import log

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline import schema as S
from scarpline.operators import boosting, fitting, forest, linear, metrics, ranking
from scarpline.operators.columns import align_features, quoted
from scarpline.operators.fitting import Job
from scarpline.operators.profile import drop_null_rows
from scarpline.operators.folds import contiguous_folds, shuffled_folds, stratified_split
from scarpline.session import cut_lineage

# Cuts tried per feature in boosting; more cost memory, never rows.
MAX_BINS = 256
IMPORTANCE = "model string, feature string, importance double"


@dataclass(frozen=True)
class Fitted:
    """``predict`` adds ``prediction`` (0.0/1.0); ``importances`` holds a value per feature."""

    predict: Callable[[DataFrame], DataFrame]
    importances: dict[str, float]


Fit = Callable[[DataFrame, list[str], str], Fitted]


@dataclass(frozen=True)
class Many:
    """An estimator that fits all jobs of a table together; called as a plain fit it does one."""

    many: Callable[[DataFrame, list[Job], str, str | None], list[Fitted]]

    def __call__(self, df: DataFrame, features: list[str], label: str) -> Fitted:
        return self.many(df, [Job(tuple(features))], label, None)[0]


def fit_many(
    fit: Fit, df: DataFrame, jobs: list[Job], label: str, fold: str | None = None,
    parallelism: int = S.N_FOLDS,
) -> list[Fitted]:
    """One model per job; a plain fit is called once for each, side by side."""
    if isinstance(fit, Many):
        return fit.many(df, jobs, label, fold)

    def one(job: Job) -> Fitted:
        rows = df if job.held_out is None else df.filter(F.col(fold) != job.held_out)
        return fit(rows, list(job.features), label)

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(one, jobs))


def random_forest(
    trees: int = 100, depth: int | None = None, seed: int = S.SEED, max_bins: int = MAX_BINS
) -> Fit:
    """Forest with sqrt feature sampling, grown until all leaves are pure unless ``depth`` bounds it.

    ``max_bins`` is the least number of bins for the tops of trees over tables beyond the broadcast bound.
    """
    def many(df: DataFrame, jobs: list[Job], label: str, fold: str | None) -> list[Fitted]:
        features = fitting.all_features(jobs)
        table = fitting.training_table(df, features, label, fold)
        found = forest.plant(table, features, jobs, trees, seed, depth, bins=max_bins)
        return [Fitted(forest.predictor(m, features, df.sparkSession), _named(features, m.importances, job))
                for m, job in zip(found, jobs)]
    return Many(many)


def gradient_boosting(
    stages: int = 100, depth: int = 3, max_bins: int = MAX_BINS, rate: float = 0.1
) -> Fit:
    """Boosted trees of the log loss for a binary target."""
    def many(df: DataFrame, jobs: list[Job], label: str, fold: str | None) -> list[Fitted]:
        features = fitting.all_features(jobs)
        table = fitting.training_table(df, features, label, fold)
        found = boosting.boost(table, features, jobs, stages, depth, rate, max_bins)
        return [Fitted(boosting.predictor(m, features, df.sparkSession), _named(features, m.importances, job))
                for m, job in zip(found, jobs)]
    return Many(many)


def _named(features: list[str], values, job: Job) -> dict[str, float]:
    return {f: float(v) for f, v in zip(features, values) if f in job.features}


def _linear_model(weights, intercept: float, features: list[str]) -> Fitted:
    terms = [F.lit(float(w)) * quoted(f) for w, f in zip(weights, features)]
    score = reduce(lambda a, b: a + b, terms, F.lit(float(intercept)))

    def predict(rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", (score > 0).cast("double"))

    return Fitted(predict, {f: abs(float(w)) for f, w in zip(features, weights)})


def logistic(max_iter: int = 1000, c: float = 1.0) -> Fit:
    """L2-penalised logistic regression; the penalty is ``1/c`` against the summed loss."""
    def many(df: DataFrame, jobs: list[Job], label: str, fold: str | None) -> list[Fitted]:
        features = fitting.all_features(jobs)
        table = fitting.training_table(df, features, label, fold).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = linear.newton_logistic(table, features, jobs, c, max_iter)
        finally:
            table.unpersist()
        return [_linear_model(w, b, list(job.features)) for (w, b), job in zip(found, jobs)]
    return Many(many)


def _from_moments(solver) -> Fit:
    def many(df: DataFrame, jobs: list[Job], label: str, fold: str | None) -> list[Fitted]:
        moments = linear.FoldMoments(df, fitting.all_features(jobs), label, fold)
        return [_linear_model(*solver(moments.classes(job)), list(job.features)) for job in jobs]
    return Many(many)


def ridge(alpha: float = 1.0) -> Fit:
    return _from_moments(lambda classes: linear.ridge_weights(classes, alpha))


def discriminant() -> Fit:
    return _from_moments(linear.discriminant_weights)


@dataclass(frozen=True)
class Stump:
    """Values below ``cut`` of one feature vote ``below``, the others ``above`` (-1 or +1)."""

    feature: int
    bin: int
    cut: float
    below: float
    above: float
    error: float


def _best_stump(histogram: dict[tuple[int, int], list[float]], cuts: list[list[float]]) -> Stump:
    """Split of least weighted Gini impurity; the first feature and cut win ties.

    ``histogram`` holds the weights of label 0 and 1 per (feature, bin), a few values per feature.
    """
    best = None
    for feature, edges in enumerate(cuts):
        bins = [histogram.get((feature, k), [0.0, 0.0]) for k in range(len(edges) + 1)]
        whole = [sum(b[0] for b in bins), sum(b[1] for b in bins)]
        left = [0.0, 0.0]
        for k, edge in enumerate(edges):
            left = [left[0] + bins[k][0], left[1] + bins[k][1]]
            right = [whole[0] - left[0], whole[1] - left[1]]
            sides = [side for side in (left, right) if sum(side) > 0]
            impurity = sum(2 * side[0] * side[1] / sum(side) for side in sides)
            if best is None or impurity < best[0] - 1e-15 * sum(whole):
                votes = [1.0 if side[1] > side[0] else -1.0 for side in (left, right)]
                missed = sum(side[0] if v > 0 else side[1] for side, v in zip((left, right), votes))
                best = (impurity, Stump(feature, k, edge, *votes, missed / sum(whole)))
    if best is None:
        raise ValueError("all features are constant")
    return best[1]


def adaptive_boosting(rounds: int = 100, bins: int = MAX_BINS, cut_every: int = 25) -> Fit:
    """Boosted stumps: misses gain weight by ``exp(alpha)`` after every round.

    Tables of checked size are broadcast and all jobs run as tasks; beyond that a job is ``staged_stumps``.
    """
    staged = staged_stumps(rounds, bins, cut_every)

    def many(df: DataFrame, jobs: list[Job], label: str, fold: str | None) -> list[Fitted]:
        features = fitting.all_features(jobs)
        table = fitting.training_table(df, features, label, fold)
        rows = fitting.held_locally(table, len(features))
        if rows is None:
            return fit_many(staged, df, jobs, label, fold)
        cuts = [np.array(c) for c in quantile_edges(table.select(
            *[F.col("x")[i].alias(f"x{i}") for i in range(len(features))]), bins)]
        found = boosting.stump_rounds(rows, cuts, df.sparkSession, features, jobs, rounds)
        return [_voting([(w, Stump(f, 0, cut, below, above, 0.0)) for f, cut, below, above, w in m.votes],
                        features, list(job.features)) for m, job in zip(found, jobs)]
    return Many(many)


def quantile_edges(values: DataFrame, bins: int) -> list[list[float]]:
    """Approximate quantiles of every column; an edge at the minimum would leave one side empty."""
    found = values.approxQuantile(values.columns, [i / bins for i in range(1, bins)], 1.0 / (8 * bins))
    low = values.agg(*[F.min(v) for v in values.columns]).first()
    return [sorted(set(c) - {low[i]}) for i, c in enumerate(found)]


def _voting(stumps: list[tuple[float, Stump]], features: list[str], used: list[str]) -> Fitted:
    strength = sum(alpha for alpha, _ in stumps)
    totals = dict.fromkeys(used, 0.0)
    for alpha, stump in stumps:
        totals[features[stump.feature]] += alpha / strength
    asked = sorted({stump.feature for _, stump in stumps})
    votes = [(asked.index(s.feature), s.cut, alpha * s.below, alpha * s.above) for alpha, s in stumps]

    @F.pandas_udf("double")
    def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for values in batches:
            x = values.to_numpy(dtype=np.float64)
            score = np.zeros(len(x))
            for column, cut, below, above in votes:
                score += np.where(x[:, column] < cut, below, above)
            yield pd.Series((score > 0).astype(float))

    def predict(table: DataFrame) -> DataFrame:
        return table.withColumn("prediction", voted(fitting.feature_struct([features[f] for f in asked])))

    return Fitted(predict, totals)


def staged_stumps(rounds: int = 100, bins: int = MAX_BINS, cut_every: int = 25) -> Fit:
    """Boosted stumps over a table of any size.

    Features are binned once and rows kept in blocks of whole columns. A round is one aggregation of the
    row weights by (feature, bin, label), added up by block; it yields both the best stump and its error.
    Row weights follow from the last stumps, and are written to the checkpoint folder every ``cut_every``
    rounds.
    """
    def fit(df: DataFrame, features: list[str], label: str) -> Fitted:
        table = fitting.training_table(df, features, label)
        cuts = quantile_edges(table.select(*[F.col("x")[i].alias(f"x{i}") for i in range(len(features))]), bins)
        if not any(cuts):
            raise ValueError("all features are constant")
        state = cut_lineage(boosting.weighted_blocks(table, [np.array(c) for c in cuts]))
        votes: list[tuple[int, int, float, float, float]] = []  # those not yet in the stored weights
        stumps: list[tuple[float, Stump]] = []
        for step in range(1, rounds + 1):
            sums = boosting.weight_sums(state, cuts, votes).groupBy("f", "b", "y").agg(F.sum("w").alias("w")).collect()
            histogram: dict[tuple[int, int], list[float]] = {}
            for row in sums:
                histogram.setdefault((row["f"], row["b"]), [0.0, 0.0])[row["y"]] = row["w"]
            stump = _best_stump(histogram, cuts)
            error = stump.error
            if error >= 0.5:
                break
            stumps.append((1.0 if error <= 0 else log((1 - error) / error), stump))
            if error <= 0:
                break
            votes.append((stump.feature, stump.bin, stump.below, stump.above, error))
            if step % cut_every == 0 and step < rounds:
                state, votes = cut_lineage(boosting.reweighted_blocks(state, cuts, votes)), []
        if not stumps:
            raise ValueError("no stump is better than chance")
        return _voting(stumps, features, features)
    return fit


def registry(
    trees: int = 100, depth: int | None = None, stages: int = 100, rounds: int = 100, max_bins: int = MAX_BINS
) -> dict[str, Fit]:
    """The six models in their fixed order."""
    return {
        "logistic": logistic(),
        "rf": random_forest(trees, depth, max_bins=max_bins),
        "gb": gradient_boosting(stages, max_bins=max_bins),
        "ridge": ridge(),
        "lda": discriminant(),
        "ada": adaptive_boosting(rounds, max_bins),
    }


def binary_labels(df: DataFrame, label: str) -> DataFrame:
    """The two values of a numeric target as 0 and 1, in their order; other targets raise."""
    found = [row[0] for row in df.select(quoted(label).cast("double")).na.drop().distinct().limit(3).collect()]
    if len(found) > 2:
        raise ValueError(f"a binary target is needed, {label} has more than two values")
    if set(found) <= {0.0, 1.0}:
        return df
    high = max(found)
    return df.withColumn(label, F.when(
        quoted(label).isNotNull(), ((quoted(label).cast("double") == high) & F.lit(len(found) > 1)).cast("int")))


def importance_table(spark, importances: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(model, feature, importance), one row per model and feature."""
    rows = [(m, f, float(v)) for m, table in importances.items() for f, v in table.items()]
    return spark.createDataFrame(rows, IMPORTANCE)


def selected_features(importances: Mapping[str, float]) -> list[str]:
    """Features at least as important as the mean."""
    mean = sum(importances.values()) / len(importances)
    return [f for f, v in importances.items() if v >= mean]


def cross_validate(
    df: DataFrame, features: list[str], label: str, fit: Fit, fold: str = "fold",
    n_folds: int = S.N_FOLDS, parallelism: int = S.N_FOLDS, metric: str = "f1_weighted",
) -> DataFrame:
    """(fold, score) for a table with a fold column; all folds are scored in one job."""
    jobs = [Job(tuple(features), k) for k in range(n_folds)]
    return fold_scores(df, fit_many(fit, df, jobs, label, fold, parallelism), label, fold, metric)


def fold_scores(
    df: DataFrame, fitted: list[Fitted], label: str, fold: str = "fold", metric: str = "f1_weighted"
) -> DataFrame:
    """(fold, score): each fold judged by its own model, in one job."""
    predictions = reduce(DataFrame.unionByName, [
        model.predict(df.filter(F.col(fold) == k)).select(
            F.col(fold), quoted(label).cast("double").alias("label"), "prediction")
        for k, model in enumerate(fitted)
    ])
    scorer = metrics.weighted_f1 if metric == "f1_weighted" else metrics.accuracy
    return scorer(predictions, by=[fold]).withColumnRenamed(metric, "score")


@dataclass(frozen=True)
class Evaluation:
    cv_score: float
    cv_std: float
    importances: dict[str, float]


def _score(folds: DataFrame) -> tuple[float, float]:
    row = metrics.cv_summary(folds, "score").first()
    return row["cv_score"], row["cv_std"]


def evaluate_model(
    folded: DataFrame, features: list[str], label: str, fit: Fit, parallelism: int = S.N_FOLDS
) -> Evaluation:
    """Select on all rows, refit on the selected features, then cross-validate them.

    Selection sees all rows before the folds, so the scores are optimistic, as documented.
    """
    kept = selected_features(fit(folded, features, label).importances)
    jobs = [Job(tuple(kept)), *[Job(tuple(kept), k) for k in range(S.N_FOLDS)]]
    final, *held_out = fit_many(fit, folded, jobs, label, "fold", parallelism)
    score, deviation = _score(fold_scores(folded, held_out, label))
    return Evaluation(score, deviation, final.importances)


@dataclass(frozen=True)
class Evaluations:
    scores: DataFrame
    importances: DataFrame
    status: DataFrame


def evaluate_all(
    df: DataFrame, features: list[str], label: str = S.TARGET, key: str = S.ROW_ID,
    models: Mapping[str, Fit] | None = None, seed: int | None = S.SEED, parallelism: int = S.N_FOLDS,
) -> Evaluations:
    """All models on one table, side by side; a model that fails is reported and left out."""
    spark = df.sparkSession
    base = binary_labels(df, label).select(quoted(key), quoted(label), *[quoted(f) for f in features])
    folded = shuffled_folds(base, label, key, seed=seed).persist(StorageLevel.MEMORY_AND_DISK)
    models = models or registry()

    def evaluated(name: str) -> Evaluation | Exception:
        try:
            return evaluate_model(folded, features, label, models[name], parallelism)
        except Exception as error:  # one failing model must not stop the others
            return error

    try:
        folded.count()
        with ThreadPoolExecutor(parallelism) as pool:
            results = dict(zip(models, pool.map(evaluated, models)))
    finally:
        folded.unpersist()
    found = {name: r for name, r in results.items() if isinstance(r, Evaluation)}
    status = [(name, "success", None) if name in found else (name, "failed", str(r)) for name, r in results.items()]
    scores = [(name, r.cv_score, r.cv_std) for name, r in found.items()]
    tables = {name: r.importances for name, r in found.items()}
    shares = ranking.percent_importances(importance_table(spark, tables))
    return Evaluations(
        spark.createDataFrame(scores, "model string, cv_score double, cv_std double"),
        ranking.rank_importances(shares),
        spark.createDataFrame(status, "model string, status string, message string"),
    )


def basic_importances(
    datasets: Mapping[str, tuple[DataFrame, list[str]]], label: str = S.TARGET,
    models: Mapping[str, Fit] | None = None,
) -> dict[str, DataFrame]:
    """``{model}_{dataset}`` importance tables, most important first."""
    models = models or {"gb": gradient_boosting(), "rf": random_forest()}
    pairs = [(model, name) for model in models for name in datasets]

    def table(pair: tuple[str, str]) -> DataFrame:
        model, (df, features) = pair[0], datasets[pair[1]]
        fitted = models[model](df, features, label)
        return importance_table(df.sparkSession, {model: fitted.importances}).orderBy(F.desc("importance"), "feature")

    with ThreadPoolExecutor(len(pairs) or 1) as pool:
        return {f"{model}_{name}": t for (model, name), t in zip(pairs, pool.map(table, pairs))}


@dataclass(frozen=True)
class Selection:
    """Outcome of mean-importance selection, with scores before and after."""

    features: list[str]
    initial_score: float
    final_score: float
    feature_share: float


def select_features(
    df: DataFrame, features: list[str], label: str = S.TARGET, key: str = S.ROW_ID,
    fit: Fit | None = None, parallelism: int = S.N_FOLDS,
) -> Selection:
    """Mean-importance selection by boosted trees, scored on unshuffled folds before and after."""
    fit = fit or gradient_boosting()
    base = binary_labels(df, label).select(quoted(key), quoted(label), *[quoted(f) for f in features])
    folded = contiguous_folds(base, label, key).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        jobs = [Job(tuple(features)), *[Job(tuple(features), k) for k in range(S.N_FOLDS)]]
        whole, *held_out = fit_many(fit, folded, jobs, label, "fold", parallelism)
        first, _ = _score(fold_scores(folded, held_out, label))
        kept = selected_features(whole.importances)
        last = first
        if kept != features:
            last, _ = _score(cross_validate(folded, kept, label, fit, parallelism=parallelism))
    finally:
        folded.unpersist()
    return Selection(kept, first, last, len(kept) / len(features))


def drop_importances(
    df: DataFrame, features: list[str], label: str = S.TARGET, fit: Fit | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """Loss of training accuracy when a feature is left out: (feature, drop_importance)."""
    fit = fit or gradient_boosting()
    table = binary_labels(df, label).select(quoted(label), *[quoted(f) for f in features]).persist(
        StorageLevel.MEMORY_AND_DISK)

    subsets = [features, *[[f for f in features if f != out] for out in features]]
    try:
        jobs = [Job(tuple(names)) for names in subsets if names]
        fitted = fit_many(fit, table, jobs, label, None, parallelism)
        judged = reduce(DataFrame.unionByName, [
            model.predict(table).select(
                F.lit(i).alias("left_out"), quoted(label).alias(label), "prediction")
            for i, model in enumerate(fitted)
        ])
        scores = {r["left_out"]: r["accuracy"] for r in metrics.accuracy(judged, label, by=["left_out"]).collect()}
        if len(fitted) < len(subsets):  # without any feature the best guess is the larger class
            sizes = table.groupBy(quoted(label)).count()
            scores[len(fitted)] = sizes.agg(F.max("count") / F.sum("count")).first()[0]
    finally:
        table.unpersist()
    rows = [(f, scores[0] - scores[i]) for i, f in enumerate(features, 1)]
    return df.sparkSession.createDataFrame(rows, "feature string, drop_importance double").orderBy(
        F.desc("drop_importance"), "feature"
    )


@dataclass(frozen=True)
class StabilityModel:
    features: list[str]
    fitted: Fitted
    train_accuracy: float
    test_accuracy: float
    cv_mean: float
    cv_std: float

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """Adds the predicted class; absent features and nulls count as 0."""
        carry = [c for c in df.columns if c not in self.features]
        hidden = {f: f"__in_{i}" for i, f in enumerate(self.features)}
        kept = [c for c in df.columns if c in hidden]
        tagged = df.withColumns({hidden[c]: quoted(c) for c in kept}) if kept else df
        aligned = align_features(tagged, self.features, [*carry, *[hidden[c] for c in kept]])
        predicted = self.fitted.predict(aligned)
        return predicted.select(
            *[(quoted(hidden[c]) if c in hidden else quoted(c)).alias(c) for c in df.columns],
            F.col("prediction").alias(out),
        )


def train_stability_model(
    df: DataFrame, features: list[str], label: str = S.TARGET, key: str = S.ROW_ID,
    fit: Fit | None = None, test_share: float = S.TEST_SHARE, seed: int | None = S.SEED,
    parallelism: int = S.N_FOLDS,
) -> StabilityModel:
    """Forest on the rows without nulls: split, fit on the training part, score, cross-validate."""
    fit = fit or random_forest()
    wanted = [key, label, *features]
    df = binary_labels(df, label)
    clean = drop_null_rows(df.select(*[quoted(c) for c in wanted]), [label, *features])
    split = stratified_split(clean, label, key, test_share, seed)
    table = contiguous_folds(split, label, key).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if table.isEmpty():
            raise ValueError("no complete row is left for training")
        fitted = fit(table.filter(~F.col("is_test")), features, label)
        by_part = {
            row["is_test"]: row["accuracy"]
            for row in metrics.accuracy(fitted.predict(table), label, by=["is_test"]).collect()
        }
        folds = cross_validate(
            table, features, label, fit, parallelism=parallelism, metric="accuracy"
        )
        mean, deviation = _score(folds)
    finally:
        table.unpersist()
    return StabilityModel(
        features, fitted, by_part.get(False), by_part.get(True), mean, deviation
    )
