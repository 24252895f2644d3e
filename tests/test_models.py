import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import by_key
from scarpline.operators import folds, linear, metrics, models, ordering
from scarpline.queries import models as registered

X = ["x0", "x1", "odd name.1"]


def _sample(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 2.0, 0.5] + [0.0, 10.0, -3.0]
    y = ((x[:, 0] + 0.4 * (x[:, 1] - 10) + rng.normal(scale=0.6, size=n)) > 0.2).astype(int)
    return x, y


@pytest.fixture(scope="module")
def sample():
    return _sample()


@pytest.fixture(scope="module")
def frame(spark, sample):
    x, y = sample
    rows = [(i, int(t), *map(float, v)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(
        rows, "row_id long, Stability int, x0 double, x1 double, `odd name.1` double")


def test_shuffled_folds_equal_plain_window(spark):
    rows = [(i, "hot" if i % 3 else "rare") for i in range(500)] + [(900, None)]
    df = spark.createDataFrame(rows, "row_id long, Stability string")
    got = by_key(folds.shuffled_folds(df, seed=42), "row_id")
    assert len(got) == 501 and got[900]["fold"] is None
    for label in ("hot", "rare"):
        order = sorted((i for i, y in rows if y == label),
                       key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        assert [got[i]["fold"] for i in order] == [k % 5 for k in range(len(order))]


@pytest.mark.parametrize("per_bucket", [7, 10**6])
def test_ordered_rank_with_and_without_buckets(spark, per_bucket):
    rng = random.Random(2)
    keys = rng.sample(range(10**12), 300)
    df = spark.createDataFrame([(k, "a" if k % 3 else "b") for k in keys], "k long, y string")
    got = by_key(ordering.ordered_rank(df, "y", "k", per_bucket), "k")
    for label in "ab":
        order = sorted(k for k in keys if ("a" if k % 3 else "b") == label)
        assert [got[k]["rank"] for k in order] == list(range(1, len(order) + 1))
        assert {got[k]["group_size"] for k in order} == {len(order)}


def test_contiguous_folds_and_split_sizes(spark):
    df = spark.createDataFrame([(i, 0) for i in range(13)] + [(100 + i, 1) for i in range(3)],
                               "row_id long, Stability int")
    got = by_key(folds.contiguous_folds(df), "row_id")
    assert [got[i]["fold"] for i in range(13)] == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 2 + [4] * 2
    assert [got[100 + i]["fold"] for i in range(3)] == [0, 1, 2]
    split = folds.stratified_split(df).groupBy("Stability").agg(F.count_if("is_test").alias("n"))
    assert by_key(split, "Stability")[0]["n"] == 3


def test_weighted_f1_by_hand(spark):
    rows = [(0.0, 0.0)] * 5 + [(0.0, 1.0)] * 2 + [(1.0, 1.0)] * 4 + [(1.0, 0.0)] + [(2.0, 0.0)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    f0, f1 = 2 * 5 / (7 + 7), 2 * 4 / (5 + 6)
    assert metrics.weighted_f1(df).first()["f1_weighted"] == pytest.approx(
        (7 * f0 + 5 * f1 + 1 * 0.0) / 13)
    assert metrics.accuracy(df).first()["accuracy"] == pytest.approx(9 / 13)


def test_ridge_closed_form(frame, sample):
    x, y = sample
    t = 2.0 * y - 1
    center = x.mean(axis=0)
    xc = x - center
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ (t - t.mean()))
    weights, intercept = linear.fit_ridge(frame, X, "Stability")
    assert weights == pytest.approx(want)
    assert intercept == pytest.approx(t.mean() - center @ want)


def test_discriminant_closed_form(frame, sample):
    x, y = sample
    m0, m1 = x[y == 0].mean(axis=0), x[y == 1].mean(axis=0)
    pooled = sum(np.cov(x[y == k].T, bias=True) * (y == k).sum() for k in (0, 1)) / (len(y) - 2)
    want = np.linalg.solve(pooled, m1 - m0)
    weights, intercept = linear.fit_discriminant(frame, X, "Stability")
    assert weights == pytest.approx(want)
    prior = math.log((y == 1).sum() / (y == 0).sum())
    assert intercept == pytest.approx(-0.5 * want @ (m0 + m1) + prior)


def test_linear_needs_two_classes(frame):
    with pytest.raises(ValueError, match="binary"):
        linear.fit_ridge(frame.filter("Stability = 1"), X, "Stability")


def test_logistic_gradient_vanishes(frame, sample):
    x, y = sample
    strengths = models.logistic()(frame, X, "Stability").importances
    # The sign of the weak feature is open; the intercept solves sum(p - y) = 0.
    gaps = []
    for sign in (-1, 1):
        w = np.array([strengths["x0"], strengths["x1"], sign * strengths["odd name.1"]])
        low, high = -100.0, 100.0
        for _ in range(200):
            middle = (low + high) / 2
            p = 1 / (1 + np.exp(-(x @ w + middle)))
            low, high = (low, middle) if p.sum() > y.sum() else (middle, high)
        gaps.append(np.abs(x.T @ (p - y) + w).max() / len(y))
    assert min(gaps) < 1e-4


def _boost(x, y, cuts, rounds):
    """Plain loop over all stumps on the same cut points."""
    w = np.ones(len(y))
    chosen = []
    for _ in range(rounds):
        options = []
        for f, edges in enumerate(cuts):
            for edge in edges:
                below = x[:, f] < edge
                impurity, votes = 0.0, np.zeros(len(y))
                for side in (below, ~below):
                    w1, w0 = w[side & (y == 1)].sum(), w[side & (y == 0)].sum()
                    if w0 + w1 > 0:
                        impurity += 2 * w0 * w1 / (w0 + w1)
                    votes[side] = 1 if w1 > w0 else -1
                options.append((impurity, f, edge, votes))
        _, f, edge, votes = min(options, key=lambda o: o[0])
        missed = (votes > 0) != (y == 1)
        error = w[missed].sum() / w.sum()
        chosen.append((f, edge, math.log((1 - error) / error), votes))
        w = w * np.where(missed, (1 - error) / error, 1.0)
    return chosen


def test_adaptive_boosting_equals_loop(spark, frame, sample):
    x, y = sample
    cuts = []
    found = frame.select(*[F.col(f"`{f}`").alias(f"c{i}") for i, f in enumerate(X)]).approxQuantile(
        ["c0", "c1", "c2"], [i / 8 for i in range(1, 8)], 1 / 64)
    for i, edges in enumerate(found):
        cuts.append(sorted(set(edges) - {x[:, i].min()}))
    want = _boost(x, y, cuts, 7)
    fitted = models.adaptive_boosting(7, bins=8, cut_every=3)(frame, X, "Stability")
    score = sum(alpha * votes for _, _, alpha, votes in want)
    got = by_key(fitted.predict(frame), "row_id")
    assert [got[i]["prediction"] for i in range(len(y))] == [float(s > 0) for s in score]
    strength = sum(alpha for _, _, alpha, _ in want)
    for i, name in enumerate(X):
        share = sum(alpha for f, _, alpha, _ in want if f == i) / strength
        assert fitted.importances[name] == pytest.approx(share)


def test_boosting_stops_when_perfect(spark):
    df = spark.createDataFrame([(float(i), int(i >= 5)) for i in range(10)], "a double, y int")
    fitted = models.adaptive_boosting(5)(df, ["a"], "y")
    assert fitted.importances == {"a": 1.0}
    assert fitted.predict(df).filter("prediction != y").count() == 0


def test_evaluate_all_isolates_failures(spark, frame):
    def broken(df, features, label):
        raise RuntimeError("no such model")

    result = models.evaluate_all(frame, X, models={
        "gb": models.gradient_boosting(3), "broken": broken, "lda": models.discriminant()})
    status = by_key(result.status, "model")
    assert status["broken"]["status"] == "failed" and "no such" in status["broken"]["message"]
    scores = by_key(result.scores, "model")
    assert set(scores) == {"gb", "lda"} and all(0.7 < r["cv_score"] <= 1 for r in scores.values())
    assert all(r["cv_std"] >= 0 for r in scores.values())
    totals = result.importances.groupBy("model").agg(F.sum("importance").alias("s"))
    assert all(r["s"] == pytest.approx(100) for r in totals.collect())


def test_selection_and_drop_importance(frame):
    chosen = models.select_features(frame, X, fit=models.random_forest(5, 4))
    assert set(chosen.features) <= {"x0", "x1"} and chosen.features
    assert 0.7 < chosen.final_score <= 1
    table = by_key(models.drop_importances(frame, X, fit=models.discriminant()), "feature")
    assert set(table) == set(X)
    assert table["x0"]["drop_importance"] > table["odd name.1"]["drop_importance"]


def test_stability_model_fills_and_keeps_nulls(frame):
    gaps = frame.withColumn("x1", F.when(F.col("row_id") != 3, F.col("x1")))
    model = models.train_stability_model(gaps, X, fit=models.random_forest(5, 4))
    assert 0.7 < model.test_accuracy <= 1 and 0.7 < model.train_accuracy <= 1
    assert 0.7 < model.cv_mean <= 1
    predicted = model.predict(gaps.drop("x0"))
    assert predicted.columns == ["row_id", "Stability", "x1", "odd name.1", "predicted"]
    assert by_key(predicted, "row_id")[3]["x1"] is None and predicted.count() == 400
    with pytest.raises(ValueError, match="complete row"):
        models.train_stability_model(gaps.filter("row_id = 3"), X)


def test_rank_over_many_buckets(spark):
    df = spark.createDataFrame([(i % 3, (i * 37) % 1000) for i in range(1000)], "g int, k int")
    ranked = ordering.ordered_rank(df, "g", "k", rows_per_bucket=1)
    by_group = {}
    for row in ranked.collect():
        by_group.setdefault(row["g"], []).append((row["k"], row["rank"]))
    for pairs in by_group.values():
        assert [r for _, r in sorted(pairs)] == list(range(1, len(pairs) + 1))


def test_labels_of_any_two_values(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "y int")
    assert [r["y"] for r in models.binary_labels(df, "y").collect()] == [0, 1, None]
    with pytest.raises(ValueError, match="binary"):
        models.binary_labels(spark.createDataFrame([(1,), (2,), (3,)], "y int"), "y")
    with pytest.raises(ValueError, match="0 and 1"):
        linear.fit_ridge(spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 5.0)], "y int, x double"), ["x"], "y")


def test_complete_analysis_query_runs_all_models_and_plots(spark, monkeypatch):
    ridge, fitted = models.ridge(), set()

    def recorded(name):
        return lambda *args: fitted.add(name) or ridge(*args)

    names = list(models.registry())
    # Without arguments: the query asks for the models at their full size.
    monkeypatch.setattr(models, "registry", lambda: {n: recorded(n) for n in names})
    found = registered.complete_analysis(spark, "/root/testdata/sf0.001")
    assert fitted == set(names)
    assert {(r["dataset"], r["table"]) for r in found.select("dataset", "table").distinct().collect()} == {
        (d, t) for d in ("no_nans", "optimal")
        for t in ("rankings", "boxes", "class_boxes", "medians", "drop_importances")}


def test_basic_models_query_takes_the_optimized_pair(spark, monkeypatch):
    ridge, seen = models.ridge(), []
    monkeypatch.setattr(models, "registry", lambda: {"gb": ridge, "rf": ridge})
    monkeypatch.setattr(models, "basic_importances", lambda tables, models: seen.append(tables) or {
        "gb_a": spark.range(1)})
    registered.basic_models(spark, "/root/testdata/sf0.001")
    (a, _), (b, _) = seen[0]["a"], seen[0]["b"]
    assert a.count() != b.count()
