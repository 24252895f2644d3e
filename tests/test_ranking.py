import math
import random

import pytest

from helpers import by_key
from scarpline.operators import ranking


@pytest.fixture(scope="module")
def mock(spark):
    importances = spark.createDataFrame(
        [("model1", "A", 0.5, 1), ("model1", "B", 0.3, 2), ("model1", "C", 0.2, 3),
         ("model2", "A", 0.6, 1), ("model2", "B", 0.3, 2), ("model2", "D", 0.1, 3)],
        "model string, feature string, importance double, rank int")
    scores = spark.createDataFrame([("model1", 0.8), ("model2", 0.9)],
                                   "model string, cv_score double")
    return importances, scores


def test_weighted_mean_rank_golden(mock):
    rows = ranking.weighted_mean_rank(*mock).collect()
    assert [r["feature"] for r in rows] == ["A", "B", "D", "C"]
    assert [r["weighted_mean_rank"] for r in rows] == pytest.approx(
        [1.0, 2.0, 3.470588, 3.529412], abs=1e-6)
    assert [r["final_rank"] for r in rows] == [1, 2, 3, 4]


def test_consensus_golden(mock):
    rows = by_key(ranking.consensus_rank(*mock), "feature")
    want = {"A": (1.0, 1.0, 1.0), "B": (2.0, 0.633842, 1.0), "D": (3.268941, 0.169208, 0.5),
            "C": (3.731059, 0.0, 0.5)}
    for feature, values in want.items():
        row = rows[feature]
        got = (row["agg_rank"], row["consensus_score"], row["selection_freq"])
        assert got == pytest.approx(values, abs=1e-6)


def test_equal_ranks_have_no_consensus_score(spark):
    one = spark.createDataFrame([("m", "A", 1.0, 1)],
                                "model string, feature string, importance double, rank int")
    scores = spark.createDataFrame([("m", 0.5)], "model string, cv_score double")
    assert ranking.consensus_rank(one, scores).first()["consensus_score"] is None


def test_absent_ranks_differ_by_rule(mock, spark):
    importances, _ = mock
    longer = importances.union(spark.createDataFrame([("model2", "E", 0.05, 4)],
                                                     importances.schema))
    own = by_key(ranking.dense_ranks(longer), "feature", "model")
    assert own["E", "model1"]["rank"] == 4.0 and own["C", "model2"]["rank"] == 5.0
    overall = by_key(ranking.dense_ranks(longer, absent="global"), "feature", "model")
    assert overall["E", "model1"]["rank"] == 5.0 and not overall["E", "model1"]["seen"]


def test_summary_and_top(mock):
    ranks = ranking.weighted_mean_rank(*mock)
    row = ranking.ranking_summary(ranks).first()
    assert (row["features_ranked"], row["best_feature"], row["worst_feature"]) == (4, "A", "C")
    assert [r["feature"] for r in ranking.top_features(ranks, 2).collect()] == ["A", "B"]
    best = ranking.top_importances(mock[0].filter("model = 'model1'"), 1).first()
    assert best["feature"] == "A"


def test_selection_and_percent(spark):
    table = spark.createDataFrame([("m", "A", 6.0), ("m", "B", 2.0), ("m", "C", 1.0)],
                                  "model string, feature string, importance double")
    assert [r["feature"] for r in ranking.select_by_mean(table).collect()] == ["A"]
    shares = by_key(ranking.percent_importances(table), "feature")
    assert shares["A"]["importance"] == pytest.approx(200 / 3)
    order = by_key(ranking.rank_importances(table), "feature")
    assert [order[f]["rank"] for f in "ABC"] == [1, 2, 3]


@pytest.mark.parametrize("seed", range(3))
def test_rank_bounds(spark, seed):
    rng = random.Random(seed)
    features, rows, scores = "abcdef", [], []
    for m in range(4):
        chosen = rng.sample(features, rng.randint(1, 6))
        rows += [(f"m{m}", f, 1.0, i + 1) for i, f in enumerate(chosen)]
        scores.append((f"m{m}", rng.uniform(0.5, 1)))
    table = spark.createDataFrame(rows, "model string, feature string, importance double, rank int")
    weights = spark.createDataFrame(scores, "model string, cv_score double")
    total = sum(s for _, s in scores)
    for row in ranking.weighted_mean_rank(table, weights).collect():
        want = 0.0
        for model, score in scores:
            own = {f: r for m, f, _, r in rows if m == model}
            want += score / total * own.get(row["feature"], len(own) + 1)
        assert row["weighted_mean_rank"] == pytest.approx(want)
        assert 1 <= row["weighted_mean_rank"] <= 7
    soft = by_key(ranking.softmax_weights(weights), "model")
    raised = {m: math.exp(10 * s) for m, s in scores}
    for model, value in raised.items():
        assert soft[model]["weight"] == pytest.approx(value / sum(raised.values()))
