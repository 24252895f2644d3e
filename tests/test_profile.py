import random

import pytest

from helpers import by_key
from scarpline.operators import columns as C
from scarpline.operators import distribution, profile
from scarpline.plans.datasets import prepare


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(i, None if i == 2 else 1.0, None if i <= 3 else 2, None if i <= 5 else 3)
            for i in range(1, 7)]
    return spark.createDataFrame(rows, "a int, b double, c int, d int")


def test_sweep_golden(gaps):
    rows = [tuple(r) for r in profile.threshold_sweep(gaps).orderBy("threshold").collect()]
    expected = [(1, 1, 6, 0.475), (2, 2, 5, 0.6), (3, 2, 5, 0.6), (4, 3, 3, 0.675),
                (5, 3, 3, 0.675)]
    for row, want in zip(rows, expected, strict=True):
        assert row[:3] == want[:3] and row[3] == pytest.approx(want[3])
    assert profile.best_threshold(gaps) == 4
    assert profile.top_threshold(profile.threshold_sweep(gaps)).first()["threshold"] == 4


def test_datasets_golden(gaps):
    bundle = prepare(gaps, key="none")
    assert bundle.no_nulls.columns == ["a"]
    assert bundle.optimal.columns == ["a", "b", "c"]
    assert sorted(r["a"] for r in bundle.optimal.collect()) == [4, 5, 6]
    assert bundle.best_threshold == 4


def test_key_is_carried_but_not_counted(gaps):
    keyed = gaps.withColumnRenamed("a", "row_id")
    bundle = prepare(keyed)
    assert "row_id" not in bundle.profile.nulls
    assert bundle.no_nulls.columns == ["row_id"]


def _brute_force(rows, width):
    n = len(rows)
    nulls = [sum(r[c] is None for r in rows) for c in range(width)]
    table = []
    for t in range(1, n):
        kept = [c for c in range(width) if nulls[c] < t]
        if kept:
            complete = sum(all(r[c] is not None for c in kept) for r in rows)
            table.append((t, len(kept), complete, 0.7 * (len(kept) / width) + 0.3 * (complete / n)))
    return table


@pytest.mark.parametrize("seed", range(6))
def test_sweep_equals_definition(spark, seed):
    rng = random.Random(seed)
    width, n = rng.randint(1, 5), rng.randint(2, 14)
    rows = [tuple(None if rng.random() < rng.choice([0, .2, .6, .95]) else rng.randint(0, 9)
                  for _ in range(width)) for _ in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(width)))
    expected = _brute_force(rows, width)
    got = [tuple(r) for r in profile.threshold_sweep(df).orderBy("threshold").collect()]
    assert got == expected
    best = max(expected, key=lambda r: r[3])[0] if expected else None
    assert profile.best_threshold(df) == best


def test_sweep_without_eligible_column_is_empty(spark):
    df = spark.createDataFrame([(None,), (None,)], "a int")
    assert profile.threshold_sweep(df).count() == 0
    assert profile.best_threshold(df) is None
    assert prepare(df).optimal is None


def test_clean_columns_golden(spark):
    frame = spark.createDataFrame(
        [(1, 4, 7, "2020-01-01", 0), (2, 5, 8, "2020-01-02", 1), (3, 6, 9, "2020-01-03", 0)],
        "feature1 int, feature2 int, `Unnamed: 0` int, event_date string, Stability int")
    assert C.clean_for_evaluation(frame).columns == ["feature1", "feature2", "Stability"]
    assert C.clean_features(frame).columns == ["feature1", "feature2", "Stability"]


def test_profiles_of_short_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    table = by_key(profile.numeric_profile(df), "column")
    assert table["a"]["std"] is None and table["a"]["count"] == 1
    assert table["b"]["count"] == 0 and table["b"]["min"] is None
    quality = by_key(profile.quality_profile(df, ["a", "b", "c"]), "column")
    assert [quality[c]["status"] for c in "abc"] == ["valid", "no_data", "missing_column"]


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_quantiles_are_exact(spark, accuracy):
    rng = random.Random(accuracy)
    rows = [(k, rng.choice([rng.gauss(0, 1), 5.0, -3.0])) for k in ("x", "y") for _ in range(700)]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = by_key(distribution.exact_quantiles(df, ["k"], "v", probs, accuracy), "k")
    for key in ("x", "y", "one", "two"):
        values = sorted(v for k, v in rows if k == key)
        for i, p in enumerate(probs):
            h = (len(values) - 1) * p
            low = values[int(h)]
            high = values[min(int(h) + 1, len(values) - 1)]
            assert got[key][f"q{i}"] == pytest.approx(low + (high - low) * (h - int(h)))


def test_quartile_golden(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (1, 9.0)], "Stability int, f double")
    box = distribution.box_stats(df, ["f"]).first()
    assert (box["q1"], box["median"], box["q3"]) == (1.75, 3.0, 5.25)
    assert (box["whisker_low"], box["whisker_high"], box["outliers"]) == (1.0, 9.0, 0)
    assert distribution.class_medians(df, ["f"]).first()["median"] == 3.0
