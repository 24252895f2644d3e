"""What grows with the table never passes through the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.operators import blocks, boosting, fitting, forest, models, transitions
from scarpline.operators.fitting import Job


def test_aligned_predictions_are_not_broadcast_by_estimate(spark):
    original = spark.range(100).select(F.col("id").alias("row_id"), F.lit(1.0).alias("original"))
    future = spark.range(100).select(
        F.col("id").alias("row_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("scenario"),
        (F.col("id") % 2).cast("double").alias("predicted"))
    pairs = transitions.align_predictions(original, future)
    row = transitions.transition_counts(pairs).where("scenario = 'a'").first()
    assert (row["total_points"], row["stable_to_unstable"]) == (100, 50)
    assert pairs.count() == 200
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def frame(spark):
    i = F.col("id")
    rows = spark.range(400).select(
        i.alias("row_id"), F.pmod(F.xxhash64(i), F.lit(997)).cast("double").alias("a"),
        F.pmod(F.xxhash64(i, F.lit(1)), F.lit(7)).cast("double").alias("b.c"))
    noise = F.pmod(F.xxhash64(F.col("row_id"), F.lit(2)), F.lit(8)) == 0
    return rows.withColumn("y", ((F.col("a") + F.col("`b.c`") * 50 > 650) != noise).cast("int")).cache()


@pytest.mark.parametrize("cells", [None, 2 * 50])
def test_trees_stay_with_spark_and_the_driver_takes_gains(frame, cells):
    table = fitting.training_table(frame, ["a", "b.c"], "y")
    model = forest.plant(table, ["a", "b.c"], [Job(("a", "b.c"))], 3, 42, cells=cells)[0]
    assert model.size > 0 and len(model.gains) == 3
    assert sorted(model.stored.columns) == ["gains", "job", "nodes", "tree"] and model.stored.count() == 3


def test_a_forest_too_large_to_send_votes_as_a_small_one(frame, monkeypatch):
    gaps = frame.unionByName(frame.limit(40)).withColumn("a", F.when(F.col("row_id") % 9 != 0, F.col("a")))
    sent = models.random_forest(9)(frame, ["a", "b.c"], "y").predict(gaps)
    monkeypatch.setattr(forest, "MODEL_BYTES", 0)
    monkeypatch.setattr(forest, "PART_BYTES", 4000)
    monkeypatch.setattr(forest, "PART_ROWS", 150)
    met = models.random_forest(9)(frame, ["a", "b.c"], "y").predict(gaps)
    assert met.columns == sent.columns == [*gaps.columns, "prediction"]
    assert sorted(map(tuple, met.collect()), key=str) == sorted(map(tuple, sent.collect()), key=str)
    assert met.where("prediction = y").count() > 300


def test_staged_rows_are_kept_in_blocks_of_columns(frame):
    table = fitting.training_table(frame, ["a", "b.c"], "y").coalesce(1)
    jobs = [Job(("a", "b.c")), Job(("a",))]
    cuts = fitting.cut_points(fitting.sampled(table, None, 2), 300)
    staged = boosting._Staged(table, jobs, cuts, [np.array([True, True]), np.array([True, False])], 300, 0.1)
    assert staged.state.count() == 1  # not a row of Python objects per training row
    trees = [boosting.Tree(np.array([True, True]), 3) for _ in jobs]
    while any(tree.wanted() for tree in trees):
        for tree, counted in zip(trees, staged.count(trees), strict=True):
            tree.take(counted)
    codes = fitting.codes_of(fitting.held_locally(table, 2).x, cuts)
    assert (trees[0].placed(np.ascontiguousarray(codes.T)) == trees[0].place(codes)).all()


def test_staged_stumps_keep_blocks_of_columns(frame, monkeypatch):
    kept = []
    cut = models.cut_lineage
    monkeypatch.setattr(models, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    rows = frame.coalesce(1)  # quantiles are those of a layout
    staged = models.staged_stumps(5, bins=32, cut_every=2)(rows, ["a", "b.c"], "y")
    assert len(kept) == 3 and all(df.count() == 1 for df in kept)
    held = models.adaptive_boosting(5, bins=32)(rows, ["a", "b.c"], "y")
    assert staged.importances == pytest.approx(held.importances, abs=1e-9)


def test_rows_are_short_and_exact_in_blocks():
    generator = np.random.default_rng(5)
    for n in (1, 2, 3000):
        columns = [np.round(generator.uniform(-1e5, 1e5, n), 2), generator.integers(0, 25, n), generator.normal(size=n),
                   generator.choice([0.1, 1 / 3, np.inf, np.nan], n), np.full(n, 7.5), generator.integers(0, 12, n)]
        for x in (np.column_stack(columns), np.column_stack([columns[0], columns[1], columns[5]])):
            layout = blocks.Layout.of(x)
            words = layout.words(x)
            order = np.argsort(words[0], kind="stable")
            data = blocks.packed(layout.head(), words[:, order])
            assert np.array_equal(blocks.unpacked(data), x[order], equal_nan=True)
    assert len(data) < 5 * 3000  # of 24 bytes a row


def test_stored_trees_are_short(frame):
    table = fitting.training_table(frame, ["a", "b.c"], "y")
    rows = fitting.held_locally(table, 2)
    grown = forest.grow(rows.x, rows.label, np.ones(400, int), np.ones(2, bool), 1, 7)
    kept = forest.unpacked(forest.packed(grown), [])
    leaf = grown.feature < 0
    assert (kept.value[leaf] == grown.value[leaf]).all() and (kept.cut[~leaf] == grown.cut[~leaf]).all()
    assert len(forest.packed(grown)) < 14 * len(grown.feature)


def test_rows_and_forest_meet_without_a_shuffle(frame, monkeypatch):
    monkeypatch.setattr(forest, "MODEL_BYTES", 0)
    monkeypatch.setattr(forest, "PART_BYTES", 4000)
    voted = models.random_forest(9)(frame, ["a", "b.c"], "y").predict(frame)
    plan = voted._jdf.queryExecution().executedPlan().toString()
    pairs = plan[plan.index("CartesianProduct"):]
    assert "Exchange" not in pairs.split("Exchange hashpartitioning(__x", 1)[0] and "FlatMapCoGroups" not in plan
