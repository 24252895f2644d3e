"""Many fits at once: trees against a plain recursion, both ways of running, and any file layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.operators import boosting, fitting, forest, linear, models
from scarpline.operators.fitting import Job
from scarpline.operators.folds import shuffled_folds

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    generator = np.random.default_rng(3)
    rows = []
    for i in range(700):
        a, b, c = (float(v) for v in (generator.normal(), generator.integers(0, 9), generator.integers(0, 40) / 4))
        y = int((a + b / 4 > 1) != (generator.random() < 0.15))
        rows.append((i, y, a, b, c))
    df = spark.createDataFrame(rows, "row_id long, y int, a double, b double, c double")
    return shuffled_folds(df, "y", "row_id", seed=1).cache()


@pytest.fixture(scope="module")
def table(frame):
    return fitting.training_table(frame, NAMES, "y", "fold").cache()


JOBS = [Job(("a", "b", "c")), *[Job(("a", "b", "c"), k) for k in range(5)], Job(("b", "c")), Job(("a",))]


def test_table_is_held_or_left_by_its_size(table):
    rows = fitting.held_locally(table, 3)
    assert len(rows.key) == 700 and (np.diff(rows.key) >= 0).all()
    assert fitting.held_locally(table, 3, cells=3 * 699) is None
    assert (fitting.sampled(table, rows, 3) == fitting.sampled(table, None, 3)).all()


def test_cut_points_are_half_way_and_few():
    cuts = fitting.cut_points(np.array([[1.0, 5.0], [2.0, 5.0], [4.0, 5.0]]), 256)
    assert [c.tolist() for c in cuts] == [[1.5, 3.0], []]
    many = fitting.cut_points(np.arange(1000.0)[:, None], 8)[0]
    assert len(many) == 7 and fitting.codes_of(np.array([[many[0]]]), [many])[0, 0] == 1
    low, high = 1.0, np.nextafter(1.0, 2)
    assert fitting.between(np.array([low]), np.array([high])) == high


# Forest


def plain_tree(x, y, w, allowed, tried, path):
    """Splits node by node, without depth bound; nested tuples (feature, cut, left, right) or the share of ones."""
    total, ones = w.sum(), (w * y).sum()
    if ones in (0, total):
        return ones / total
    varies = np.array([a and len(set(x[:, f])) > 1 for f, a in enumerate(allowed)])
    may = forest.eligible(np.array([path], dtype=np.uint64), varies[None, :], tried)[0]
    best = None
    for f in np.flatnonzero(may):
        values = np.unique(x[:, f])
        for low, high in zip(values[:-1], values[1:], strict=True):
            cut = float(fitting.between(np.array([low]), np.array([high]))[0])
            left = x[:, f] < cut
            score = 0.0
            for side in (left, ~left):
                n, one = w[side].sum(), (w * y)[side].sum()
                score += (float(one) ** 2 + float(n - one) ** 2) / n
            if best is None or score > best[0]:
                best = score, int(f), cut, left
    if best is None:
        return ones / total
    _, f, cut, left = best
    both = forest.child_paths(np.array([path], dtype=np.uint64))
    sides = [plain_tree(x[s], y[s], w[s], allowed, tried, int(p)) for s, p in zip((left, ~left), both, strict=True)]
    return (f, cut, *sides)


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    at = tree.left[node]
    return (int(tree.feature[node]), float(tree.cut[node]), nested(tree, at), nested(tree, at + 1))


@pytest.mark.parametrize("tried", [1, 2, 3])
def test_grown_tree_equals_plain_recursion(table, tried):
    rows = fitting.held_locally(table, 3).take(np.arange(0, 700, 2))
    for tree in range(4):
        weight, path = forest.draws(rows.key, tree, 42), forest.root_path(tree, 42)
        allowed = np.array([True, True, tree % 2 == 0])
        grown = forest.grow(rows.x, rows.label, weight, allowed, tried, path)
        use = weight > 0
        expected = plain_tree(rows.x[use], rows.label[use], weight[use], allowed, tried, path)
        assert nested(grown) == expected
        assert (forest.unpacked(forest.packed(grown), []).place(rows.x) == grown.place(rows.x)).all()


def test_tree_is_the_same_in_blocks_of_any_size(table, monkeypatch):
    rows = fitting.held_locally(table, 3)
    weight = forest.draws(rows.key, 1, 42)
    grown = [forest.grow(rows.x, rows.label, weight, np.ones(3, bool), 2, 5)]
    for size in (1, 20, 300):
        monkeypatch.setattr(forest, "BLOCK", size)
        grown.append(forest.grow(rows.x, rows.label, weight, np.ones(3, bool), 2, 5))
    assert all(nested(t) == nested(grown[0]) for t in grown)
    assert all(np.allclose(t.gains, grown[0].gains) for t in grown)


def test_eligible_features_are_the_same_for_few_and_many(monkeypatch):
    paths, varies = forest.hashed(np.arange(500), 3), np.random.default_rng(1).random((500, 6)) < 0.7
    few = [forest.eligible(paths, varies, tried) for tried in (1, 2, 6)]
    monkeypatch.setattr(forest, "FEW", 0)
    for tried, found in zip((1, 2, 6), few, strict=True):
        assert (found == forest.eligible(paths, varies, tried)).all()
        assert (found.sum(axis=1) == np.minimum(varies.sum(axis=1), tried)).all()


def test_rows_of_small_nodes_are_shuffled_in_blocks(table, monkeypatch):
    monkeypatch.setattr(forest, "CHUNK", 100)  # rows of several batches meet, and no layout changes the trees
    tops = forest._Tops(table.repartition(3), JOBS[:1], [np.ones(3, bool)], 2, 42, None, 3 * 60, 256)
    while any(tops.open.values()):
        tops._level()
    grafts = tops._grafts()
    plan = grafts._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "drawn#" in plan and "label#" not in plan.split("MapInArrow")[0]
    assert grafts.count() == sum(map(len, tops.finish.values())) > 2


def test_cuts_of_tops_are_settled_on_the_values_of_their_node():
    x = np.array([[1.0, 5.0], [2.0, 5.0], [6.0, 9.0], [7.0, 11.0], [9.0, 30.0]])
    top = forest.Grown(np.array([0, -1, 1, -1, -1]), np.array([5.5, 0, 10, 0, 0]), np.array([1, 0, 3, 0, 0]),
                       np.zeros(5), np.zeros(2))
    node = top.place(x)
    ends = np.array([[[x[node == k, f].min(initial=np.inf), x[node == k, f].max(initial=-np.inf)] for f in (0, 1)]
                     for k in range(5)])
    settled = forest._settled(top, ends.tobytes())
    assert settled.cut.tolist() == [4.0, 0, 10.0, 0, 0] and (settled.place(x) == node).all()


def test_a_task_sends_one_row_of_counts_per_node(table, monkeypatch):
    monkeypatch.setattr(forest, "CHUNK", 50)
    tops = forest._Tops(table.coalesce(1), JOBS[:2], [np.ones(3, bool)] * 2, 3, 42, None, 3 * 60, 256)
    assert "counts#" in _counted_plan(tops, monkeypatch)


def _counted_plan(tops, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    plans, arrow = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: plans.append(
        self._jdf.queryExecution().optimizedPlan().toString()) or arrow(self))
    tops._level()
    return plans[0]


def test_trees_have_no_depth_limit():
    x, y = np.arange(300.0)[:, None], np.arange(300) % 2
    grown = forest.grow(x, y, np.ones(300, int), np.array([True]), 1, 7)
    assert grown.depth() > 40 and (grown.value[grown.place(x)] == y).all()
    assert forest.grow(x, y, np.ones(300, int), np.array([True]), 1, 7, max_depth=5).depth() == 5


def test_bootstrap_draws_are_poisson_and_by_row():
    key = np.arange(200_000)
    drawn = forest.draws(key, 3, 42)
    assert abs(drawn.mean() - 1) < 0.01 and abs((drawn == 0).mean() - np.exp(-1)) < 0.005
    assert (forest.draws(key[::-1], 3, 42) == drawn[::-1]).all()
    assert (forest.draws(key, 4, 42) != drawn).mean() > 0.4


def test_forest_is_the_same_broadcast_or_shuffled_and_on_any_layout(table):
    # Few distinct values, so that bins hold one value each and the tops of the trees are exact too.
    coarse = table.withColumn("x", F.transform("x", lambda v: F.round(v * 4) / 4)).cache()
    held = forest.plant(coarse, NAMES, JOBS, 3, 42)
    for other in (
        forest.plant(coarse, NAMES, JOBS, 3, 42, cells=3 * 60),
        forest.plant(coarse.repartition(5, "label", "x").sortWithinPartitions("x"), NAMES, JOBS, 3, 42),
    ):
        for one, two in zip(held, other, strict=True):
            assert [nested(t) for t in one.trees] == [nested(t) for t in two.trees]
            assert np.allclose(one.importances, two.importances, atol=1e-12)
    bounded = [forest.plant(coarse, NAMES, JOBS[:1], 2, 42, 4, cells=c)[0].trees for c in (None, 3 * 60)]
    assert [nested(t) for t in bounded[0]] == [nested(t) for t in bounded[1]]
    assert max(t.depth() for t in bounded[0]) == 4


def test_forest_leaves_out_fold_and_features(frame):
    fitted = models.fit_many(models.random_forest(20), frame, JOBS, "y", "fold")
    assert [set(m.importances) for m in fitted[-2:]] == [{"b", "c"}, {"a"}]
    assert all(abs(sum(m.importances.values()) - 1) < 1e-9 for m in fitted)
    scores = [r["score"] for r in models.fold_scores(frame, fitted[1:6], "y").collect()]
    assert len(scores) == 5 and 0.65 < min(scores) < max(scores) < 0.95
    seen = fitted[0].predict(frame).where("prediction = y").count() / 700
    assert seen > 0.95  # grown to purity: close to perfect on its own rows


# Boosting


def test_boosting_is_the_same_broadcast_or_staged(table, monkeypatch):
    monkeypatch.setattr(boosting, "CUT_EVERY", 2)
    held = boosting.boost(table, NAMES, JOBS, 5, 3, 0.1, 16)
    other = boosting.boost(table.repartition(3, "x"), NAMES, JOBS, 5, 3, 0.1, 16, cells=10)
    for one, two in zip(held, other, strict=True):
        assert one.start == two.start and (one.importances == two.importances).all()
        for a, b in zip(one.trees, two.trees, strict=True):
            assert all((p == q).all() for p, q in zip(a, b, strict=True))


def test_passes_do_not_grow_with_the_number_of_fits(table, monkeypatch):
    passes = []
    count = boosting._Staged.count
    monkeypatch.setattr(boosting._Staged, "count", lambda self, growing: passes.append(1) or count(self, growing))
    boosting.boost(table, NAMES, JOBS[:1], 2, 2, 0.1, 16, cells=10)
    alone = len(passes)
    boosting.boost(table, NAMES, JOBS, 2, 2, 0.1, 16, cells=10)
    assert len(passes) - alone == alone == 4


@pytest.mark.parametrize(("bins", "depth"), [(30, 3), (300, 3), (30, 6)])
def test_look_ups_place_rows_as_a_walk_does(bins, depth):
    generator = np.random.default_rng(bins)
    codes = generator.integers(0, bins, (500, 3)).astype(np.uint16)
    label = ((codes.sum(axis=1) % 7 < 3) | (codes[:, 0] > bins // 2)).astype(np.int64)
    _, trees = boosting._boost_rows(codes, label, np.ones(3, bool), bins, 20, depth, 0.1)
    columns = np.ascontiguousarray(codes.T.astype(boosting.code_type(bins)))
    steps, margin = boosting._Steps(trees, 0.1, boosting.code_type(bins)), np.zeros(500)
    for tree in trees:
        assert (tree.placed(columns) == tree.place(codes)).all()
        margin = margin + (0.1 * tree.values())[tree.place(codes)]
    assert (steps.added(np.zeros(500), columns) == margin).all()  # bit by bit, in their order


def test_the_smaller_of_two_siblings_is_counted():
    tree = boosting.Tree(np.array([True]), 3)
    cells = np.zeros((1, 3, 3), dtype=np.int64)
    cells[0, :, 0], cells[0, :, 2] = [500, 500, -900], [40, 40, 10]
    cells[0, :, 0] *= 1 << 30
    tree.take({0: cells})
    assert tree.wanted() == [2]  # ten rows to the right of the cut, eighty to the left


def test_rows_of_a_table_beyond_the_bound_are_not_sent_to_the_driver(table, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "toArrow", lambda self: pytest.fail("rows were sent"))
    assert fitting.held_locally(table, 3, cells=3 * 300) is None


def test_one_stump_is_the_best_cut(frame):
    rows = [(r["a"], r["b"], r["c"], r["y"]) for r in frame.collect()]
    x, y = np.array([r[:3] for r in rows]), np.array([r[3] for r in rows])
    rest = y - y.mean()
    best = None
    for f in (1, 2):  # few values, so all cuts are tried
        for low, high in zip(np.unique(x[:, f])[:-1], np.unique(x[:, f])[1:], strict=True):
            left = x[:, f] < (low + high) / 2
            gain = rest[left].sum() ** 2 / left.sum() + rest[~left].sum() ** 2 / (~left).sum()
            if best is None or gain > best[0] + 1e-9:
                best = gain, f, (low + high) / 2, left
    table = fitting.training_table(frame, NAMES, "y")
    model = boosting.boost(table, NAMES, [Job(("b", "c"))], 1, 1, 0.1, 256)[0]
    feature, cut, left, value = model.trees[0]
    _, f, at, side = best
    assert (int(feature[0]), float(cut[0])) == (f, at)
    p = y.mean()
    assert np.allclose(value[1:], [rest[s].sum() / (s.sum() * p * (1 - p)) for s in (side, ~side)], atol=1e-6)
    assert model.importances[f] == 1.0


def test_boosting_learns_and_leaves_out_the_fold(frame):
    fitted = models.fit_many(models.gradient_boosting(30), frame, JOBS, "y", "fold")
    scores = [r["score"] for r in models.fold_scores(frame, fitted[1:6], "y").collect()]
    assert 0.75 < min(scores) < max(scores) < 0.95
    assert fitted[0].importances["a"] > fitted[0].importances["c"]


def test_single_class_and_nulls_are_refused(spark, frame):
    for fit in (models.gradient_boosting(2), models.random_forest(2), models.logistic(), models.ridge()):
        with pytest.raises(ValueError, match="binary target"):
            fit(frame.where("y = 1"), ["a"], "y")
    gaps = frame.withColumn("a", F.when(F.col("b") > 2, F.col("a")))
    with pytest.raises(ValueError, match="nulls"):
        models.gradient_boosting(2)(gaps, ["a"], "y")


def test_stumps_are_the_same_held_or_staged(frame):
    held = models.adaptive_boosting(6, bins=64)(frame, ["b", "c"], "y")
    staged = models.staged_stumps(6, bins=64, cut_every=2)(frame, ["b", "c"], "y")
    assert held.importances == pytest.approx(staged.importances, abs=1e-9)
    both = staged.predict(held.predict(frame).withColumnRenamed("prediction", "held"))
    assert both.where("held != prediction").isEmpty()


# Linear models


def newton(x, y, c):
    design = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], 1 / c), 0)
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        slope = design.T @ (p - y) + penalty * w
        w = w - np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag(penalty), slope)
    return w


def test_logistic_fits_all_jobs_in_the_passes_of_one(frame, table, monkeypatch):
    passes = []
    step = linear._curvature
    monkeypatch.setattr(linear, "_curvature", lambda *a: passes.append(1) or step(*a))
    found = linear.newton_logistic(table, NAMES, JOBS, c=0.5)
    together = len(passes)
    assert together < 12
    rows = fitting.held_locally(table, 3)
    for job, (weights, intercept) in zip(JOBS, found, strict=True):
        seen, at = rows.seen_by(job), [NAMES.index(f) for f in job.features]
        expected = newton(rows.x[seen][:, at], rows.label[seen], 0.5)
        assert np.allclose([*weights, intercept], expected, atol=1e-7)


def test_closed_forms_take_their_part_of_one_aggregation(frame):
    for fit, single in ((models.ridge(2.0), lambda d, f: linear.fit_ridge(d, f, "y", 2.0)),
                        (models.discriminant(), lambda d, f: linear.fit_discriminant(d, f, "y"))):
        for job, model in zip(JOBS, models.fit_many(fit, frame, JOBS, "y", "fold"), strict=True):
            seen = frame if job.held_out is None else frame.where(F.col("fold") != job.held_out)
            weights, _ = single(seen, list(job.features))
            assert list(model.importances.values()) == pytest.approx([abs(w) for w in weights], rel=1e-9)


def test_separable_rows_end(spark):
    df = spark.createDataFrame([(float(i), int(i > 9)) for i in range(20)], "x double, y int")
    model = models.logistic()(df, ["x"], "y")
    assert model.predict(df).where("prediction != y").isEmpty()
