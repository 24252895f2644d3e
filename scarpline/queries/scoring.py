"""Fold, split, metric and moment queries over orders, labels and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from scarpline import functions as fn
from scarpline.operators import folds, linear, metrics, models
from scarpline.operators.columns import split_target
from scarpline.queries.base import load, rounded


def shuffled_folds(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return folds.shuffled_folds(orders, "o_orderstatus", "o_orderkey")


def shuffled_label_folds(spark, sf):
    return folds.shuffled_folds(load(spark, sf, "labels"), "quality", "doc_id", seed=42)


def contiguous_folds(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return folds.contiguous_folds(orders, "o_orderstatus", "o_orderkey")


def stratified_split(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return folds.stratified_split(orders, "o_orderstatus", "o_orderkey")


def _judged(spark, sf):
    """A length rule as the predicted quality of every labelled document, with folds."""
    documents = load(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    judged = load(spark, sf, "labels").join(documents, "doc_id").select(
        "doc_id", "lang", F.col("quality").alias("label"),
        F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("prediction"))
    return folds.shuffled_folds(judged, "label", "doc_id")


def confusion_counts(spark, sf):
    return metrics.confusion(_judged(spark, sf), by=["lang"])


def weighted_f1(spark, sf):
    return rounded(metrics.weighted_f1(_judged(spark, sf)), ["f1_weighted"])


def weighted_f1_by_language(spark, sf):
    return rounded(metrics.weighted_f1(_judged(spark, sf), by=["lang"]), ["f1_weighted"])


def accuracy(spark, sf):
    return rounded(metrics.accuracy(_judged(spark, sf), by=["fold"]), ["accuracy"])


def cv_summary(spark, sf):
    by_fold = metrics.weighted_f1(_judged(spark, sf), by=["fold"])
    return rounded(metrics.cv_summary(by_fold, "f1_weighted"), ["cv_score", "cv_std"])


def stable_flags(spark, sf):
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", fn.is_stable(F.col("l_tax") * 10).alias("stable"))


def feature_target_split(spark, sf):
    lines = load(spark, sf, "lineitem")
    return split_target(lines, ["l_quantity", "l_tax"], "l_returnflag", ["l_orderkey"])


_PAIR = ["l_quantity", "l_tax"]


def _labelled_lines(spark, sf):
    """A label that depends on both features and on the line number, so no plane is perfect."""
    risk = F.col("l_quantity") / 10 + F.col("l_tax") * 50 + F.col("l_linenumber")
    return load(spark, sf, "lineitem").select(*_PAIR, (risk > 9).cast("int").alias("label"))


def ridge_gramian(spark, sf):
    return rounded(linear.gramian(_labelled_lines(spark, sf), _PAIR, "label"), ["value"], 2)


def class_moments(spark, sf):
    table = linear.class_moments(_labelled_lines(spark, sf), _PAIR, "label")
    return rounded(table, [c for c in table.columns if c not in ("label", "n")])


def _plane(spark, weights, intercept):
    rows = [(name, float(w)) for name, w in zip(_PAIR, weights)] + [("1", float(intercept))]
    return rounded(spark.createDataFrame(rows, "term string, weight double"), ["weight"], 5)


def ridge_weights(spark, sf):
    return _plane(spark, *linear.fit_ridge(_labelled_lines(spark, sf), _PAIR, "label"))


def discriminant_weights(spark, sf):
    return _plane(spark, *linear.fit_discriminant(_labelled_lines(spark, sf), _PAIR, "label"))


def _classified(fit, spark, sf):
    """Line counts per label and predicted class of a fitted plane."""
    lines = _labelled_lines(spark, sf)
    return metrics.confusion(fit(lines, _PAIR, "label").predict(lines))


def ridge_predictions(spark, sf):
    return _classified(models.ridge(), spark, sf)


def discriminant_predictions(spark, sf):
    return _classified(models.discriminant(), spark, sf)


QUERIES = {
    "stratified_folds": shuffled_folds,
    "stratified_label_folds": shuffled_label_folds,
    "contiguous_folds": contiguous_folds,
    "stratified_split": stratified_split,
    "confusion_counts": confusion_counts,
    "weighted_f1": weighted_f1,
    "weighted_f1_by_language": weighted_f1_by_language,
    "accuracy": accuracy,
    "cv_summary": cv_summary,
    "stable_flag": stable_flags,
    "feature_target_split": feature_target_split,
    "ridge_gramian": ridge_gramian,
    "class_moments": class_moments,
    "ridge_weights": ridge_weights,
    "discriminant_weights": discriminant_weights,
    "ridge_predictions": ridge_predictions,
    "discriminant_predictions": discriminant_predictions,
}

_JUDGED = """judged AS (SELECT l.doc_id, lang, quality AS label,
      CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS prediction,
      CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(l.doc_id AS VARCHAR))) - 1) % 5
      AS INTEGER) AS fold FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _f1(keys: str) -> str:
    first = f"{keys}, " if keys else ""
    return f"""per_class AS (SELECT {first}class, count(*) FILTER (WHERE label = class) AS support,
      count(*) FILTER (WHERE prediction = class) AS claimed,
      count(*) FILTER (WHERE label = class AND prediction = class) AS tp
      FROM judged CROSS JOIN (SELECT unnest([0, 1]) AS class) GROUP BY {first}class),
f1 AS (SELECT {first}sum(support * coalesce(2e0 * tp / nullif(support + claimed, 0), 0))
      / sum(support) AS f1_weighted FROM per_class {f"GROUP BY {keys}" if keys else ""})"""


_LABELLED = """labelled AS (SELECT l_quantity AS x, l_tax AS y,
      CASE WHEN l_quantity / 10 + l_tax * 50 + l_linenumber > 9 THEN 1 ELSE 0 END AS label
      FROM lineitem)"""
_MOMENTS = f"""{_LABELLED}, moments AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my,
      covar_pop(x, x) AS cxx, covar_pop(x, y) AS cxy, covar_pop(y, y) AS cyy
      FROM labelled GROUP BY label),
two AS (SELECT a.n AS n0, b.n AS n1, a.mx AS mx0, b.mx AS mx1, a.my AS my0, b.my AS my1,
      a.n * a.cxx + b.n * b.cxx AS sxx, a.n * a.cxy + b.n * b.cxy AS sxy,
      a.n * a.cyy + b.n * b.cyy AS syy
      FROM moments a JOIN moments b ON a.label = 0 AND b.label = 1)"""
_RIDGE = f"""{_LABELLED}, centred AS (SELECT x - avg(x) OVER () AS x, y - avg(y) OVER () AS y,
      2 * label - 1 AS t, avg(x) OVER () AS mx, avg(y) OVER () AS my FROM labelled),
sums AS (SELECT sum(x * x) + 1 AS a, sum(x * y) AS b, sum(y * y) + 1 AS d,
      sum(x * t) AS p, sum(y * t) AS q, avg(t) AS mt, max(mx) AS mx, max(my) AS my FROM centred),
solved AS (SELECT (d * p - b * q) / (a * d - b * b) AS wx, (a * q - b * p) / (a * d - b * b) AS wy,
      mt, mx, my FROM sums)"""
_DISCRIMINANT = f"""{_MOMENTS}, pooled AS (SELECT *, sxx / (n0 + n1 - 2) AS a,
      sxy / (n0 + n1 - 2) AS b, syy / (n0 + n1 - 2) AS d, mx1 - mx0 AS p, my1 - my0 AS q FROM two),
solved AS (SELECT (d * p - b * q) / (a * d - b * b) AS wx, (a * q - b * p) / (a * d - b * b) AS wy,
      * FROM pooled)"""
_TERMS = [("1", "1e0"), ("l_quantity", "x"), ("l_tax", "y"), ("y", "(2e0 * label - 1)")]

ORACLE = {
    "stratified_folds": "SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY "
                        "o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR))) - 1) % 5 AS "
                        "INTEGER) AS fold FROM orders",
    "stratified_label_folds": "SELECT *, CAST((row_number() OVER (PARTITION BY quality ORDER BY "
                              "md5('42:' || CAST(doc_id AS VARCHAR))) - 1) % 5 AS INTEGER) AS fold "
                              "FROM labels",
    "contiguous_folds": "SELECT o_orderkey, o_orderstatus, CAST(ntile(5) OVER (PARTITION BY "
                        "o_orderstatus ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders",
    "stratified_split": "SELECT o_orderkey, o_orderstatus, percent_rank() OVER (PARTITION BY "
                        "o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR))) < 0.2 AS is_test "
                        "FROM orders",
    "confusion_counts": f"WITH {_JUDGED} SELECT lang, label, prediction, count(*) AS n FROM judged "
                        "GROUP BY 1, 2, 3",
    "weighted_f1": f"WITH {_JUDGED}, {_f1('')} SELECT round(f1_weighted, 6) AS f1_weighted FROM f1",
    "weighted_f1_by_language": f"WITH {_JUDGED}, {_f1('lang')} SELECT lang, "
                               "round(f1_weighted, 6) AS f1_weighted FROM f1",
    "accuracy": f"WITH {_JUDGED} SELECT fold, round(avg(CASE WHEN label = prediction THEN 1e0 ELSE "
                "0e0 END), 6) AS accuracy FROM judged GROUP BY fold",
    "cv_summary": f"WITH {_JUDGED}, {_f1('fold')} SELECT round(avg(f1_weighted), 6) AS cv_score, "
                  "round(stddev_pop(f1_weighted), 6) AS cv_std FROM f1",
    "stable_flag": "SELECT l_orderkey, l_linenumber, l_tax * 10 >= CAST(0.5 AS DOUBLE) AS stable "
                   "FROM lineitem",
    "feature_target_split": "SELECT l_quantity, l_tax, l_returnflag, l_orderkey FROM lineitem",
    "ridge_gramian": f"WITH {_LABELLED} " + " UNION ALL ".join(
        f"SELECT '{a}' AS i, '{b}' AS j, round(sum({ea} * {eb}), 2) AS value FROM labelled"
        for k, (a, ea) in enumerate(_TERMS) for b, eb in _TERMS[k:]),
    "class_moments": f"WITH {_MOMENTS} SELECT label, n, round(mx, 6) AS m_0, round(my, 6) AS m_1, "
                     "round(cxx, 6) AS c_0_0, round(cxy, 6) AS c_0_1, round(cyy, 6) AS c_1_1 "
                     "FROM moments",
    "ridge_weights": f"WITH {_RIDGE} SELECT 'l_quantity' AS term, round(wx, 5) AS weight FROM "
                     "solved UNION ALL SELECT 'l_tax', round(wy, 5) FROM solved UNION ALL "
                     "SELECT '1', round(mt - wx * mx - wy * my, 5) FROM solved",
    "discriminant_weights": f"WITH {_DISCRIMINANT} SELECT 'l_quantity' AS term, round(wx, 5) AS "
                            "weight FROM solved UNION ALL SELECT 'l_tax', round(wy, 5) FROM solved "
                            "UNION ALL SELECT '1', round(-0.5 * (wx * (mx0 + mx1) + wy * "
                            "(my0 + my1)) + ln(CAST(n1 AS DOUBLE) / n0), 5) FROM solved",
    "ridge_predictions": f"WITH {_RIDGE} SELECT label, CASE WHEN wx * (x - mx) + wy * (y - my) + mt "
                         "> 0 THEN 1e0 ELSE 0e0 END AS prediction, count(*) AS n "
                         "FROM labelled CROSS JOIN solved GROUP BY 1, 2",
    "discriminant_predictions": f"WITH {_DISCRIMINANT} SELECT label, CASE WHEN wx * x + wy * y - 0.5 "
                                "* (wx * (mx0 + mx1) + wy * (my0 + my1)) + "
                                "ln(CAST(n1 AS DOUBLE) / n0) > 0 THEN 1e0 ELSE 0e0 END AS "
                                "prediction, count(*) AS n FROM labelled CROSS JOIN solved "
                                "GROUP BY 1, 2",
}
