"""Model queries.

Analogue: orders with their customer are events. An order is stable when its price and its
customer's balance together stay low; one order in ten has the opposite label.

The jobs that fit many models (evaluation, selection, drop-column importance, stability model) run twice:
with the models of the registry at their full size, and as ``*_closed`` with closed-form models plugged
in, whose SQL is given below. The SQL of ``model_logistic`` takes the same Newton steps.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scarpline import schema as S
from scarpline.operators import models
from scarpline.plans import analysis, datasets, forecast
from scarpline.queries import climate as climate_queries
from scarpline.queries.base import load, rounded

FEATURES = ["o_totalprice", "c_acctbal", "c_nationkey", "order_month"]
PAIR = ["o_totalprice", "c_acctbal"]
CLOSED = {"ridge": models.ridge(), "lda": models.discriminant()}


def labelled_orders(spark, sf):
    joined = load(spark, sf, "orders").join(
        load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    low = F.col("o_totalprice") + 20 * F.col("c_acctbal") < 330000
    flipped = F.md5(F.col("o_orderkey").cast("string")) < "1a"
    return joined.select(
        F.col("o_orderkey").alias(S.ROW_ID),
        (low != flipped).cast("int").alias(S.TARGET),
        "o_totalprice", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"),
        F.month("o_orderdate").cast("double").alias("order_month"),
    )


def _importances(fit_name):
    def run(spark, sf):
        fitted = models.registry()[fit_name](labelled_orders(spark, sf), FEATURES, S.TARGET)
        return models.importance_table(spark, {fit_name: fitted.importances})
    return run


def _predictions(fit_name):
    def run(spark, sf):
        rows = labelled_orders(spark, sf)
        return models.registry()[fit_name](rows, FEATURES, S.TARGET).predict(rows).select(
            S.ROW_ID, S.TARGET, "prediction")
    return run


def _closed_predictions(fit_name):
    def run(spark, sf):
        rows = labelled_orders(spark, sf)
        return CLOSED[fit_name](rows, PAIR, S.TARGET).predict(rows).select(
            S.ROW_ID, S.TARGET, "prediction")
    return run


def _broken(df, features, label):
    raise ValueError("this estimator\nalways fails")


def model_logistic(spark, sf):
    return _importances("logistic")(spark, sf).withColumn("importance", F.round("importance", 10))


def evaluate_models(spark, sf):
    """The six models on four features."""
    result = models.evaluate_all(labelled_orders(spark, sf), FEATURES)
    return rounded(result.status.join(result.scores, "model", "left"), ["cv_score", "cv_std"])


def evaluate_models_closed(spark, sf):
    """Both closed forms and an estimator that fails, plugged in by name."""
    plugged = {**CLOSED, "broken": _broken}
    result = models.evaluate_all(labelled_orders(spark, sf), PAIR, models=plugged)
    return rounded(result.status.join(result.scores, "model", "left"), ["cv_score", "cv_std"])


def _selection(features, fit):
    def run(spark, sf):
        chosen = models.select_features(labelled_orders(spark, sf), features, fit=fit)
        found = spark.createDataFrame(
            [(f, chosen.initial_score, chosen.final_score) for f in chosen.features],
            "feature string, initial_score double, final_score double")
        return rounded(found, ["initial_score", "final_score"])
    return run


def orders_with_gaps(spark, sf):
    return labelled_orders(spark, sf).withColumns({
        "order_month": F.when(F.col(S.ROW_ID) % 3 != 0, F.col("order_month")),
        "c_nationkey": F.when(F.col(S.ROW_ID) % 7 != 0, F.col("c_nationkey")),
    })


def basic_models(spark, sf):
    """Both importance models on the optimized pair of datasets."""
    prepared = datasets.prepare(orders_with_gaps(spark, sf))
    fits = models.registry()
    pair = datasets.optimize_both(prepared.no_nulls, prepared.optimal, fit=fits["gb"])
    tables = models.basic_importances(
        {"a": (pair.a.data, pair.a.features), "b": (pair.b.data, pair.b.features)},
        models={n: fits[n] for n in ("gb", "rf")})
    parts = [t.withColumn("table", F.lit(n)) for n, t in tables.items()]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def _drop_importance(features, fit):
    def run(spark, sf):
        found = models.drop_importances(labelled_orders(spark, sf), features, fit=fit)
        return rounded(found, ["drop_importance"])
    return run


def _stability(features, fit):
    def run(spark, sf):
        rows = labelled_orders(spark, sf)
        model = models.train_stability_model(rows, features, fit=fit)
        found = model.predict(rows).select(
            S.ROW_ID, S.TARGET, "predicted", F.lit(model.train_accuracy).alias("train_accuracy"),
            F.lit(model.test_accuracy).alias("test_accuracy"), F.lit(model.cv_mean).alias("cv_mean"))
        return rounded(found, ["train_accuracy", "test_accuracy", "cv_mean"])
    return run


def climate_workflow(spark, sf):
    """Customers as events: enrich from the grid, train, expand, predict, count."""
    events = climate_queries.events(spark, sf).select(
        F.col("c_custkey").alias(S.ROW_ID), "event_date", "Latitude", "Longitude",
        (F.col("c_custkey") % 3 == 0).cast("int").alias(S.TARGET),
        *[(F.col("c_custkey") * (i + 1) % 17).cast("double").alias(c)
          for i, c in enumerate(S.WEATHER_COLUMNS)],
    )
    run = forecast.climate_workflow(
        events, climate_queries.grid(spark, sf), years=climate_queries.YEARS,
        fit=models.registry()["rf"])
    return run.stability.report


def complete_analysis(spark, sf):
    """Null sweep to final ranking on orders with gaps: the rankings, then the rows of the plot tables."""
    result = analysis.run_analysis(datasets.prepare(orders_with_gaps(spark, sf)), registry=models.registry())
    merged = result.rankings.withColumn("table", F.lit("rankings"))
    for dataset, plots in result.plots.items():
        for name, table in vars(plots).items():
            part = table.withColumnsRenamed({"Feature": "feature"}).withColumns(
                {"dataset": F.lit(dataset), "table": F.lit(name)})
            merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


QUERIES = {
    "model_gradient_boosting": _importances("gb"),
    "model_random_forest": _importances("rf"),
    "model_logistic": model_logistic,
    "model_ridge": _closed_predictions("ridge"),
    "model_discriminant": _closed_predictions("lda"),
    "model_adaptive_boosting": _predictions("ada"),
    "evaluate_models": evaluate_models,
    "evaluate_models_closed": evaluate_models_closed,
    "select_features": _selection(FEATURES, None),
    "select_features_closed": _selection(PAIR, CLOSED["lda"]),
    "basic_models": basic_models,
    "drop_importance": _drop_importance(FEATURES, None),
    "drop_importance_closed": _drop_importance(PAIR, CLOSED["lda"]),
    "stability_model": _stability(FEATURES, None),
    "stability_model_closed": _stability(PAIR, CLOSED["ridge"]),
    "climate_workflow": climate_workflow,
    "complete_analysis": complete_analysis,
}

_ORDERS = f"""base AS (SELECT o_orderkey AS {S.ROW_ID}, o_totalprice AS x, c_acctbal AS y,
      CAST((o_totalprice + 20 * c_acctbal < 330000) <> (md5(CAST(o_orderkey AS VARCHAR)) < '1a')
      AS INTEGER) AS label FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _fits(train: str) -> str:
    """CTEs from ``train`` (g, x, y, label), the training sets g, to ``fits``: score wx*x + wy*y + b."""
    center = "(n1 - n0) / (n0 + n1)"
    x0, y0 = "(n0 * mx0 + n1 * mx1) / (n0 + n1)", "(n0 * my0 + n1 * my1) / (n0 + n1)"
    prior = "ln(n1 / n0)"
    return f"""moments AS (SELECT g, label, CAST(count(*) AS DOUBLE) AS n, avg(x) AS mx, avg(y) AS my,
      covar_pop(x, x) AS cxx, covar_pop(x, y) AS cxy, covar_pop(y, y) AS cyy FROM {train}
      GROUP BY g, label),
two AS (SELECT a.g, a.n AS n0, b.n AS n1, a.mx AS mx0, b.mx AS mx1, a.my AS my0, b.my AS my1,
      b.mx - a.mx AS gx, b.my - a.my AS gy, a.n * b.n / (a.n + b.n) AS h,
      a.n * a.cxx + b.n * b.cxx AS sxx, a.n * a.cxy + b.n * b.cxy AS sxy,
      a.n * a.cyy + b.n * b.cyy AS syy
      FROM moments a JOIN moments b ON a.g = b.g AND a.label = 0 AND b.label = 1),
systems AS (SELECT *, 'lda' AS model, sxx / (n0 + n1 - 2) AS a, sxy / (n0 + n1 - 2) AS c,
      syy / (n0 + n1 - 2) AS d, gx AS p, gy AS q FROM two UNION ALL
      SELECT *, 'ridge', sxx + h * gx * gx + 1, sxy + h * gx * gy, syy + h * gy * gy + 1,
      2 * h * gx, 2 * h * gy FROM two),
weights AS (SELECT *, 'xy' AS kept, (d * p - c * q) / (a * d - c * c) AS wx,
      (a * q - c * p) / (a * d - c * c) AS wy FROM systems UNION ALL
      SELECT *, 'x', p / a, 0e0 FROM systems UNION ALL SELECT *, 'y', 0e0, q / d FROM systems),
fits AS (SELECT g, model, kept, wx, wy, CASE model
      WHEN 'lda' THEN {prior} - 0.5 * (wx * (mx0 + mx1) + wy * (my0 + my1))
      ELSE {center} - wx * {x0} - wy * {y0} END AS b FROM weights),
best AS (SELECT model, CASE WHEN abs(wx) > abs(wy) THEN 'x' WHEN abs(wx) < abs(wy) THEN 'y'
      ELSE 'xy' END AS kept FROM fits WHERE g = -1 AND kept = 'xy')"""


_VOTE = "CASE WHEN wx * x + wy * y + b > 0 THEN 1e0 ELSE 0e0 END"
_BY_HASH = f"md5('{S.SEED}:' || CAST({S.ROW_ID} AS VARCHAR))"
_EACH_FOLD = "train AS (SELECT k AS g, f.* FROM folded f CROSS JOIN range(-1, 5) r(k) WHERE fold <> k)"
_F1 = """classes AS (SELECT model, kept, fold, class, CAST(count(*) FILTER (WHERE label = class) AS DOUBLE) AS n,
      count(*) FILTER (WHERE prediction = class) AS claimed,
      count(*) FILTER (WHERE label = class AND prediction = class) AS tp
      FROM judged CROSS JOIN (SELECT unnest([0, 1]) AS class) GROUP BY ALL),
by_fold AS (SELECT model, kept, fold, sum(n * coalesce(2e0 * tp / nullif(n + claimed, 0), 0)) / sum(n)
      AS score FROM classes GROUP BY ALL),
scores AS (SELECT model, kept, avg(score) AS score, stddev_pop(score) AS deviation FROM by_fold
      GROUP BY ALL)"""
_JUDGED = f"judged AS (SELECT model, kept, fold, label, {_VOTE} AS prediction FROM folded JOIN fits ON g = fold)"
_SHUFFLED = f"""folded AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {_BY_HASH}) - 1) % 5
      AS fold FROM base)"""
_RUNS = f"folded AS (SELECT *, ntile(5) OVER (PARTITION BY label ORDER BY {S.ROW_ID}) - 1 AS fold FROM base)"
_NAMES = "CASE s.kept WHEN 'x' THEN ['o_totalprice'] WHEN 'y' THEN ['c_acctbal'] ELSE ['o_totalprice', 'c_acctbal'] END"


def _closed_sql(model: str) -> str:
    return (f"WITH {_ORDERS}, train AS (SELECT -1 AS g, * FROM base), {_fits('train')} SELECT {S.ROW_ID}, "
            f"label AS \"{S.TARGET}\", {_VOTE} AS prediction FROM base CROSS JOIN fits "
            f"WHERE model = '{model}' AND kept = 'xy'")


def _newton_sql(steps: int = 9) -> str:
    """Logistic regression on all features: Newton steps in standardised features, each a Gauss elimination."""
    xs = {"o_totalprice": "o_totalprice", "c_acctbal": "c_acctbal", "c_nationkey": "CAST(c_nationkey AS DOUBLE)",
          "order_month": "CAST(month(o_orderdate) AS DOUBLE)"}
    d = len(xs)
    m = range(d + 1)
    ctes = [
        "rows AS MATERIALIZED (SELECT CAST((o_totalprice + 20 * c_acctbal < 330000) <> "
        "(md5(CAST(o_orderkey AS VARCHAR)) < '1a') AS DOUBLE) AS y, "
        + ", ".join(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(xs.values()))
        + " FROM orders JOIN customer ON o_custkey = c_custkey)",
        "stats AS MATERIALIZED (SELECT " + ", ".join(
            f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}" for i in range(d)) + " FROM rows)",
        "z AS MATERIALIZED (SELECT y, " + ", ".join(f"(x{i} - m{i}) / s{i} AS z{i}" for i in range(d))
        + f", 1e0 AS z{d} FROM rows CROSS JOIN stats)",
        "w0 AS MATERIALIZED (SELECT " + ", ".join(f"0e0 AS u{i}" for i in m) + ")",
    ]
    for t in range(steps):
        margin = " + ".join(f"u{i} * z{i}" for i in m)
        sums = [f"sum((p - y) * z{i}) AS g{i}" for i in m]
        sums += [f"sum(p * (1 - p) * z{i} * z{j}) AS h{i}{j}" for i in m for j in m if i <= j]
        first = []  # the system with its penalty
        for i in m:
            penalty = f" / (s{i} * s{i})" if i < d else ""
            first += [f"h{i}{j}{' + 1' + penalty if penalty and i == j else ''} AS a0_{i}{j}" for j in m if i <= j]
            first.append(f"g{i}{' + u' + str(i) + penalty if penalty else ''} AS b0_{i}")
        ctes += [
            f"sums{t} AS MATERIALIZED (SELECT {', '.join(sums)} FROM (SELECT z.*, 1 / (1 + exp(-({margin}))) AS p "
            f"FROM z CROSS JOIN w{t}))",
            f"e{t}_0 AS MATERIALIZED (SELECT {', '.join(first)} FROM sums{t} CROSS JOIN w{t} CROSS JOIN stats)",
        ]
        for k in range(d):  # one feature leaves the rows below it
            out = []
            for i in range(k + 1, d + 1):
                out += [f"a{k}_{i}{j} - a{k}_{k}{i} * a{k}_{k}{j} / a{k}_{k}{k} AS a{k + 1}_{i}{j}"
                        for j in range(i, d + 1)]
                out.append(f"b{k}_{i} - a{k}_{k}{i} * b{k}_{k} / a{k}_{k}{k} AS b{k + 1}_{i}")
            ctes.append(f"e{t}_{k + 1} AS MATERIALIZED (SELECT *, {', '.join(out)} FROM e{t}_{k})")
        back = []
        for i in reversed(m):
            rest = "".join(f" - a{i}_{i}{j} * d{j}" for j in range(i + 1, d + 1))
            back.append(f"(b{i}_{i}{rest}) / a{i}_{i}{i} AS d{i}")
        ctes.append(f"w{t + 1} AS MATERIALIZED (SELECT " + ", ".join(f"u{i} - d{i} AS u{i}" for i in m)
                    + f" FROM (SELECT {', '.join(back)} FROM e{t}_{d}) CROSS JOIN w{t})")
    parts = [f"SELECT 'logistic' AS model, '{name}' AS feature, round(abs(u{i} / s{i}), 10) AS importance "
             f"FROM w{steps} CROSS JOIN stats" for i, name in enumerate(xs)]
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)}"


ORACLE = {
    "model_logistic": _newton_sql(),
    "model_ridge": _closed_sql("ridge"),
    "model_discriminant": _closed_sql("lda"),
    "evaluate_models_closed": f"""WITH {_ORDERS}, {_SHUFFLED}, {_EACH_FOLD}, {_fits('train')}, {_JUDGED}, {_F1}
SELECT s.model, 'success' AS status, CAST(NULL AS VARCHAR) AS message, round(score, 6) AS cv_score,
       round(deviation, 6) AS cv_std FROM scores s JOIN best b ON s.model = b.model AND s.kept = b.kept
UNION ALL SELECT 'broken', 'failed', 'this estimator' || chr(10) || 'always fails', NULL, NULL""",
    "select_features_closed": f"""WITH {_ORDERS}, {_RUNS}, {_EACH_FOLD}, {_fits('train')}, {_JUDGED}, {_F1}
SELECT unnest({_NAMES}) AS feature, round(a.score, 6) AS initial_score, round(s.score, 6) AS final_score
FROM scores s JOIN best b ON s.model = b.model AND s.kept = b.kept
JOIN scores a ON a.model = s.model AND a.kept = 'xy' WHERE s.model = 'lda'""",
    "drop_importance_closed": f"""WITH {_ORDERS}, train AS (SELECT -1 AS g, * FROM base), {_fits('train')},
right_share AS (SELECT kept, avg(CASE WHEN {_VOTE} = label THEN 1e0 ELSE 0e0 END) AS share
      FROM base CROSS JOIN fits WHERE model = 'lda' GROUP BY kept)
SELECT CASE o.kept WHEN 'y' THEN 'o_totalprice' ELSE 'c_acctbal' END AS feature,
       round(a.share - o.share, 6) + 0.0 AS drop_importance
FROM right_share a JOIN right_share o ON a.kept = 'xy' AND o.kept <> 'xy'""",
    "stability_model_closed": f"""WITH {_ORDERS}, split AS (SELECT *, percent_rank() OVER (PARTITION BY label
      ORDER BY {_BY_HASH}) < 0.2 AS is_test FROM base),
folded AS (SELECT *, ntile(5) OVER (PARTITION BY label ORDER BY {S.ROW_ID}) - 1 AS fold FROM split),
train AS (SELECT k AS g, f.* FROM folded f CROSS JOIN range(0, 5) r(k) WHERE fold <> k
      UNION ALL SELECT -2, * FROM folded WHERE NOT is_test), {_fits('train')},
voted AS (SELECT f.*, g, CAST({_VOTE} = label AS INTEGER) AS hit, {_VOTE} AS vote FROM folded f
      JOIN fits ON model = 'ridge' AND kept = 'xy' AND (g = fold OR g = -2)),
shares AS (SELECT avg(hit) FILTER (WHERE g = -2 AND NOT is_test) AS train_share,
      avg(hit) FILTER (WHERE g = -2 AND is_test) AS test_share FROM voted),
runs AS (SELECT avg(share) AS cv FROM (SELECT avg(hit) AS share FROM voted WHERE g = fold GROUP BY fold))
SELECT {S.ROW_ID}, label AS "{S.TARGET}", vote AS predicted, round(train_share, 6) AS train_accuracy,
       round(test_share, 6) AS test_accuracy, round(cv, 6) AS cv_mean
FROM voted CROSS JOIN shares CROSS JOIN runs WHERE g = -2""",
}
