"""Whole jobs with a closed-form model, so that SQL can follow them from the grid to the report.

Events, grid and scenarios are those of the climate queries. The events carry no rainfall columns, so the
four scenario columns are the features.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scarpline import schema as S
from scarpline.operators import models
from scarpline.plans import collection, forecast
from scarpline.queries import climate as C
from scarpline.queries import jobs
from scarpline.queries import rainfall
from scarpline.queries.base import rounded


def _run(spark, sf):
    events = C.events(spark, sf).select(
        F.col("c_custkey").alias(S.ROW_ID), "event_date", "Latitude", "Longitude",
        (F.col("c_custkey") % 3 == 0).cast("int").alias(S.TARGET))
    return forecast.climate_workflow(
        events, C.grid(spark, sf), years=C.YEARS, fit=models.ridge(), months=C.MONTHS)


def climate_workflow_closed(spark, sf):
    return rounded(_run(spark, sf).stability.report, ["stability_rate", "stability_change"])


def stability_by_year(spark, sf):
    return rounded(_run(spark, sf).stability.yearly, ["stability_rate", "stability_change"])


def forecast_dataset(spark, sf):
    return rounded(_run(spark, sf).forecast_events, list(C.FEATURES.values()), 3)


def forecast_run_summary(spark, sf):
    return _run(spark, sf).summary


def forecast_table_of_variable(spark, sf):
    """A variable of another name than the default, saved and read back."""
    folder = jobs._folder(spark)
    named = C.grid(spark, sf).withColumnRenamed("pr", "wetness").withColumn("units", F.lit("mm/month"))
    collection.collect_forecast_table(C.events(spark, sf), named, "wetness", folder)
    found = spark.read.option("header", True).csv(f"{folder}/weather_forecast_data")
    names = [f"{s}_event_wetness" for s in S.SCENARIOS]
    return rounded(found.select(
        F.col("c_custkey").cast("long").alias("c_custkey"), *[F.col(n).cast("double").alias(n) for n in names]), names, 6)


def collection_run(spark, sf):
    """Read, enrich, save and validate; the second run resumes the stage of the first."""
    folder = jobs._folder(spark)
    rainfall.events(spark, sf).write.parquet(f"{folder}/events")
    daily = rainfall.daily(spark, sf)
    calls = []

    def rain(df):
        calls.append(1)
        return collection.enrich_weather(df, daily, columns=collection.Columns(place=rainfall.PLACE))

    for output in ("first", "second"):
        collected, report = collection.run_collection(
            spark, f"{folder}/events", {"weather": rain}, f"{folder}/{output}", ["weather"], f"{folder}/stages",
            id_col="c_custkey")
    status = collected.status.first()
    return rounded(report, ["mean", "min", "max"], 4).select(
        "column", "count", "mean", "min", "max", F.lit(status["message"]).alias("second_run"),
        F.lit(len(calls)).alias("times_computed"))


QUERIES = {
    "climate_workflow_closed": climate_workflow_closed,
    "stability_by_year": stability_by_year,
    "forecast_dataset": forecast_dataset,
    "forecast_run_summary": forecast_run_summary,
    "forecast_table_of_variable": forecast_table_of_variable,
    "collection_run": collection_run,
}


def _ridge_sql() -> str:
    """weights (w0..w3, b) from train (label, x0..x3), by elimination of the normal equations."""
    d = len(C.FEATURES)
    span = range(d)
    moments = ", ".join([f"avg(x{i}) AS m{i}" for i in span] + [
        f"covar_pop(x{i}, x{j}) AS c{i}{j}" for i in span for j in span if i <= j])
    parts = [f"moments AS MATERIALIZED (SELECT label, CAST(count(*) AS DOUBLE) AS n, {moments} FROM train GROUP BY label)"]
    first = [f"n0 * p.c{i}{j} + n1 * q.c{i}{j} + n0 * n1 / (n0 + n1) * (q.m{i} - p.m{i}) * (q.m{j} - p.m{j})"
             f"{' + 1' if i == j else ''} AS a0_{i}{j}" for i in span for j in span if i <= j]
    first += [f"2 * n0 * n1 / (n0 + n1) * (q.m{i} - p.m{i}) AS b0_{i}" for i in span]
    first += [f"(n0 * p.m{i} + n1 * q.m{i}) / (n0 + n1) AS z{i}" for i in span]
    parts.append(f"e0 AS MATERIALIZED (SELECT (n1 - n0) / (n0 + n1) AS middle, {', '.join(first)} FROM "
                 "(SELECT *, n AS n0 FROM moments WHERE label = 0) p CROSS JOIN "
                 "(SELECT *, n AS n1 FROM moments WHERE label = 1) q)")
    for k in range(d - 1):
        out = []
        for i in range(k + 1, d):
            out += [f"a{k}_{i}{j} - a{k}_{k}{i} * a{k}_{k}{j} / a{k}_{k}{k} AS a{k + 1}_{i}{j}" for j in range(i, d)]
            out.append(f"b{k}_{i} - a{k}_{k}{i} * b{k}_{k} / a{k}_{k}{k} AS b{k + 1}_{i}")
        parts.append(f"e{k + 1} AS MATERIALIZED (SELECT *, {', '.join(out)} FROM e{k})")
    back = []
    for i in reversed(span):
        rest = "".join(f" - a{i}_{i}{j} * w{j}" for j in range(i + 1, d))
        back.append(f"(b{i}_{i}{rest}) / a{i}_{i}{i} AS w{i}")
    lean = " - ".join(["middle", *[f"w{i} * z{i}" for i in span]])
    parts.append(f"weights AS MATERIALIZED (SELECT *, {lean} AS b FROM (SELECT *, {', '.join(back)} FROM e{d - 1}))")
    return ", ".join(parts)


_COLUMNS = list(C.FEATURES.values())
_ALL = f"{C._ROLLED}, {C._EVENTS}, {C._CELLS}, {C._AT_EVENTS}"
_SCORE = " + ".join(["b", *[f"w{i} * coalesce({c}, 0)" for i, c in enumerate(_COLUMNS)]])
_MOVED_SCORE = " + ".join(["b", *[
    f"w{i} * coalesce(CASE WHEN scenario = '{s}' THEN scenario_precipitation ELSE {c} END, 0)"
    for i, (s, c) in enumerate(C.FEATURES.items())]])
_PREDICTED = f"""{_ALL}, {C._MOVED}, complete AS (SELECT c_custkey, CAST(c_custkey % 3 = 0 AS INTEGER) AS label, """ + ", ".join(
    f"{c} AS x{i}" for i, c in enumerate(_COLUMNS)) + " FROM found WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in _COLUMNS) + f"""),
split AS (SELECT *, percent_rank() OVER (PARTITION BY label
      ORDER BY md5('{S.SEED}:' || CAST(c_custkey AS VARCHAR))) < {S.TEST_SHARE} AS is_test FROM complete),
train AS (SELECT * FROM split WHERE NOT is_test), {_ridge_sql()},
judged AS (SELECT scenario, forecast_year, CAST({_SCORE} > 0 AS INTEGER) AS original,
      CAST({_MOVED_SCORE} > 0 AS INTEGER) AS predicted FROM expanded CROSS JOIN weights)"""


def _report(keys: str) -> str:
    return f"""WITH {_PREDICTED} SELECT {keys}, count(*) AS total_points,
      count(*) FILTER (WHERE original = 1 AND predicted = 1) AS stable_to_stable,
      count(*) FILTER (WHERE original = 1 AND predicted = 0) AS stable_to_unstable,
      count(*) FILTER (WHERE original = 0 AND predicted = 1) AS unstable_to_stable,
      count(*) FILTER (WHERE original = 0 AND predicted = 0) AS unstable_to_unstable,
      round(avg(predicted), 6) AS stability_rate,
      round(avg(predicted) - avg(original), 6) + 0.0 AS stability_change FROM judged GROUP BY {keys}"""


_PLAIN = C._ROLLED.replace("THEN 'mm/month' ELSE 'kg m-2 s-1' END", "THEN 'mm/month' ELSE 'mm/month' END")
ORACLE = {
    "climate_workflow_closed": _report("scenario"),
    "stability_by_year": _report("scenario, forecast_year"),
    "forecast_dataset": f"WITH {_ALL} SELECT c_custkey AS {S.ROW_ID}, event_date, \"Latitude\", \"Longitude\", "
                        f"CAST(c_custkey % 3 = 0 AS INTEGER) AS \"{S.TARGET}\", {C._SHOWN} FROM found",
    "forecast_run_summary": "SELECT count(*) AS input_rows, 4 AS scenarios_processed, 4 AS features_used FROM customer",
    "forecast_table_of_variable": f"WITH {_PLAIN}, {C._EVENTS}, {C._CELLS}, {C._AT_EVENTS} SELECT c_custkey, " + ", ".join(
        f"round({c}, 6) AS {s}_event_wetness" for s, c in C.FEATURES.items()) + " FROM found",
    "collection_run": "WITH filled AS (" + rainfall.ORACLE["fill_missing_weather_400"].replace("round(", "(").replace(", 6) AS", ") AS")
    + ") " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(min({c}), 4) AS min, "
        f"round(max({c}), 4) AS max, 'resumed' AS second_run, 1 AS times_computed FROM filled" for c in rainfall.STATS),
}
