"""Collection jobs, sinks read back, and the sweep on a table whose gaps are NaN.

The weather analogue plays the events; orders play predictions, rolling series and rankings. Sinks
write below the shared folder, one fresh folder per run, and the query returns what is read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scarpline.functions import unreadable_dates
from scarpline.operators import columns, weather
from scarpline.operators.models import ridge
from scarpline.plans import collection
from scarpline.plans.datasets import prepare
from scarpline.queries import models as model_queries
from scarpline.queries import profile as profile_queries
from scarpline.queries import weather as weather_queries
from scarpline.queries.base import load, rounded
from scarpline.session import shared_dir
from scarpline.sources import writers


def _folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/query-{uuid.uuid4().hex}"


def nan_sweep(spark, sf):
    """The incomplete orders with NaN for every missing number: same sweep as with NULL."""
    gaps = profile_queries.incomplete_orders(spark, sf)
    numbers = ["o_totalprice", "c_acctbal"]
    with_nan = gaps.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in numbers})
    return rounded(prepare(with_nan, key="none").sweep, ["weighted_ratio"], 9)


def optimal_columns(spark, sf):
    """Names of the columns that the chosen threshold keeps, in order."""
    chosen = prepare(profile_queries.incomplete_orders(spark, sf), key="none").optimal
    return spark.createDataFrame(list(enumerate(chosen.columns)), "position long, column string")


def _collectors(spark, sf):
    daily = weather_queries.daily(spark, sf)

    def rain(df, days_back=weather_queries.DAYS_BACK):
        return weather.replace_weather(
            df, daily, weather_queries.PLACE, days_back=days_back,
            max_days=weather_queries.MAX_DAYS, avg_days=weather_queries.AVG_DAYS)

    def lost(df):
        return df.withColumn("terrain_slope", F.raise_error(F.lit("lost tile")).cast("double"))

    return {"weather": rain, "terrain": lost}


def collect_all(spark, sf):
    """The weather module under its other name; the terrain module fails while it runs."""
    got = collection.collect_all(
        weather_queries.dated_events(spark, sf), _collectors(spark, sf), ["slope", "meteostat"],
        _folder(spark))
    return rounded(got.data, weather_queries.STATS)


def collect_all_status(spark, sf):
    got = collection.collect_all(weather_queries.dated_events(spark, sf), _collectors(spark, sf))
    return got.status.select("module", "status", F.col("message").contains("lost tile").alias("names_cause"))


def collect_one(spark, sf):
    """One module by its other name, with an option of its own."""
    got = collection.collect_one(
        weather_queries.dated_events(spark, sf), _collectors(spark, sf), "meteostat",
        days_back=weather_queries.DAYS_BACK)
    return rounded(got, weather_queries.STATS)


def requested_features(spark, sf):
    """The requested columns that exist, in the order of the request."""
    parts = load(spark, sf, "part")
    names = columns.existing(parts, ["p_size", "not_there", "p_retailprice", "p_partkey"])
    return parts.select(*names)


def plugged_estimator(spark, sf):
    """An estimator of the caller's own: the ridge plane with every vote turned around."""
    def opposite(df, features, label):
        fitted = ridge()(df, features, label)

        def predict(rows):
            return fitted.predict(rows).withColumn("prediction", 1.0 - F.col("prediction"))

        return type(fitted)(predict, fitted.importances)

    rows = model_queries.labelled_orders(spark, sf)
    fitted = opposite(rows, model_queries.PAIR, model_queries.S.TARGET)
    return fitted.predict(rows).select(model_queries.S.ROW_ID, (1.0 - F.col("prediction")).alias("prediction"))


def date_gaps(spark, sf):
    """How many texts are no date in any known form."""
    text = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).otherwise(
        F.date_format("o_orderdate", "MM/dd/yyyy"))
    return load(spark, sf, "orders").agg(unreadable_dates(text).alias("unreadable"))


def _priced(spark, sf):
    return load(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("scenario"), F.col("o_orderdate").cast("date").alias("time"),
        "o_totalprice")


def collected_sink(spark, sf):
    status = spark.createDataFrame([("weather", "success", None)], "module string, status string, message string")
    data, _ = writers.save_collected(_priced(spark, sf), status, _folder(spark), "parquet")
    return spark.read.parquet(data)


def forecast_sink(spark, sf):
    path = writers.save_forecast(_priced(spark, sf), _folder(spark), 1996, 1998, "parquet")
    return spark.read.parquet(path)


def prediction_sink(spark, sf):
    priced = _priced(spark, sf)
    report = priced.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))
    detail, summary = writers.save_predictions(priced, report, _folder(spark), "parquet")
    counted = spark.read.parquet(summary).withColumnRenamed("scenario", "s")
    return spark.read.parquet(detail).join(counted, F.col("scenario") == F.col("s")).drop("s")


def analysis_sink(spark, sf):
    priced = _priced(spark, sf)
    ranked = priced.groupBy("scenario").agg(F.max("o_totalprice").alias("top"))
    paths = writers.save_analysis(_folder(spark), {"price": ranked}, {"a": priced}, fmt="parquet")
    ranking, table = (spark.read.parquet(p) for p in paths)
    return table.join(ranking.withColumnRenamed("scenario", "s"), F.col("scenario") == F.col("s")).drop("s")


QUERIES = {
    "nan_sweep": nan_sweep,
    "optimal_columns": optimal_columns,
    "collect_all": collect_all,
    "collect_all_status": collect_all_status,
    "collect_one": collect_one,
    "requested_features": requested_features,
    "plugged_estimator": plugged_estimator,
    "date_gaps": date_gaps,
    "collected_sink": collected_sink,
    "forecast_sink": forecast_sink,
    "prediction_sink": prediction_sink,
    "analysis_sink": analysis_sink,
}

_PRICED = """priced AS (SELECT o_orderkey, o_orderstatus AS scenario, CAST(o_orderdate AS DATE) AS time,
      o_totalprice FROM orders)"""

ORACLE = {
    "nan_sweep": profile_queries.ORACLE["null_threshold_sweep"],
    "optimal_columns": profile_queries.CHOSEN_COLUMNS,
    "collect_all": weather_queries.ORACLE["replace_weather"],
    "collect_all_status": "SELECT 'terrain' AS module, 'failed' AS status, true AS names_cause "
                          "UNION ALL SELECT 'weather', 'success', NULL",
    "collect_one": weather_queries.ORACLE["replace_weather"],
    "requested_features": "SELECT p_size, p_retailprice, p_partkey FROM part",
    "plugged_estimator": f"SELECT {model_queries.S.ROW_ID}, prediction FROM ("
                         f"{model_queries.ORACLE['model_ridge']})",
    "date_gaps": "SELECT count(*) FILTER (WHERE o_orderkey % 5 = 0) AS unreadable FROM orders",
    "collected_sink": f"WITH {_PRICED} SELECT * FROM priced",
    "forecast_sink": f"WITH {_PRICED} SELECT * FROM priced WHERE year(time) BETWEEN 1996 AND 1998",
    "prediction_sink": f"WITH {_PRICED} SELECT *, count(*) OVER (PARTITION BY scenario) AS n FROM priced",
    "analysis_sink": f"WITH {_PRICED} SELECT *, max(o_totalprice) OVER (PARTITION BY scenario) AS top FROM priced",
}
