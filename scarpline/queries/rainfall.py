"""Rainfall queries with the windows of the event table: 400 days back, means over 30 to 365 days.

Analogue: a nation is a station, the daily order value of its customers is the rainfall; there are some
years of it. Customers are events, dated by an order of theirs plus a shift that puts some events before
the first or long after the last day of weather.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scarpline import schema as S
from scarpline.operators import weather
from scarpline.plans import collection
from scarpline.queries.base import load, rounded

PLACE = ["station_id"]
STATS = S.WEATHER_COLUMNS


def daily(spark, sf):
    orders = load(spark, sf, "orders").join(
        load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rain = orders.select(F.col("c_nationkey").alias("station_id"), "o_orderdate", "o_totalprice")
    return weather.daily_totals(rain, PLACE, F.col("o_orderdate"), F.col("o_totalprice"))


def events(spark, sf):
    first = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").cast("date").alias("first_date"))
    shift = (F.col("c_custkey") % 1500 - 200).cast("int")
    return load(spark, sf, "customer").join(first, "c_custkey", "left").select(
        "c_custkey", F.when(F.col("c_custkey") % 37 != 0, F.col("c_nationkey")).alias("station_id"),
        F.date_add("first_date", shift).alias("event_date"),
        *[F.when((F.col("c_custkey") + i) % 9 != 0, F.col("c_acctbal") + i).alias(c) for i, c in enumerate(STATS)],
    )


def window_rows(spark, sf):
    return rounded(weather.weather_window(events(spark, sf), daily(spark, sf)), ["prcp"])


def event_stats(spark, sf):
    return rounded(weather.weather_stats(events(spark, sf), daily(spark, sf)), STATS)


def fill_missing(spark, sf):
    return rounded(weather.fill_missing_weather(events(spark, sf), daily(spark, sf)), STATS)


def replace_all(spark, sf):
    return rounded(weather.replace_weather(events(spark, sf), daily(spark, sf)), STATS)


def collected(spark, sf):
    """The weather module of the collection, with its own windows, filling what is missing."""
    rain = daily(spark, sf)
    columns = collection.Columns(place=PLACE)
    got = collection.collect_all(events(spark, sf), {
        "weather": lambda df: collection.enrich_weather(df, rain, columns=columns)}, ["meteostat"])
    return rounded(got.data, STATS)


QUERIES = {
    "weather_window_400": window_rows,
    "rolling_event_stats_400": event_stats,
    "fill_missing_weather_400": fill_missing,
    "replace_weather_400": replace_all,
    "collect_all_400": collected,
}

_DATED = """daily AS (SELECT c_nationkey AS station_id, CAST(o_orderdate AS DATE) AS date,
      sum(o_totalprice) AS prcp FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
dated AS (SELECT c_custkey, CASE WHEN c_custkey % 37 <> 0 THEN c_nationkey END AS station_id,
      first_date + CAST(c_custkey % 1500 - 200 AS INTEGER) AS event_date, """ + ", ".join(
    f"CASE WHEN (c_custkey + {i}) % 9 <> 0 THEN c_acctbal + {i} END AS {c}" for i, c in enumerate(STATS)) + """
      FROM customer LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_date FROM orders
      GROUP BY o_custkey) ON o_custkey = c_custkey)"""
_GAPS = " OR ".join(f"{c} IS NULL" for c in STATS)


def _window(where: str = "TRUE") -> str:
    return f"""keys AS (SELECT DISTINCT station_id, event_date FROM dated
      WHERE station_id IS NOT NULL AND event_date IS NOT NULL AND ({where})),
joined AS (SELECT k.station_id, k.event_date, d.date, d.prcp FROM keys k
      LEFT JOIN daily d ON k.station_id = d.station_id
      AND d.date BETWEEN k.event_date - {S.WEATHER_DAYS_BACK} AND k.event_date)"""


_STATS = """rolled AS (SELECT station_id, event_date, prcp,
      row_number() OVER (PARTITION BY station_id, event_date ORDER BY date DESC) AS back,
      count(date) OVER (PARTITION BY station_id, event_date) AS n, """ + ", ".join(
    f"sum(prcp) OVER (PARTITION BY station_id, event_date ORDER BY date ROWS {k - 1} PRECEDING) AS s{k}"
    for k in S.MAX_DAYS) + """ FROM joined),
stats AS (SELECT station_id, event_date, """ + ", ".join(
    [f"CASE WHEN max(n) >= {k} THEN max(s{k}) ELSE 0.0 END AS max_{k}_day_prcp" for k in S.MAX_DAYS]
    + [f"CASE WHEN max(n) >= {n} THEN sum(prcp) FILTER (WHERE back <= {n}) / {n} ELSE 0.0 END "
       f"AS avg_{n}_day_prcp" for n in S.AVG_DAYS]
) + ", max(n) > 0 AS has_weather FROM rolled GROUP BY station_id, event_date)"
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in STATS)
_MERGED = "SELECT e.c_custkey, e.station_id, e.event_date, " + ", ".join(
    f"round(CASE WHEN s.station_id IS NOT NULL THEN s.{c} ELSE e.{c} END, 6) AS {c}" for c in STATS
) + " FROM dated e LEFT JOIN stats s ON e.station_id = s.station_id AND e.event_date = s.event_date"

ORACLE = {
    "weather_window_400": f"WITH {_DATED}, {_window()} SELECT station_id, event_date, date, "
                          "round(prcp, 6) AS prcp FROM joined WHERE date IS NOT NULL",
    "rolling_event_stats_400": f"WITH {_DATED}, {_window()}, {_STATS} SELECT station_id, event_date, {_ROUNDED}, "
                               "has_weather FROM stats",
    "fill_missing_weather_400": f"WITH {_DATED}, {_window(_GAPS)}, {_STATS} {_MERGED}",
    "replace_weather_400": f"WITH {_DATED}, {_window()}, {_STATS} {_MERGED}",
}
ORACLE["collect_all_400"] = ORACLE["fill_missing_weather_400"]
