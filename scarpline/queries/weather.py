"""Rainfall queries.

Analogue: a user is a station, the daily sum of ``value`` is the rainfall, and every event is an
event dated 0 to 39 days after it happened, so some keys have little or no weather.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scarpline.operators import weather
from scarpline.queries.base import load, rounded

DAYS_BACK = 20
MAX_DAYS = [1, 3, 7, 14]
AVG_DAYS = [3, 7, 14, 20]
STATS = weather.stat_columns(MAX_DAYS, AVG_DAYS)
_WINDOWS = dict(days_back=DAYS_BACK, max_days=MAX_DAYS, avg_days=AVG_DAYS)
PLACE = ["user_id"]


def daily(spark, sf):
    return weather.daily_totals(load(spark, sf, "events"), PLACE, F.col("ts"), F.col("value"))


def dated_events(spark, sf):
    events = load(spark, sf, "events")
    return events.select(
        "event_id", F.when(F.col("event_id") % 97 != 0, F.col("user_id")).alias("user_id"),
        F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 40).cast("int"))
        .alias("event_date"),
        *[F.when((F.col("event_id") + i) % 9 != 0, F.col("value") + i).alias(c)
          for i, c in enumerate(STATS)],
    )


def window_rows(spark, sf):
    rows = weather.weather_window(dated_events(spark, sf), daily(spark, sf), PLACE,
                                  days_back=DAYS_BACK)
    return rounded(rows, ["prcp"])


def event_stats(spark, sf):
    stats = weather.weather_stats(dated_events(spark, sf), daily(spark, sf), PLACE, **_WINDOWS)
    return rounded(stats, STATS)


def fill_missing(spark, sf):
    filled = weather.fill_missing_weather(dated_events(spark, sf), daily(spark, sf), PLACE,
                                          **_WINDOWS)
    return rounded(filled, STATS)


def replace_all(spark, sf):
    replaced = weather.replace_weather(dated_events(spark, sf), daily(spark, sf), PLACE,
                                       **_WINDOWS)
    return rounded(replaced, STATS)


QUERIES = {
    "weather_window": window_rows,
    "rolling_event_stats": event_stats,
    "fill_missing_weather": fill_missing,
    "replace_weather": replace_all,
}

_DATED = """daily AS (SELECT user_id, CAST(ts AS DATE) AS date, sum(value) AS prcp
      FROM events GROUP BY ALL),
dated AS (SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN user_id END AS user_id,
      CAST(ts AS DATE) + CAST(event_id % 40 AS INTEGER) AS event_date, """ + ", ".join(
    f"CASE WHEN (event_id + {i}) % 9 <> 0 THEN value + {i} END AS {c}"
    for i, c in enumerate(STATS)) + " FROM events)"
_GAPS = " OR ".join(f"{c} IS NULL" for c in STATS)


def _keys(where: str = "TRUE") -> str:
    return (f"keys AS (SELECT DISTINCT user_id, event_date FROM dated "
            f"WHERE user_id IS NOT NULL AND ({where}))")


_JOINED = f"""joined AS (SELECT k.user_id, k.event_date, d.date, d.prcp FROM keys k
      LEFT JOIN daily d ON k.user_id = d.user_id
      AND d.date BETWEEN k.event_date - {DAYS_BACK} AND k.event_date)"""
_ROLLED = """rolled AS (SELECT user_id, event_date, prcp,
      row_number() OVER (PARTITION BY user_id, event_date ORDER BY date DESC) AS back,
      count(date) OVER (PARTITION BY user_id, event_date) AS n, """ + ", ".join(
    f"sum(prcp) OVER (PARTITION BY user_id, event_date ORDER BY date "
    f"ROWS {k - 1} PRECEDING) AS s{k}" for k in MAX_DAYS) + " FROM joined)"
_STATS = "stats AS (SELECT user_id, event_date, " + ", ".join(
    [f"CASE WHEN max(n) >= {k} THEN max(s{k}) ELSE 0.0 END AS max_{k}_day_prcp" for k in MAX_DAYS]
    + [f"CASE WHEN max(n) >= {n} THEN sum(prcp) FILTER (WHERE back <= {n}) / {n} ELSE 0.0 END "
       f"AS avg_{n}_day_prcp" for n in AVG_DAYS]
) + ", max(n) > 0 AS has_weather FROM rolled GROUP BY user_id, event_date)"
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in STATS)
_MERGED = "SELECT e.event_id, e.user_id, e.event_date, " + ", ".join(
    f"round(CASE WHEN s.user_id IS NOT NULL THEN s.{c} ELSE e.{c} END, 6) AS {c}" for c in STATS
) + " FROM dated e LEFT JOIN stats s ON e.user_id = s.user_id AND e.event_date = s.event_date"

ORACLE = {
    "weather_window": f"WITH {_DATED}, {_keys()}, {_JOINED} SELECT user_id, event_date, date, "
                      "round(prcp, 6) AS prcp FROM joined WHERE date IS NOT NULL",
    "rolling_event_stats": f"WITH {_DATED}, {_keys()}, {_JOINED}, {_ROLLED}, {_STATS} "
                           f"SELECT user_id, event_date, {_ROUNDED}, has_weather FROM stats",
    "fill_missing_weather": f"WITH {_DATED}, {_keys(_GAPS)}, {_JOINED}, {_ROLLED}, {_STATS} "
                            f"{_MERGED}",
    "replace_weather": f"WITH {_DATED}, {_keys()}, {_JOINED}, {_ROLLED}, {_STATS} {_MERGED}",
}
