"""Climate-grid and scenario queries.

Analogue: monthly order value per nation and market segment. A nation is a grid cell (five regions
are five latitudes, five nations each are five longitudes), a segment is a scenario; one segment is
moved back by five years and plays the history, which overlaps the scenarios. Customers are events
at coordinates derived from their key, dated by their first order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scarpline import functions as fn
from scarpline import schema as S
from scarpline.operators import climate, transitions
from scarpline.operators.nearest import with_nearest, with_nearest_date
from scarpline.plans.forecast import training_columns
from scarpline.queries.base import load, rounded

SEGMENTS = {
    "BUILDING": "hist", "AUTOMOBILE": "ssp126", "FURNITURE": "ssp245", "HOUSEHOLD": "ssp370",
    "MACHINERY": "ssp585",
}
YEARS = list(range(1993, 2003))
MONTHS = 12
FEATURES = training_columns()


def grid(spark, sf):
    scenario = F.create_map(*[F.lit(x) for pair in SEGMENTS.items() for x in pair])
    joined = (
        load(spark, sf, "orders")
        .join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("scenario", scenario[F.col("c_mktsegment")])
    )
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return joined.groupBy(
        "scenario",
        F.when(F.col("scenario") == "hist", F.add_months(month, -60)).otherwise(month)
        .alias("time"),
        (F.col("n_regionkey") * 10.0 - 20.0).alias("lat"),
        (F.floor(F.col("n_nationkey") / 5) * 72.0).alias("lon"),
        F.when(F.col("scenario") == "ssp585", "mm/month").otherwise("kg m-2 s-1").alias("units"),
    ).agg((F.sum("o_totalprice") / 1e9).alias("pr"))


def events(spark, sf):
    first = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").cast("date").alias("event_date"))
    key = F.col("c_custkey")
    return load(spark, sf, "customer").join(first, "c_custkey", "left").select(
        "c_custkey", "event_date",
        F.when(key % 41 != 0, (key * 37 % 601) / F.lit(1e1) - 30.0).alias("Latitude"),
        ((key * 53 % 3601) / F.lit(1e1) - 180.0).alias("Longitude"),
    )


def monthly_series(spark, sf):
    return rounded(climate.monthly_series(grid(spark, sf)), ["pr"], 4)


def _stitched(spark, sf, drop_overlap):
    series = climate.monthly_series(grid(spark, sf))
    past = series.filter(F.col("scenario") == "hist")
    return climate.stitch(past, series, drop_overlap=drop_overlap)


def stitch_series(spark, sf):
    return rounded(_stitched(spark, sf, True), ["pr"], 4)


def stitch_with_overlap(spark, sf):
    return rounded(_stitched(spark, sf, False), ["pr"], 4)


def rolling(spark, sf):
    return climate.process_scenarios(grid(spark, sf), MONTHS)


def centered_rolling(spark, sf):
    return rounded(rolling(spark, sf), ["pr"], 3)


def centered_rolling_overlap(spark, sf):
    """An odd window over the unchanged overlap, in segment order."""
    rolled = climate.rolling_sum(_stitched(spark, sf, False), 7)
    return rounded(rolled, ["pr"], 3)


def scenario_scan(spark, sf):
    """One scenario of the grid, flattened to rows."""
    return rounded(grid(spark, sf).filter(F.col("scenario") == "ssp245"), ["pr"], 9)


def year_range(spark, sf):
    return climate.year_range(rolling(spark, sf))


def nearest_grid(spark, sf):
    return climate.with_grid_cell(events(spark, sf), climate.grid_axes(grid(spark, sf)))


def nearest_amount(spark, sf):
    """An irregular axis: every customer's balance to the nearest supplier balance."""
    customers = load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return with_nearest(customers, F.col("c_acctbal"), load(spark, sf, "supplier")
                        .select("s_acctbal"), "nearest_balance")


def asof_nearest(spark, sf):
    moved = events(spark, sf).select(
        "c_custkey", F.date_add("event_date", (F.col("c_custkey") % 4000 - 2000).cast("int"))
        .alias("event_date"))
    return with_nearest_date(moved, F.col("event_date"), grid(spark, sf).select("time"),
                             "grid_time")


def climate_enrich(spark, sf):
    rolled, axes = climate.rolling_at_events(events(spark, sf), grid(spark, sf), MONTHS)
    found = climate.forecast_at_events(events(spark, sf), rolling=rolled, axes=axes)
    return rounded(found, list(FEATURES.values()), 3)


def _early_end(spark, sf):
    """The grid with one scenario that ends two years before the others."""
    return grid(spark, sf).where("scenario != 'ssp126' or time < DATE'1996-09-01'")


def climate_enrich_early_end(spark, sf):
    rolled, axes = climate.rolling_at_events(events(spark, sf), _early_end(spark, sf), MONTHS)
    late = events(spark, sf).withColumn("event_date", F.add_months("event_date", 30))
    found = climate.forecast_at_events(late, rolling=rolled, axes=axes)
    return rounded(found, list(FEATURES.values()), 3)


def scenario_expand_early_end(spark, sf):
    rolled, axes = climate.rolling_at_events(events(spark, sf), _early_end(spark, sf), MONTHS)
    expanded = climate.expand_scenarios(events(spark, sf), rolling=rolled, years=YEARS, axes=axes)
    return rounded(expanded, ["scenario_precipitation"], 3)


def scenario_expand(spark, sf):
    rolled, axes = climate.rolling_at_events(events(spark, sf), grid(spark, sf), MONTHS)
    enriched = climate.forecast_at_events(events(spark, sf), rolling=rolled, axes=axes)
    expanded = climate.expand_scenarios(enriched, rolling=rolled, years=YEARS,
                                        feature_map=FEATURES, axes=axes)
    return rounded(expanded, [*FEATURES.values(), "scenario_precipitation"], 3)


def one_scenario(spark, sf):
    expanded = climate.expand_scenarios(events(spark, sf), rolling=rolling(spark, sf), years=YEARS)
    return rounded(climate.scenario_dataset(expanded, "ssp370"), ["ssp370_precipitation"], 3)


def shift_year(spark, sf):
    orders = load(spark, sf, "orders")
    date = F.col("o_orderdate").cast("date")
    return orders.select(
        "o_orderkey",
        *[fn.shift_year(date, y).alias(f"in_{y}") for y in (1999, 2000, 2025, 2100)],
        fn.days_before(date, S.WEATHER_DAYS_BACK).alias("weather_from"),
    )


def parsed_dates(spark, sf):
    """Dates written in four ways, and text that is no date."""
    kind = F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.col("o_orderpriority"))
        .when(kind == 1, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(kind == 2, F.date_format("o_orderdate", "MM/dd/yyyy hh:mm:ss a"))
        .when(kind == 3, F.date_format("o_orderdate", "M/d/yyyy H:mm:ss"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    return load(spark, sf, "orders").select("o_orderkey", fn.to_date(text).alias("date"))


def longitudes(spark, sf):
    return events(spark, sf).select("c_custkey", fn.lon360(F.col("Longitude")).alias("lon360"))


def _future(spark, sf):
    """Orders as events: a rule decides stability before and after a scenario factor."""
    orders = load(spark, sf, "orders")
    factor = {s: 0.02 * (i + 1) for i, s in enumerate(S.SCENARIOS)}
    steps = F.explode(F.array(*[
        F.struct(F.lit(s).alias("s"), F.lit(y).alias("y"), F.lit(f * (y - 2020) / 5).alias("f"))
        for s, f in factor.items() for y in S.FORECAST_YEARS
    ]))
    moved = orders.withColumn("step", steps)
    price = F.col("o_totalprice") * (1.0 + F.col("step.f")) - (F.col("o_orderkey") % 7) * 20000
    return moved.select(
        F.col("o_orderkey").alias("row_id"), F.col("step.s").alias("scenario"),
        F.col("step.y").alias("forecast_year"), _present_class().alias("original"),
        F.when(price < 250000, 1.0).otherwise(0.0).alias("predicted"),
    )


def _present_class():
    return F.when(F.col("o_totalprice") < 250000, 1.0).otherwise(0.0)


def _present(spark, sf):
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), _present_class().alias("original"))

_RATES = ["stability_rate", "stability_change"]


def stability_transitions(spark, sf):
    """The present class travels with the expanded row, as in the stability analysis."""
    counts = transitions.transition_counts(_future(spark, sf), ["scenario", "forecast_year"])
    return rounded(counts, _RATES)


def stability_report(spark, sf):
    """Predictions kept in two tables are aligned by the event key first."""
    pairs = transitions.align_predictions(
        _present(spark, sf), _future(spark, sf).drop("original"))
    return rounded(transitions.stability_report(transitions.transition_counts(pairs)), _RATES)


QUERIES = {
    "climate_monthly_series": monthly_series,
    "climate_scenario_scan": scenario_scan,
    "stitch_series": stitch_series,
    "stitch_with_overlap": stitch_with_overlap,
    "centered_rolling": centered_rolling,
    "centered_rolling_overlap": centered_rolling_overlap,
    "climate_year_range": year_range,
    "longitude_360": longitudes,
    "nearest_grid": nearest_grid,
    "nearest_amount": nearest_amount,
    "asof_nearest": asof_nearest,
    "climate_enrich": climate_enrich,
    "climate_enrich_early_end": climate_enrich_early_end,
    "scenario_expand_early_end": scenario_expand_early_end,
    "shift_year": shift_year,
    "parse_date": parsed_dates,
    "scenario_expand": scenario_expand,
    "scenario_dataset": one_scenario,
    "stability_transitions": stability_transitions,
    "stability_report": stability_report,
}

_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENTS.items())
_GRID = f"""named AS (SELECT *, CASE c_mktsegment {_CASE} END AS scenario,
      CAST(date_trunc('month', o_orderdate) AS DATE) AS month
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
grid AS (SELECT scenario, lat, lon, time, units, sum(o_totalprice) / 1e9 AS pr FROM (
      SELECT scenario, n_regionkey * 1e1 - 2e1 AS lat, (n_nationkey // 5) * 72e0 AS lon,
      CASE WHEN scenario = 'hist' THEN CAST(month - INTERVAL 60 MONTH AS DATE) ELSE month END AS time,
      CASE WHEN scenario = 'ssp585' THEN 'mm/month' ELSE 'kg m-2 s-1' END AS units, o_totalprice
      FROM named) GROUP BY ALL),
series AS (SELECT scenario, lat, lon, time, CASE WHEN units LIKE '%kg m-2 s-1%'
      THEN pr * (CAST(30.44 AS DOUBLE) * 24 * 3600) ELSE pr END AS pr FROM grid)"""
_EVENTS = """events_at AS (SELECT c_custkey, first_date AS event_date,
      CASE WHEN c_custkey % 41 <> 0 THEN (c_custkey * 37 % 601) / 1e1 - 3e1 END AS "Latitude",
      (c_custkey * 53 % 3601) / 1e1 - 18e1 AS "Longitude"
      FROM customer LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_date
      FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"""


def _stitch_sql(drop_overlap: bool) -> str:
    bound = "WHERE h.time < f.start" if drop_overlap else ""
    return f"""stitched AS (
      SELECT f.scenario, h.lat, h.lon, h.time, h.pr, 0 AS segment
      FROM (SELECT * FROM series WHERE scenario = 'hist') h CROSS JOIN
      (SELECT scenario, min(time) AS start FROM series WHERE scenario <> 'hist' GROUP BY 1) f {bound}
      UNION ALL SELECT scenario, lat, lon, time, pr, 1 FROM series WHERE scenario <> 'hist')"""


def _roll_sql(months: int) -> str:
    back = months // 2
    return f"""rolled AS (SELECT scenario, lat, lon, time, segment,
      CASE WHEN count(pr) OVER w = {months} THEN sum(pr) OVER w END AS pr FROM stitched
      WINDOW w AS (PARTITION BY scenario, lat, lon ORDER BY segment, time
      ROWS BETWEEN {back} PRECEDING AND {months - 1 - back} FOLLOWING))"""

_ROLLED = f"{_GRID}, {_stitch_sql(True)}, {_roll_sql(MONTHS)}"


def _nearest(out: str, table: str, key: str, target: str, axis: str, column: str) -> str:
    return (f"{out} AS (SELECT {key}, a AS {out} FROM (SELECT {key}, a, row_number() OVER ("
            f"PARTITION BY {key} ORDER BY abs({target} - a), a DESC) AS rn FROM {table} "
            f"CROSS JOIN (SELECT DISTINCT {column} AS a FROM {axis}) WHERE {target} IS NOT NULL) "
            "WHERE rn = 1)")

_LON360 = "(CASE WHEN \"Longitude\" >= 0 THEN \"Longitude\" ELSE \"Longitude\" + 360 END)"
_CELLS = ", ".join([
    _nearest("grid_lat", "events_at", "c_custkey", '"Latitude"', "grid", "lat"),
    _nearest("grid_lon", "events_at", "c_custkey", _LON360, "grid", "lon"),
])


def _own_months(name: str, days: str) -> str:
    """(day, scenario, month): the nearest month of that scenario, the later one on ties."""
    return f"""{name} AS (SELECT day, scenario, month FROM (SELECT day, scenario, month, row_number() OVER (
      PARTITION BY day, scenario ORDER BY abs(day - month), month DESC) AS rn FROM ({days})
      CROSS JOIN (SELECT DISTINCT scenario, time AS month FROM rolled)) WHERE rn = 1)"""


_AT_EVENTS = f"""{_own_months("at_event", "SELECT DISTINCT event_date AS day FROM events_at WHERE event_date IS NOT NULL")},
found AS (SELECT e.c_custkey, e.event_date, e."Latitude", e."Longitude", grid_lat, grid_lon, """ \
    + ", ".join(f"max(pr) FILTER (WHERE r.scenario = '{s}') AS {c}" for s, c in FEATURES.items()) \
    + """ FROM events_at e LEFT JOIN grid_lat USING (c_custkey) LEFT JOIN grid_lon USING (c_custkey)
      LEFT JOIN at_event a ON a.day = e.event_date
      LEFT JOIN rolled r ON r.scenario = a.scenario AND r.lat = grid_lat AND r.lon = grid_lon AND r.time = a.month
      GROUP BY ALL)"""
# One scenario ends early.
_EARLY = _GRID.replace("FROM named)", "FROM named WHERE scenario <> 'ssp126' OR month < DATE '1996-09-01')")
_EARLY_ROLLED = f"{_EARLY}, {_stitch_sql(True)}, {_roll_sql(MONTHS)}"
_SCENARIO_LIST = ", ".join(f"'{s}'" for s in S.SCENARIOS)
_MOVED = f"""moved AS (SELECT f.*, y AS forecast_year, s AS scenario,
      CAST(event_date + to_years(CAST(y - year(event_date) AS INTEGER)) AS DATE) AS moved_date
      FROM found f CROSS JOIN (SELECT unnest({YEARS}) AS y)
      CROSS JOIN (SELECT unnest([{_SCENARIO_LIST}]) AS s)),
days AS (SELECT DISTINCT moved_date FROM moved WHERE moved_date IS NOT NULL),
{_own_months("near", "SELECT moved_date AS day FROM days")},
expanded AS (SELECT m.*, r.pr AS scenario_precipitation FROM moved m
      LEFT JOIN near n ON m.moved_date = n.day AND n.scenario = m.scenario
      LEFT JOIN rolled r ON r.scenario = m.scenario AND r.lat = m.grid_lat AND r.lon = m.grid_lon
      AND r.time = n.month)"""
_PAIRS = f"""future AS (SELECT o_orderkey, o_totalprice, s AS scenario, y AS forecast_year,
      CASE WHEN o_totalprice * (1 + CAST(0.02 AS DOUBLE) * k * (y - 2020) / 5)
      - (o_orderkey % 7) * 20000 < 250000 THEN 1 ELSE 0 END AS predicted,
      CASE WHEN o_totalprice < 250000 THEN 1 ELSE 0 END AS original
      FROM orders CROSS JOIN (SELECT unnest([{_SCENARIO_LIST}]) AS s, unnest([1, 2, 3, 4]) AS k)
      CROSS JOIN (SELECT unnest({S.FORECAST_YEARS}) AS y))"""


def _transitions(keys: str) -> str:
    return f"""WITH {_PAIRS} SELECT {keys}, count(*) AS total_points,
      count(*) FILTER (WHERE original = 1 AND predicted = 1) AS stable_to_stable,
      count(*) FILTER (WHERE original = 1 AND predicted = 0) AS stable_to_unstable,
      count(*) FILTER (WHERE original = 0 AND predicted = 1) AS unstable_to_stable,
      count(*) FILTER (WHERE original = 0 AND predicted = 0) AS unstable_to_unstable,
      round(avg(predicted), 6) AS stability_rate,
      round(avg(predicted) - avg(original), 6) + 0.0 AS stability_change
      FROM future GROUP BY {keys}"""

_SHOWN = ", ".join(f"round({c}, 3) AS {c}" for c in FEATURES.values())
ORACLE = {
    "climate_monthly_series": f"WITH {_GRID} SELECT scenario, lat, lon, time, round(pr, 4) AS pr "
                              "FROM series",
    "climate_scenario_scan": f"WITH {_GRID} SELECT scenario, lat, lon, time, units, "
                             "round(pr, 9) AS pr FROM grid WHERE scenario = 'ssp245'",
    "stitch_series": f"WITH {_GRID}, {_stitch_sql(True)} SELECT scenario, lat, lon, time, segment, "
                     "round(pr, 4) AS pr FROM stitched",
    "stitch_with_overlap": f"WITH {_GRID}, {_stitch_sql(False)} SELECT scenario, lat, lon, time, "
                           "segment, round(pr, 4) AS pr FROM stitched",
    "centered_rolling": f"WITH {_ROLLED} SELECT scenario, lat, lon, time, round(pr, 3) AS pr "
                        "FROM rolled",
    "centered_rolling_overlap": f"WITH {_GRID}, {_stitch_sql(False)}, {_roll_sql(7)} SELECT "
                                "scenario, lat, lon, time, segment, round(pr, 3) AS pr FROM rolled",
    "climate_year_range": f"WITH {_ROLLED} SELECT scenario, CAST(year(min(time)) AS INTEGER) AS "
                          "first_year, CAST(year(max(time)) AS INTEGER) AS last_year FROM rolled "
                          "GROUP BY scenario",
    "longitude_360": f"WITH {_EVENTS} SELECT c_custkey, {_LON360} AS lon360 FROM events_at",
    "nearest_grid": f"WITH {_GRID}, {_EVENTS}, {_CELLS} SELECT e.*, grid_lat, grid_lon "
                    "FROM events_at e LEFT JOIN grid_lat USING (c_custkey) "
                    "LEFT JOIN grid_lon USING (c_custkey)",
    "nearest_amount": "WITH " + _nearest("near", "customer", "c_custkey", "c_acctbal", "supplier",
                                         "s_acctbal")
                      + " SELECT c_custkey, c_acctbal, near AS nearest_balance "
                        "FROM customer JOIN near USING (c_custkey)",
    "asof_nearest": f"""WITH {_GRID}, {_EVENTS}, shifted AS (SELECT c_custkey,
        event_date + CAST(c_custkey % 4000 - 2000 AS INTEGER) AS event_date FROM events_at),
        {_nearest("near", "shifted", "c_custkey", "event_date", "grid", "time")}
        SELECT c_custkey, event_date, near AS grid_time FROM shifted
        LEFT JOIN near USING (c_custkey)""",
    "climate_enrich": f"WITH {_ROLLED}, {_EVENTS}, {_CELLS}, {_AT_EVENTS} SELECT c_custkey, "
                      f"event_date, \"Latitude\", \"Longitude\", {_SHOWN} FROM found",
    "climate_enrich_early_end": f"""WITH {_EARLY_ROLLED}, {_EVENTS}, late AS (SELECT c_custkey,
        CAST(event_date + INTERVAL 30 MONTH AS DATE) AS event_date, "Latitude", "Longitude" FROM events_at),
        {_CELLS}, {_own_months("near", "SELECT DISTINCT event_date AS day FROM late WHERE event_date IS NOT NULL")}
        SELECT c_custkey, event_date, "Latitude", "Longitude", """ + ", ".join(
        f"round(max(pr) FILTER (WHERE r.scenario = '{s}'), 3) AS {c}" for s, c in FEATURES.items()) + """
        FROM late LEFT JOIN grid_lat USING (c_custkey) LEFT JOIN grid_lon USING (c_custkey)
        LEFT JOIN near ON day = event_date LEFT JOIN rolled r ON r.scenario = near.scenario
        AND r.lat = grid_lat AND r.lon = grid_lon AND r.time = month GROUP BY ALL""",
    "scenario_expand_early_end": f"""WITH {_EARLY_ROLLED}, {_EVENTS}, {_CELLS}, moved AS (SELECT e.*,
        y AS forecast_year, s AS scenario, CAST(event_date + to_years(CAST(y - year(event_date) AS INTEGER))
        AS DATE) AS moved_date FROM events_at e CROSS JOIN (SELECT unnest({YEARS}) AS y)
        CROSS JOIN (SELECT unnest([{_SCENARIO_LIST}]) AS s)),
        {_own_months("near", "SELECT DISTINCT moved_date AS day FROM moved WHERE moved_date IS NOT NULL")}
        SELECT c_custkey, moved_date AS event_date, "Latitude", "Longitude", forecast_year, m.scenario,
        round(pr, 3) AS scenario_precipitation FROM moved m LEFT JOIN grid_lat USING (c_custkey)
        LEFT JOIN grid_lon USING (c_custkey) LEFT JOIN near n ON day = moved_date AND n.scenario = m.scenario
        LEFT JOIN rolled r ON r.scenario = m.scenario AND r.lat = grid_lat AND r.lon = grid_lon
        AND r.time = n.month""",
    "shift_year": "SELECT o_orderkey, " + ", ".join(
        f"CAST(o_orderdate + to_years(CAST({y} - year(o_orderdate) AS INTEGER)) AS DATE) AS in_{y}"
        for y in (1999, 2000, 2025, 2100))
        + f", CAST(o_orderdate AS DATE) - {S.WEATHER_DAYS_BACK} AS weather_from FROM orders",
    "parse_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END "
                  "AS date FROM orders",
    "scenario_expand": f"WITH {_ROLLED}, {_EVENTS}, {_CELLS}, {_AT_EVENTS}, {_MOVED} SELECT "
                       "c_custkey, moved_date AS event_date, \"Latitude\", \"Longitude\", " + ", ".join(
        f"round(CASE WHEN scenario = '{s}' THEN scenario_precipitation ELSE {c} END, 3) AS {c}"
        for s, c in FEATURES.items())
        + ", forecast_year, scenario, round(scenario_precipitation, 3) AS scenario_precipitation "
          "FROM expanded",
    "scenario_dataset": f"WITH {_ROLLED}, {_EVENTS}, {_CELLS}, {_AT_EVENTS}, {_MOVED} SELECT "
                        "c_custkey, moved_date AS event_date, \"Latitude\", \"Longitude\", "
                        "forecast_year, scenario, round(scenario_precipitation, 3) AS "
                        "ssp370_precipitation FROM expanded WHERE scenario = 'ssp370'",
    "stability_transitions": _transitions("scenario, forecast_year"),
    "stability_report": _transitions("scenario"),
}
