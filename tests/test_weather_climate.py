import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import by_key
from scarpline import functions as fn
from scarpline import schema as S
from scarpline.operators import climate, nearest, transitions, weather

DAY = dt.date(2020, 1, 1)


def _daily(spark, values, station="s", first=DAY):
    rows = [(station, first + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, S.DAILY_WEATHER)


def _events(spark, rows):
    return spark.createDataFrame(rows, "row_id long, station_id string, event_date date")


def test_rolling_golden(spark):
    daily = _daily(spark, [1.0, 0.0, 5.0, 2.0, 0.0, 7.0])
    events = _events(spark, [(1, "s", DAY + dt.timedelta(days=5)), (2, "none", DAY)])
    stats = by_key(weather.weather_stats(events, daily), "station_id")
    assert (stats["s"]["max_1_day_prcp"], stats["s"]["max_3_day_prcp"]) == (7.0, 9.0)
    assert all(stats["s"][c] == 0.0 for c in S.WEATHER_COLUMNS[2:])
    assert all(stats["none"][c] == 0.0 for c in S.WEATHER_COLUMNS)
    assert stats["s"]["has_weather"] and not stats["none"]["has_weather"]


def _expected(series, event, days_back, max_days, avg_days):
    window = [p or 0.0 for d, p in series if event - dt.timedelta(days=days_back) <= d <= event]
    n, out = len(window), []
    for k in max_days:
        sums = [sum(window[max(0, i - k + 1):i + 1]) for i in range(n)]
        out.append(max(sums) if n >= k else 0.0)
    return out + [sum(window[-k:]) / k if n >= k else 0.0 for k in avg_days]


def test_rolling_equals_loop(spark):
    """Gaps, nulls and negative values, so that partial windows at the start matter."""
    rng = random.Random(7)
    series, daily = {}, []
    for station in ("a", "b"):
        days = sorted(rng.sample(range(120), 80))
        series[station] = [(DAY + dt.timedelta(days=d),
                            rng.choice([None, rng.uniform(-5, 20), 0.0])) for d in days]
        daily += [(station, d, p) for d, p in series[station]]
    events = [(i, rng.choice("ab"), DAY + dt.timedelta(days=rng.randint(-5, 140)))
              for i in range(60)]
    options = dict(days_back=25, max_days=[1, 2, 5, 9], avg_days=[1, 4, 20])
    stats = weather.weather_stats(
        _events(spark, events), spark.createDataFrame(daily, S.DAILY_WEATHER), **options)
    got = by_key(stats, "station_id", "event_date")
    assert len(got) == len({(s, d) for _, s, d in events})
    for (station, date), row in got.items():
        want = _expected(series[station], date, 25, [1, 2, 5, 9], [1, 4, 20])
        names = weather.stat_columns([1, 2, 5, 9], [1, 4, 20])
        assert [row[c] for c in names] == pytest.approx(want, abs=1e-9)


def test_fill_overwrites_all_rows_of_a_key(spark):
    daily = _daily(spark, [3.0])
    events = _events(spark, [(1, "s", DAY), (2, "s", DAY), (3, "other", DAY), (4, None, DAY)])
    known = events.withColumns({c: F.when(F.col("row_id") != 1, F.lit(50.0))
                                for c in S.WEATHER_COLUMNS})
    filled = by_key(weather.fill_missing_weather(known, daily), "row_id")
    assert filled[1]["max_1_day_prcp"] == filled[2]["max_1_day_prcp"] == 3.0
    assert filled[2]["avg_30_day_prcp"] == 0.0
    assert filled[3]["max_1_day_prcp"] == filled[4]["max_1_day_prcp"] == 50.0
    replaced = by_key(weather.replace_weather(events, daily), "row_id")
    assert replaced[3]["max_1_day_prcp"] == 0.0 and replaced[4]["max_1_day_prcp"] is None


def test_centred_rolling_golden(spark):
    rows = [("s", 0.0, 0.0, dt.date(2000 + i // 12, i % 12 + 1, 1), float(i + 1))
            for i in range(14)]
    series = spark.createDataFrame(
        rows, "scenario string, lat double, lon double, time date, pr double")
    rolled = [r["pr"] for r in climate.rolling_sum(series).orderBy("time").collect()]
    assert rolled == [None] * 6 + [78.0, 90.0, 102.0] + [None] * 5


def test_units_and_longitudes(spark):
    row = spark.range(1).select(
        fn.months_total(F.lit(1.0), "kg m-2 s-1").alias("flux"),
        fn.months_total(F.lit(1.0), "mm/month").alias("total"),
        *[fn.lon360(F.lit(x)).alias(f"l{i}") for i, x in enumerate((-120.0, 0.0, 10.0))],
        fn.shift_year(F.lit(dt.date(2024, 2, 29)), 2025).alias("moved"),
        fn.to_number(F.lit("High")).alias("bad"),
    ).first()
    assert row["flux"] == pytest.approx(2_630_016) and row["total"] == 1.0
    assert (row["l0"], row["l1"], row["l2"]) == (240.0, 0.0, 10.0)
    assert row["moved"] == dt.date(2025, 2, 28) and row["bad"] is None


@pytest.mark.parametrize("short", [True, False])
def test_nearest_ties_and_edges(spark, short):
    axis = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "a double")
    targets = [0.5, 1.5, -9.0, 9.0, 0.49, 1.0, None]
    df = spark.createDataFrame([(x,) for x in targets], "x double")
    loaded = nearest.load_axes(axis, {"a": F.col("a")}, 100 if short else 1)["a"]
    rows = nearest.with_nearest(df, F.col("x"), loaded, "near").collect()
    got = {r["x"]: r["near"] for r in rows}
    assert len(rows) == len(targets)
    assert [got[x] for x in targets] == [1.0, 2.0, 0.0, 2.0, 0.0, 1.0, None]


@pytest.mark.parametrize("short", [True, False])
def test_nearest_on_irregular_axis(spark, short):
    rng = random.Random(1)
    axis = sorted({round(rng.expovariate(0.01), 3) for _ in range(900)})
    targets = [round(rng.uniform(-50, 1500), 3) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in targets], "x double")
    loaded = nearest.load_axes(spark.createDataFrame([(a,) for a in axis], "a double"),
                               {"a": F.col("a")}, 10_000 if short else 10)["a"]
    for row in nearest.with_nearest(df, F.col("x"), loaded, "near").collect():
        want = min(axis, key=lambda a: (abs(row["x"] - a), -a))
        assert row["near"] == want


def _grid(spark):
    rows = []
    for scenario, first in (("hist", 2000), ("ssp126", 2002), ("ssp245", 2002)):
        for month in range(36):
            for lat in (10.0, 20.0):
                time = dt.date(first + month // 12, month % 12 + 1, 1)
                rows.append((scenario, time, lat, 240.0, float(month), "mm/month"))
    return spark.createDataFrame(rows, S.CLIMATE_GRID)


def test_scenarios_share_history_without_overlap(spark):
    rolling = climate.process_scenarios(_grid(spark), 3)
    assert {r["scenario"] for r in rolling.select("scenario").distinct().collect()} == {
        "ssp126", "ssp245"}
    assert rolling.count() == 2 * 2 * (24 + 36)
    years = by_key(climate.year_range(rolling), "scenario")
    assert (years["ssp126"]["first_year"], years["ssp126"]["last_year"]) == (2000, 2004)


def test_event_lookup_keeps_every_row(spark):
    rolling = climate.process_scenarios(_grid(spark), 3)
    events = spark.createDataFrame(
        [(1, 14.0, -120.0, dt.date(2003, 6, 10)), (2, None, -120.0, dt.date(2003, 6, 10)),
         (3, 14.0, -120.0, None)],
        "row_id long, Latitude double, Longitude double, event_date date")
    found = by_key(climate.forecast_at_events(events, rolling=rolling), "row_id")
    assert len(found) == 3
    assert found[1]["ssp126_event_precipitation"] == 16.0 + 17.0 + 18.0
    assert found[1]["ssp370_event_precipitation"] is None
    assert found[2]["ssp126_event_precipitation"] is None
    assert found[3]["ssp126_event_precipitation"] is None
    expanded = climate.expand_scenarios(
        events, rolling=rolling, years=[2003, 2004], scenarios=["ssp126", "ssp245"])
    rows = by_key(expanded, "row_id", "scenario", "forecast_year")
    assert len(rows) == 3 * 4
    assert rows[1, "ssp126", 2003]["scenario_precipitation"] == 51.0
    assert rows[1, "ssp126", 2004]["event_date"] == dt.date(2004, 6, 10)
    assert rows[3, "ssp126", 2004]["event_date"] is None


def test_transition_golden(spark):
    pairs = spark.createDataFrame(
        [("s", 1.0, 1.0), ("s", 1.0, 0.0), ("s", 0.0, 1.0), ("s", 0.0, 0.0)],
        "scenario string, original double, predicted double")
    row = transitions.stability_report(transitions.transition_counts(pairs)).first()
    assert tuple(row) == ("s", 4, 1, 1, 1, 1, 0.5, 0.0)


def test_long_axis_decided_one_by_one(spark):
    """A long axis does not move the short one, and an axis without values gives null on either path."""
    grid = spark.createDataFrame([(float(i), float(i % 3), None) for i in range(40)], "a double, b double, c double")
    named = {n: F.col(n) for n in ("a", "b", "c")}
    for limit in (5, 100):
        axes = nearest.load_axes(grid, named, max_values=limit, parts=4)
        assert axes["c"] is None
        rows = spark.createDataFrame([(17.4, 1.6)], "x double, y double")
        for name, target, expected in (("a", "x", 17.0), ("b", "y", 2.0), ("c", "x", None)):
            assert nearest.with_nearest(rows, F.col(target), axes[name], "out").first()["out"] == expected


def test_dates_in_several_forms(spark):
    texts = ["2020-01-15", "01/15/2020", "1/15/2020 12:00:00 AM", "2020-01-15 13:00:00", "2020/1/15", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(fn.to_date(F.col("t"))).collect()]
    assert found == [dt.date(2020, 1, 15)] * 5 + [None, None]
    assert df.agg(fn.unreadable_dates(F.col("t"))).first()[0] == 1


def test_expansion_of_a_series_with_overlap(spark):
    grid = _grid(spark)
    rolling = climate.process_scenarios(grid, 3, drop_overlap=False)
    events = spark.createDataFrame([(1, 38.0, -120.0, dt.date(2020, 6, 15))],
                                   "row_id long, Latitude double, Longitude double, event_date date")
    expanded = climate.expand_scenarios(events, rolling=rolling, years=[2021, 2022])
    assert expanded.count() == 2 * len(S.SCENARIOS)
