"""Wide tiles over small ones, calendars that end early, resumed collections, selections among equal values."""

import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.operators import climate, distribution, folds, nearest, soil, terrain
from scarpline.plans import collection


def test_one_wide_tile_over_many_small_ones(spark):
    small = spark.range(100_000).select(
        (F.col("id") + 1).cast("int").alias("tile_id"), (F.col("id") % 400 * 1.0).alias("minx"),
        F.lit(0.25).alias("xres"), (F.floor(F.col("id") / 400) * 1.0 + 0.5).alias("maxy"), F.lit(-0.25).alias("yres"),
        F.lit(2).alias("width"), F.lit(2).alias("height"))
    wide = spark.createDataFrame(
        [(0, -500.0, 1.0, 600.0, -1.0, 1100, 1200), (200_000, 900.0, 1e-4, 900.0, -1e-4, 3, 3)], small.schema)
    generator = random.Random(4)
    rows = [(i, generator.uniform(-50, 300), generator.uniform(-50, 450)) for i in range(400)]
    rows += [(1000, 899.99985, 900.00015), (1001, None, 3.0), (1002, 5000.0, 1.0), (1003, 0.4, 7.1), (1004, 0.4, 7.1)]
    points = spark.createDataFrame(rows, "k long, Latitude double, Longitude double")
    found = {r["k"]: (r["tile_id"], r["px"], r["py"]) for r in terrain.locate_pixels(points, wide.unionByName(small)).collect()}
    held = {}
    for k, lat, lon in rows[:400]:
        best = None
        for tile, x, res, y, n, m in (
            (0, -500.0, 1.0, 600.0, 1100, 1200),
            *((400 * row + col + 1, float(col), 0.25, row + 0.5, 2, 2)
              for col in {int(lon), int(lon) + 1, int(lon) - 1} for row in {int(lat), int(lat) + 1, int(lat) - 1}
              if 0 <= col < 400 and 0 <= row < 250),
        ):
            px, py = int((lon - x) / res), int((y - lat) / res)
            if 0 <= px < n and 0 <= py < m:
                candidate = (lon < x or lat > y, tile, px, py)
                best = candidate if best is None else min(best, candidate)
        held[k] = best[1:] if best else (None, None, None)
    assert {k: found[k] for k in held} == held
    assert found[1000] == (200_000, 1, 1) and found[1001] == found[1002] == (None, None, None)
    assert found[1003] == found[1004] and len(found) == len(rows)


def test_each_series_has_its_own_calendar(spark):
    day = datetime.date(2020, 1, 1)
    days = {"long": [0, 31, 60, 91, 400, 4000], "short": [0, 10], "one": [50]}
    table = spark.createDataFrame(
        [(s, day + datetime.timedelta(d)) for s, ds in days.items() for d in ds], "scenario string, time date")
    calendars = nearest.load_calendars(table, "scenario", F.col("time"))
    asked = [(s, d) for s in [*days, "none"] for d in [*range(-40, 500, 7), 2200, 5000, None]]
    rows = spark.createDataFrame(
        [(s, d, None if d is None else day + datetime.timedelta(d)) for s, d in asked], "scenario string, d int, at date")
    found = {(r["scenario"], r["d"]): r["near"] for r in nearest.with_nearest_in(
        rows, F.col("at"), calendars, "near").collect()}
    assert len(found) == len(asked)
    for s, d in asked:
        best = None
        if d is not None and s in days:
            best = day + datetime.timedelta(min(days[s], key=lambda x: (abs(x - d), -x)))
        assert found[s, d] == best, (s, d)
    years = {r["scenario"]: (r["first_year"], r["last_year"]) for r in climate.calendar_years(calendars).collect()}
    assert years == {"long": (2020, 2030), "short": (2020, 2020), "one": (2020, 2020)}


def test_a_scenario_that_ends_early_gives_its_last_month(spark):
    months = [datetime.date(2015 + i // 12, i % 12 + 1, 1) for i in range(12 * 26)]
    rows = [("hist", datetime.date(2014, 12, 1), 0.0, 0.0, 1.0, "mm")]
    rows += [(s, m, 0.0, 0.0, float(m.year), "mm") for s, last in (("ssp126", 2020), ("ssp245", 2040))
             for m in months if m.year <= last]
    grid = spark.createDataFrame(rows, "scenario string, time date, lat double, lon double, pr double, units string")
    events = spark.createDataFrame([(1, datetime.date(2030, 6, 15), 0.1, 0.1)], "row_id int, event_date date, Latitude double, Longitude double")
    rolled, axes = climate.rolling_at_events(events, grid, 1, ["ssp126", "ssp245"])
    row = climate.forecast_at_events(events, rolling=rolled, axes=axes, scenarios=["ssp126", "ssp245"]).first()
    assert (row["ssp126_event_precipitation"], row["ssp245_event_precipitation"]) == (2020.0, 2030.0)
    expanded = climate.expand_scenarios(events, rolling=rolled, axes=axes, scenarios=["ssp126", "ssp245"], years=[2018, 2035])
    assert {(r["scenario"], r["forecast_year"]): r["scenario_precipitation"] for r in expanded.collect()} == {
        ("ssp126", 2018): 2018.0, ("ssp126", 2035): 2020.0, ("ssp245", 2018): 2018.0, ("ssp245", 2035): 2035.0}


def test_a_collection_resumes_after_its_last_committed_stage(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 3) for i in range(20)], "row_id int, x int")
    calls, broken = [], [True]

    def terrain_module(df):
        calls.append("terrain")
        return df.withColumn("t", F.col("x") * 2)

    def weather_module(df):
        calls.append("weather")
        if broken[0]:  # fails while its stage is being written
            return df.withColumn("w", F.raise_error(F.lit("killed")).cast("int"))
        return df.withColumn("w", F.col("t") + 1)

    modules = {"terrain": terrain_module, "weather": weather_module}
    run = lambda table, **more: collection.collect_all(table, modules, stage_dir=str(tmp_path), **more)
    first = run(events)
    assert [(r["module"], r["status"]) for r in first.status.collect()] == [("terrain", "success"), ("weather", "failed")]
    broken[0] = False
    second = run(events.repartition(5))  # the same rows in other files
    assert [r["message"] for r in second.status.collect()] == ["resumed", None]
    assert calls == ["terrain", "weather", "weather"]
    assert sorted(map(tuple, second.data.collect())) == [(i, i % 3, i % 3 * 2, i % 3 * 2 + 1) for i in range(20)]
    assert [r["message"] for r in run(events).status.collect()] == ["resumed", "resumed"] and len(calls) == 3
    run(events, versions={"weather": "2"})
    assert calls[3:] == ["weather"]
    run(events.withColumn("x", F.col("x") + 1))
    assert calls[4:] == ["terrain", "weather"]


@pytest.mark.parametrize("fan_out", [16, 1 << 16])
def test_selection_among_equal_and_extreme_values(spark, fan_out):
    values = [0.0, -0.0, 5e-324, -5e-324, float("inf"), float("-inf"), 1e308, -1e308] + [7.25] * 400 + [
        7.25 + 2**-50 * i for i in range(30)]
    rows = [("k", v) for v in values] + [("one", 3.0), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = [0.0, 0.1, 0.5, 0.96, 1.0]
    found = {r["k"]: r for r in distribution.exact_quantiles(df, ["k"], "v", probs, fan_out).collect()}
    assert set(found) == {"k", "one"} and found["k"]["n"] == len(values)
    ordered = sorted(v + 0.0 for v in values)
    for i, p in enumerate(probs):
        h = (len(ordered) - 1) * p
        low, high = ordered[int(h)], ordered[min(int(h) + 1, len(ordered) - 1)]
        expected = low + (high - low) * (h - int(h))
        assert found["k"][f"q{i}"] == expected or (np.isnan(found["k"][f"q{i}"]) and np.isnan(expected))
    whole = distribution.exact_quantiles(df.where("k = 'k'"), [], "v", [0.5], fan_out).first()
    assert whole["q0"] == 7.25


def test_folds_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "row_id long, Stability int")
    assert folds.contiguous_folds(empty).count() == 0 and folds.shuffled_folds(empty).count() == 0


def test_forecast_table_refuses_an_unknown_variable(spark):
    grid = spark.createDataFrame([], "scenario string, time date, lat double, lon double, pr double, units string")
    with pytest.raises(ValueError, match="no variable"):
        collection.collect_forecast_table(grid, grid, "wind")


@pytest.mark.parametrize("how", ["full", "left"])
def test_joins_with_frequent_keys_equal_plain_joins(spark, how):
    generator = random.Random(6)
    left = [(i, generator.choice(["hot", "hot", "both", None, f"k{i % 40}"])) for i in range(900)] + [(5000, "lone")]
    right = [(generator.choice(["both", "wide", "wide", None, f"k{i % 60}"]), i) for i in range(700)] + [("hot", -1), ("hot", -2)]
    one = spark.createDataFrame(left, "a int, lk string")
    two = spark.createDataFrame(right, "rk string, b int")
    hot = soil.hot_keys({"l": (one, "lk"), "r": (two, "rk")}, at_least=100)
    assert {k: sorted(v) for k, v in hot.items()} == {"l": ["both", "hot"], "r": ["both", "wide"]}
    order = lambda df: sorted(map(str, df.collect()))
    plain = order(one.join(two, F.col("lk") == F.col("rk"), how))
    assert order(soil._outer(one, two, "lk", "rk", how, hot["l"], hot["r"])) == plain
    assert order(soil._outer(one, two, "lk", "rk", how)) == plain


def test_one_component_in_half_of_all_rows_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(soil, "HOT_ROWS", 1000)
    n = 20_000
    components = spark.range(2000).select(F.concat(F.lit("c"), "id").alias("cokey"), F.col("id").alias("v"))
    horizons = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "c7").otherwise(F.concat(F.lit("c"), F.col("id") % 2000)).alias("ch_cokey"),
        F.col("id").alias("h"))
    hot = soil.hot_keys({"h": (horizons, "ch_cokey")})["h"]
    settings = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.enabled": "false",
                "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = soil._outer(components, horizons, "cokey", "ch_cokey", "full", [], hot)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert hot == ["c7"] and sum(sizes) == n + 1000
    assert max(sizes) < 0.05 * sum(sizes)


def _survey(spark, seed):
    """Random survey tables, with null, repeated and unmatched keys."""
    generator = random.Random(seed)
    key = lambda top: generator.choice([None, *range(top)])
    make = lambda n, schema, *tops: spark.createDataFrame(
        [tuple(str(key(t)) if kind == "string" else key(t) for t, kind in zip(tops, schema.split()[1::2], strict=True))
         for _ in range(n)], ", ".join(" ".join(p) for p in zip(schema.split()[::2], schema.split()[1::2], strict=True)))
    return {
        "sacatalog": make(3, "areasymbol int", 3), "legend": make(5, "areasymbol int lkey int", 4, 5),
        "mapunit": make(8, "lkey int mukey int", 6, 8),
        "component": make(14, "mukey int cokey int comppct_r string", 9, 12, 90),
        "comonth": make(8, "comonthkey int cokey int", 7, 14),
        "cosoilmoist": make(7, "comonthkey int soimoistdept_r string soimoistdepb_r string", 8, 50, 20),
        "chorizon": make(16, "cokey int chkey int hzname string claytotal_r string", 14, 9, 5, 60),
        "chtexturegrp": make(9, "chkey int chtgkey int", 11, 6), "chtexture": make(6, "chtgkey int", 7),
        "copmgrp": make(6, "cokey int", 14), "corestrictions": make(6, "cokey int", 14),
    }


@pytest.mark.parametrize("comonth_key", ["cokey", "comonthkey"])
@pytest.mark.parametrize("hot_rows", [2, 100_000])
def test_outer_chain_equals_plain_joins_in_written_order(spark, monkeypatch, comonth_key, hot_rows):
    monkeypatch.setattr(soil, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(soil, "SALTS", 3)
    tables = _survey(spark, hot_rows)
    for name, df in tables.items():
        df.createOrReplaceTempView(f"survey_{name}")
    plain = spark.sql(f"""SELECT mu.mukey, co.cokey, ch.chkey, comppct_r, claytotal_r, hzname
        FROM survey_sacatalog sc FULL JOIN survey_legend lg ON sc.areasymbol = lg.areasymbol
        FULL JOIN survey_mapunit mu ON lg.lkey = mu.lkey FULL JOIN survey_component co ON mu.mukey = co.mukey
        FULL JOIN survey_comonth cm ON co.cokey = cm.{comonth_key}
        FULL JOIN survey_cosoilmoist csm ON cm.comonthkey = csm.comonthkey
        FULL JOIN survey_chorizon ch ON co.cokey = ch.cokey FULL JOIN survey_chtexturegrp ctg ON ch.chkey = ctg.chkey
        FULL JOIN survey_chtexture ct ON ctg.chtgkey = ct.chtgkey FULL JOIN survey_copmgrp pmg ON co.cokey = pmg.cokey
        FULL JOIN survey_corestrictions rt ON co.cokey = rt.cokey""")
    chain = soil.soil_outer_chain(tables, comonth_key).select("mukey", "cokey", "chkey", "prcent", "clay", "hzname")
    order = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert order(chain) == order(plain)


def test_outer_chain_shuffles_horizons_twice(spark):
    """By their own key and by that of their component; their columns then take part in no further shuffle."""
    chain = soil.soil_outer_chain(_survey(spark, 1)).select("mukey", "cokey", "hzname")
    plan = spark._jvm.PythonSQLUtils.explainString(chain._jdf.queryExecution(), "formatted")
    inputs = [step.split("\n")[1] for step in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", step.strip())]
    assert len(inputs) > 8
    assert sum("hzname#" in line for line in inputs) == 2
    assert not any("claytotal" in line or "clay#" in line for line in inputs)
