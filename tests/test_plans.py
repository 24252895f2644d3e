import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import by_key
from scarpline import schema as S
from scarpline.operators import models
from scarpline.plans import analysis, collection, datasets, forecast
from scarpline.session import broadcast_if_small, cut_lineage
from scarpline.sources import (
    available_scenarios, read_climate_grid, read_daily_weather, read_dem, read_events,
    save_collected, write_table,
)


def test_event_csv_roundtrip(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text(",Latitude,Longitude,event_date,Stability,note,x\n"
                    "0,37.5,-120.9,2020-01-15,1,a,NaN\n1,37.9,,not a date,0,,2.5\n")
    df = read_events(spark, str(path))
    assert df.columns[0] == "Unnamed: 0" and df.columns[-1] == S.ROW_ID
    rows = by_key(df, "Unnamed: 0")
    assert rows[0]["event_date"] == dt.date(2020, 1, 15) and rows[0]["x"] is None
    assert rows[1]["event_date"] is None and rows[1]["Longitude"] is None
    assert rows[0]["note"] == "a" and rows[0]["row_id"] != rows[1]["row_id"]
    with pytest.raises(Exception):
        read_events(spark, str(tmp_path / "absent.csv"))


def test_readers_prune_and_normalise(spark, tmp_path):
    grid = spark.createDataFrame(
        [("hist", dt.date(2000, 1, 1), 1.0, 2.0, float("nan"), "mm"),
         ("ssp245", dt.date(2001, 1, 1), 1.0, 2.0, 3.0, "mm")], S.CLIMATE_GRID)
    grid.write.partitionBy("scenario").parquet(str(tmp_path / "grid"))
    one = read_climate_grid(spark, str(tmp_path / "grid"), "hist")
    assert [r["pr"] for r in one.collect()] == [None]
    assert "PartitionFilters: [isnotnull(scenario" in (
        one._jdf.queryExecution().executedPlan().toString())
    assert available_scenarios(read_climate_grid(spark, str(tmp_path / "grid"))) == [
        "hist", "ssp245"]
    daily = spark.createDataFrame(
        [("s", dt.date(2020, 1, d), float(d)) for d in range(1, 10)], S.DAILY_WEATHER)
    daily.write.parquet(str(tmp_path / "daily"))
    assert read_daily_weather(spark, str(tmp_path / "daily"), "2020-01-03", "2020-01-05").count() == 3
    spark.createDataFrame([(1, 0, 0, -9999.0)], S.DEM_PIXELS).write.parquet(str(tmp_path / "dem"))
    spark.createDataFrame([(1, 0.0, 1.0, 1.0, -1.0, 1, 1, 1.0)], S.DEM_TILES).write.parquet(
        str(tmp_path / "tiles"))
    dem, tiles = read_dem(spark, str(tmp_path / "dem"), str(tmp_path / "tiles"))
    assert dem.first()["elev"] is None and tiles.count() == 1


def test_session_helpers(spark):
    df = spark.range(100)
    assert cut_lineage(df).count() == 100
    assert "ResolvedHint" in broadcast_if_small(df)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_if_small(df, 10)._jdf.queryExecution().analyzed().toString()


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        wet, steep, noise = rng.uniform(0, 40), rng.uniform(0, 50), rng.uniform(0, 1)
        label = int(wet + steep + rng.gauss(0, 6) < 45)
        rows.append((i, dt.date(2020, 1 + i % 12, 1 + i % 28), 37.0 + i % 5, -120.0 - i % 3, label,
                     i, wet if i % 9 else None, steep, noise if i % 2 else None))
    return spark.createDataFrame(rows, (
        "row_id long, event_date date, Latitude double, Longitude double, Stability int, "
        "`Unnamed: 0` int, max_1_day_prcp double, slope double, noise double"))


def _registry():
    return {"gb": models.gradient_boosting(2, 2), "rf": models.random_forest(3, 3),
            "lda": models.discriminant()}


def test_complete_analysis(spark, events, tmp_path):
    prepared = datasets.prepare(events)
    assert prepared.best_threshold is not None
    assert "noise" not in prepared.no_nulls.columns
    result = analysis.run_analysis(prepared, registry=_registry())
    assert set(result.basic) == {"gb_a", "gb_b", "rf_a", "rf_b"}
    assert "slope" in result.optimized.common
    for name in ("no_nans", "optimal"):
        ranks = result.ranking(name).collect()
        assert [r["final_rank"] for r in ranks] == list(range(1, len(ranks) + 1))
        assert result.plots[name].medians.count() == 2 * len(ranks)
        assert result.plots[name].boxes.count() == len(ranks)
    paths = analysis.save_results(result, str(tmp_path / "out"))
    assert len(paths) == 8
    back = spark.read.option("header", True).csv(paths[0])
    assert back.columns == ["feature", "weighted_mean_rank", "final_rank"]
    tables = analysis.summary(result)
    assert tables["rankings"].count() == 2 and tables["scores"].count() == 6


def test_optimize_needs_the_target(events):
    with pytest.raises(ValueError, match="Stability"):
        datasets.optimize_dataset(events.drop("Stability"))


def test_collection_isolates_failures(spark, events, tmp_path):
    tile = [(1, r, c, float(r + c)) for r in range(4) for c in range(4)]
    dem = spark.createDataFrame(tile, S.DEM_PIXELS)
    tiles = spark.createDataFrame([(1, -123.0, 1.0, 41.0, -1.0, 4, 4, 1.0)], S.DEM_TILES)
    daily = spark.createDataFrame([("s", dt.date(2020, 1, 1), 4.0)], S.DAILY_WEATHER)

    def late_failure(df):
        return df.withColumn("soil_x", F.raise_error(F.lit("lost table")).cast("double"))

    collectors = {
        "terrain": lambda df: collection.enrich_terrain(df, dem, tiles),
        "soil": late_failure,
        "weather": lambda df: collection.enrich_weather(
            df.withColumn("station_id", F.lit("s")), daily),
    }
    got = collection.collect_all(events, collectors, ["slope", "soil", "meteostat"],
                                 str(tmp_path / "stage"))
    status = {r["module"]: r["status"] for r in got.status.collect()}
    assert status == {"terrain": "success", "soil": "failed", "weather": "success"}
    assert got.data.count() == 160 and "soil_x" not in got.data.columns
    assert got.data.filter("max_1_day_prcp IS NULL").count() == 0
    report = by_key(collection.validate_collected(got.data), "group", "column")
    assert report["precipitation", "avg_365_day_prcp"]["missing"] == 0
    assert ("terrain", "terrain_aspect") in report
    data, summary = save_collected(got.data, got.status, str(tmp_path / "saved"))
    assert spark.read.option("header", True).csv(data).count() == 160
    assert spark.read.option("header", True).csv(summary).count() == 3
    with pytest.raises(ValueError, match="unknown data type"):
        collection.collect_one(events, collectors, "satellite")
    assert "terrain_aspect" in collection.collect_one(events, collectors, "slope").columns


def test_collection_run(spark, events, tmp_path):
    path = str(tmp_path / "in")
    write_table(events.drop("row_id"), path, "parquet")
    got, report = collection.run_collection(
        spark, path, {"terrain": lambda df: df.withColumn("terrain_x", F.lit(2.0))},
        str(tmp_path / "out"), id_col="`Unnamed: 0`".strip("`"))
    assert by_key(report, "column")["terrain_x"]["mean"] == 2.0
    assert got.status.count() == 1


def test_climate_workflow(spark, events, tmp_path):
    rows = []
    for scenario, first in ((S.HISTORY, 2018), ("ssp126", 2021), ("ssp585", 2021)):
        for month in range(48):
            time = dt.date(first + month // 12, month % 12 + 1, 1)
            rows.append((scenario, time, 38.0, 240.0, 10.0 + month, "mm/month"))
    grid = spark.createDataFrame(rows, S.CLIMATE_GRID)
    full = events.na.fill(0.0)
    run = forecast.climate_workflow(
        full, grid, str(tmp_path / "run"), years=[2022, 2023], fit=models.random_forest(5, 4))
    report = by_key(run.stability.report, "scenario")
    assert set(report) == {"ssp126", "ssp585"}
    for row in report.values():
        parts = [row[f"{a}_to_{b}"] for a in ("stable", "unstable") for b in ("stable", "unstable")]
        assert sum(parts) == row["total_points"] == 320
    assert run.stability.yearly.count() == 4
    assert run.summary.first()["scenarios_processed"] == 2
    saved = spark.read.option("header", True).csv(str(tmp_path / "run" / "stability_predictions"))
    assert saved.count() == 640 and "predicted_stability" in saved.columns
    assert spark.read.option("header", True).csv(str(tmp_path / "run" / "forecast")).count() > 0
    with pytest.raises(ValueError, match="Stability"):
        forecast.climate_workflow(full.drop("Stability"), grid, years=[2022])
    with pytest.raises(ValueError, match="scenarios"):
        forecast.climate_workflow(full, grid.filter("scenario = 'hist'"))


def test_row_id_does_not_depend_on_the_files(spark, events, tmp_path):
    rows = events.drop("row_id").unionByName(events.drop("row_id").limit(3))
    found = []
    for parts in (1, 5):
        path = str(tmp_path / f"in{parts}")
        write_table(rows.repartition(parts), path, "parquet")
        ids = [r[S.ROW_ID] for r in read_events(spark, path).collect()]
        assert len(set(ids)) == len(ids) == 163
        found.append(sorted(ids))
    assert found[0] == found[1]


def test_prepare_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0), (4.0, 5.0)], "a double, b double")
    bundle = datasets.prepare(df, key="none")
    assert bundle.no_nulls.columns == ["b"] and bundle.profile.nulls == {"a": 1, "b": 0}


def test_collection_without_stage_reports_late_failures(events):
    got = collection.collect_all(events, {
        "soil": lambda df: df.withColumn("soil_x", F.raise_error(F.lit("one\ntwo")).cast("double"))})
    row = got.status.first()
    assert row["status"] == "failed" and "one\ntwo" in row["message"] and got.data.count() == 160
