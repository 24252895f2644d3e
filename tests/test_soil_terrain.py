import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import by_key
from scarpline import schema as S
from scarpline.operators import soil, terrain

POINT = "latitude double, longitude double, "


def test_weighted_mean_golden(spark):
    rows = [(1.0, 2.0, 60.0, 20.0, None, "b"), (1.0, 2.0, 40.0, None, None, "a"),
            (1.0, 2.0, 40.0, 30.0, None, None), (None, 2.0, 40.0, 30.0, None, None)]
    df = spark.createDataFrame(
        rows, POINT + "prcent double, clay double, sand double, hydgrp string")
    row = soil.aggregate_soil(df).first()
    assert row["clay"] == pytest.approx(17.142857, abs=1e-6)
    assert row["prcent"] == pytest.approx(48.571429, abs=1e-6)
    assert row["sand"] == 0.0 and row["hydgrp"] == "a"
    assert soil.aggregate_soil(df).count() == 1
    rescaled = soil.aggregate_soil(df, renormalize=True).first()
    assert rescaled["clay"] == pytest.approx((20 * 60 + 30 * 40) / 100)


def test_equal_weights_where_percent_is_useless(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 0.0, 4.0), (1.0, 1.0, None, 8.0), (1.0, 1.0, 0.0, None)],
        POINT + "prcent double, clay double")
    assert soil.aggregate_soil(df).first()["clay"] == pytest.approx(4.0)
    assert soil.aggregate_soil(df.drop("prcent")).first()["clay"] == pytest.approx(4.0)
    assert soil.aggregate_soil(df, "mean").first()["clay"] == 6.0
    assert soil.aggregate_soil(df, "max").first()["clay"] == 8.0
    assert soil.aggregate_soil(df, "surprise").first()["clay"] == 6.0


def test_primary_properties_coerce(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, "c1", "High", "3.5", "B", 9)],
        POINT + "cokey string, runoff string, clay string, hydgrp string, other int")
    row = soil.primary_properties(df).first()
    assert row["runoff"] is None and row["clay"] == 3.5 and "other" not in row.asDict()
    assert soil.primary_properties(df, strict_compat=False).first()["runoff"] == "High"


def _tables(spark):
    make = spark.createDataFrame
    return {
        "sacatalog": make([("CA1",)], "areasymbol string"),
        "legend": make([("CA1", 1), ("CA2", 2)], "areasymbol string, lkey int"),
        "mapunit": make([(1, 10), (2, 20), (9, 90)], "lkey int, mukey int"),
        "component": make([(10, 100, "70"), (10, 101, "30"), (20, 200, "100"), (77, 700, "1")],
                          "mukey int, cokey int, comppct_r string"),
        "comonth": make([(5, 100)], "comonthkey int, cokey int"),
        "cosoilmoist": make([(5, "30", "10")],
                            "comonthkey int, soimoistdept_r string, soimoistdepb_r string"),
        "chorizon": make([(100, 1, "A", "20"), (100, 2, "B", "40"), (101, 3, "A", "10")],
                         "cokey int, chkey int, hzname string, claytotal_r string"),
        "chtexturegrp": make([(1, 1), (1, 2)], "chkey int, chtgkey int"),
        "chtexture": make([(1,)], "chtgkey int"),
        "copmgrp": make([(101,), (101,)], "cokey int"),
        "corestrictions": make([(100,)], "cokey int"),
    }


def test_left_chain_equals_filtered_outer_chain(spark):
    tables = _tables(spark)
    wanted = spark.createDataFrame([(1.0, 1.0, 10), (2.0, 2.0, 20), (3.0, 3.0, 90)],
                                   POINT + "mukey int")
    outer = soil.soil_outer_chain(tables).join(wanted.select("mukey"), "mukey", "left_semi")
    left = soil.soil_of_mapunits(tables, wanted)
    assert left.columns == outer.columns
    key = lambda r: str(tuple(r))
    assert sorted(map(key, left.collect())) == sorted(map(key, outer.collect()))
    assert left.filter("chkey = 1").count() == 2
    assert soil.soil_of_mapunits(tables, wanted, distinct=True).filter("chkey = 1").count() == 1
    assert left.filter("chkey = 1").first()["wetting_front"] == 20.0


def test_point_without_soil_keeps_a_row(spark):
    points = spark.createDataFrame([(1.0, 1.0), (8.0, 8.0)], POINT[:-2])
    wanted = spark.createDataFrame([(1.0, 1.0, 20)], POINT + "mukey int")
    rows = soil.soil_at_points(points, wanted, _tables(spark)).collect()
    assert {(r["latitude"], r["cokey"]) for r in rows} == {(1.0, 200), (8.0, None)}


def _raster(spark, heights, tile=1):
    rows = [(tile, r, c, z) for r, line in enumerate(heights) for c, z in enumerate(line)]
    return spark.createDataFrame(rows, S.DEM_PIXELS)


def _tile(spark, height, width, tile=1, minx=-121.0, res=0.5, maxy=38.0):
    return spark.createDataFrame(
        [(tile, minx, res, maxy, -res, width, height, 1.0)], S.DEM_TILES)


def test_plane_golden(spark):
    dem = _raster(spark, [[2.0 * c + r for c in range(5)] for r in range(4)])
    shapes = by_key(terrain.terrain_stencil(dem, _tile(spark, 4, 5)), "row", "col")
    assert len(shapes) == 20
    inner = shapes[1, 2]
    assert inner["slope_degrees"] == pytest.approx(65.905157, abs=1e-6)
    assert inner["planform_curvature"] == inner["profile_curvature"] == 0.0
    # The ground falls to the west, and half as fast to the north.
    assert inner["aspect"] == pytest.approx(270 + math.degrees(math.atan(0.5)))
    for edge in ((0, 2), (3, 2), (1, 0), (1, 4)):
        assert shapes[edge]["slope_degrees"] is None


def test_flat_and_bowl(spark):
    flat = _raster(spark, [[7.0] * 3] * 3)
    row = by_key(terrain.terrain_stencil(flat, _tile(spark, 3, 3)), "row", "col")[1, 1]
    assert (row["slope_degrees"], row["aspect"], row["profile_curvature"]) == (0.0, None, 0.0)
    # z = x^2 on a slope along x: the profile follows the bend, the contours are straight.
    bowl = _raster(spark, [[float(c * c) for c in range(5)] for _ in range(3)])
    row = by_key(terrain.terrain_stencil(bowl, _tile(spark, 3, 5)), "row", "col")[1, 3]
    assert row["profile_curvature"] == pytest.approx(-2.0)
    assert row["planform_curvature"] == pytest.approx(0.0)


def _rough(spark, height=11, width=13):
    rng = random.Random(3)
    return _raster(spark, [
        [None if rng.random() < 0.05 else rng.uniform(0, 50) for _ in range(width)]
        for _ in range(height)])


def test_blocks_do_not_change_the_stencil(spark, monkeypatch):
    dem, tiles = _rough(spark), _tile(spark, 11, 13)
    whole = by_key(terrain.terrain_stencil(dem, tiles), "row", "col")
    monkeypatch.setattr(terrain, "BLOCK", 3)
    assert by_key(terrain.terrain_stencil(dem, tiles), "row", "col") == whole


def test_gap_is_no_neighbour(spark):
    dem = _raster(spark, [[1.0] * 4] * 4).filter("NOT (row = 1 AND col = 1)")
    shapes = by_key(terrain.terrain_stencil(dem, _tile(spark, 4, 4)), "row", "col")
    assert shapes[2, 2]["slope_degrees"] is None


def test_stencil_shuffles_pixels_once(spark):
    plan = terrain.terrain_stencil(_rough(spark), _tile(spark, 11, 13))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_points_read_the_same_attributes(spark):
    dem, tiles = _rough(spark), _tile(spark, 11, 13)
    rng = random.Random(5)
    points = spark.createDataFrame(
        [(i, rng.uniform(32, 39), rng.uniform(-122, -114)) for i in range(80)],
        "row_id long, Latitude double, Longitude double")
    located = terrain.locate_pixels(points, tiles)
    direct = terrain.lookup_pixels(located, terrain.terrain_stencil(dem, tiles),
                                   S.TERRAIN_ATTRIBUTES)
    names = ["row_id", *S.TERRAIN_ATTRIBUTES]
    at_points = terrain.terrain_at_points(points, dem, tiles)
    assert by_key(at_points.select(*names), "row_id") == by_key(direct.select(*names), "row_id")
    assert at_points.count() == 80


def test_pixel_golden_and_overlap(spark):
    tiles = _tile(spark, 4, 4).union(_tile(spark, 4, 4, tile=2, minx=-119.0))
    points = spark.createDataFrame(
        [(1, 37.2, -120.2), (2, 37.9, -119.2), (3, 37.9, -119.0), (4, 20.0, -119.0),
         (5, 37.9, -121.2), (6, None, -120.0)],
        "row_id long, Latitude double, Longitude double")
    got = by_key(terrain.locate_pixels(points, tiles), "row_id")
    place = lambda i: (got[i]["tile_id"], got[i]["px"], got[i]["py"])
    assert place(1) == (1, 1, 1)
    assert place(2) == (1, 3, 0)      # truncation would also let tile 2 claim it
    assert place(3) == (2, 0, 0)
    assert place(4) == place(6) == (None, None, None)
    assert place(5) == (1, 0, 0)      # less than one pixel before the first column


def test_crop_window_is_clamped(spark, monkeypatch):
    monkeypatch.setattr(terrain, "CROP_BLOCK", 2)
    dem, tiles = _raster(spark, [[float(c) for c in range(6)] for _ in range(6)]), _tile(spark, 6, 6)
    points = spark.createDataFrame([(1, 37.9, -120.9), (2, 36.6, -119.6), (3, 0.0, 0.0)],
                                   "row_id long, Latitude double, Longitude double")
    located = terrain.locate_pixels(points, tiles)
    rows = terrain.crop_windows(located, dem, tiles, half_side_m=20.0).groupBy("row_id").agg(
        F.count("*").alias("n"), F.min("col").alias("low"), F.max("col").alias("high"))
    got = by_key(rows, "row_id")
    assert got[1]["n"] == 4 and (got[1]["low"], got[1]["high"]) == (0, 1)
    assert got[2]["n"] == 16 and (got[2]["low"], got[2]["high"]) == (0, 3)
    assert 3 not in got
