"""Terrain queries.

Analogue: parts form a raster of 40 columns, cut into two tiles of 20; the elevation is price plus
size, with some no-data pixels. Customers are points derived from their key, some outside all tiles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scarpline import functions as fn
from scarpline import schema as S
from scarpline.operators import terrain
from scarpline.plans.collection import enrich_terrain
from scarpline.queries.base import load, rounded

PIXEL = {
    "tile_id": "CAST(FLOOR((p_partkey % 40) / 20) AS INTEGER)",
    "row": "CAST(FLOOR(p_partkey / 40) AS INTEGER)",
    "col": "CAST(p_partkey % 20 AS INTEGER)",
    "elev": "CASE WHEN p_partkey % 101 = 50 THEN -9999e0 ELSE p_retailprice + p_size END",
}
POINT = {
    "c_custkey": "c_custkey",
    "Latitude": "383e-1 - (c_custkey * 37 % 3001) / 1e2",
    "Longitude": "(c_custkey * 53 % 2201) / 1e2 - 121e0",
}


def dem(spark, sf):
    pixels = load(spark, sf, "part").select(*[F.expr(e).alias(c) for c, e in PIXEL.items()])
    return pixels.withColumn("elev", F.nullif("elev", F.lit(S.DEM_NODATA)))


def tiles(spark, sf):
    return dem(spark, sf).groupBy("tile_id").agg(
        (F.col("tile_id") * 10.0 - 120.0).alias("minx"), F.lit(0.5).alias("xres"),
        F.lit(38.0).alias("maxy"), F.lit(-0.5).alias("yres"),
        (F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"),
        F.lit(10.0).alias("cell_size"))


def points(spark, sf):
    return load(spark, sf, "customer").select(*[F.expr(e).alias(c) for c, e in POINT.items()])


def dem_scan(spark, sf):
    return dem(spark, sf)


def bounding_boxes(spark, sf):
    box = fn.bounding_box(F.col("Latitude"), F.col("Longitude"))
    shown = points(spark, sf).select("c_custkey", *[c.alias(n) for n, c in box.items()])
    return rounded(shown, list(box), 8)


def point_to_pixel(spark, sf):
    px, py = fn.pixel_index(F.col("Latitude"), F.col("Longitude"), F.lit(-120.0), F.lit(0.5),
                            F.lit(38.0), F.lit(-0.5))
    return points(spark, sf).select("c_custkey", px.alias("px"), py.alias("py"))


def point_in_tile(spark, sf):
    return terrain.locate_pixels(points(spark, sf), tiles(spark, sf))


def pixel_lookup(spark, sf):
    located = terrain.locate_pixels(points(spark, sf), tiles(spark, sf))
    return terrain.lookup_pixels(located, dem(spark, sf), ["elev"])


_ROUND = dict.fromkeys(S.TERRAIN_ATTRIBUTES, 6)


def stencil(spark, sf):
    return rounded(terrain.terrain_stencil(dem(spark, sf), tiles(spark, sf)), _ROUND)


def terrain_enrich(spark, sf):
    found = enrich_terrain(points(spark, sf), dem(spark, sf), tiles(spark, sf))
    return rounded(found, {f"terrain_{n}": d for n, d in _ROUND.items()})


def crop_bounds(spark, sf):
    located = terrain.locate_pixels(points(spark, sf), tiles(spark, sf))
    return terrain.crop_bounds(located, tiles(spark, sf), half_side_m=30.0).select(
        "c_custkey", "tile_id", "xmin", "xmax", "ymin", "ymax", "usable")


def crop_window(spark, sf):
    located = terrain.locate_pixels(points(spark, sf), tiles(spark, sf))
    return terrain.crop_windows(located, dem(spark, sf), tiles(spark, sf), "c_custkey",
                                half_side_m=30.0)


QUERIES = {
    "dem_scan": dem_scan,
    "bounding_box": bounding_boxes,
    "point_to_pixel": point_to_pixel,
    "point_in_tile": point_in_tile,
    "pixel_lookup": pixel_lookup,
    "terrain_stencil": stencil,
    "terrain_enrich": terrain_enrich,
    "crop_bounds": crop_bounds,
    "crop_window": crop_window,
}

_DEM = "dem AS (SELECT tile_id, row, col, nullif(elev, -9999e0) AS elev FROM (SELECT " + ", ".join(
    f"{e} AS {c}" for c, e in PIXEL.items()) + " FROM part))"
_TILES = """tiles AS (SELECT tile_id, tile_id * 1e1 - 120e0 AS minx, 5e-1 AS xres, 38e0 AS maxy,
      -5e-1 AS yres, max(col) + 1 AS width, max(row) + 1 AS height FROM dem GROUP BY tile_id)"""
_POINTS = "points AS (SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in POINT.items()) \
    + " FROM customer)"
_LOCATED = """hits AS (SELECT p.c_custkey, t.tile_id,
      CAST(trunc((p."Longitude" - minx) / xres) AS INTEGER) AS px,
      CAST(trunc((maxy - p."Latitude") / -yres) AS INTEGER) AS py,
      (p."Longitude" < minx OR p."Latitude" > maxy) AS before, width, height
      FROM points p CROSS JOIN tiles t),
best AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY before, tile_id) AS rn
      FROM hits WHERE px >= 0 AND px < width AND py >= 0 AND py < height),
located AS (SELECT p.*, b.tile_id, b.px, b.py FROM points p
      LEFT JOIN best b ON p.c_custkey = b.c_custkey AND rn = 1)"""
_BASE = f"{_DEM}, {_TILES}, {_POINTS}, {_LOCATED}"
_NEIGHBOURS = [("a", -1, -1), ("b", -1, 0), ("c", -1, 1), ("d", 0, -1), ("e", 0, 0), ("f", 0, 1),
               ("g", 1, -1), ("h", 1, 0), ("i", 1, 1)]
_WINDOWS = "windows AS (SELECT e.tile_id, e.row, e.col, " + ", ".join(
    f"{n}.elev AS {n}" for n, _, _ in _NEIGHBOURS) + " FROM dem e " + " ".join(
    f"LEFT JOIN dem {n} ON {n}.tile_id = e.tile_id AND {n}.row = e.row + {r} "
    f"AND {n}.col = e.col + {c}" for n, r, c in _NEIGHBOURS if n != "e") + ")"
_PARTS = """parts AS (SELECT *, ((c + 2 * f + i) - (a + 2 * d + g)) / 80e0 AS dx,
      ((g + 2 * h + i) - (a + 2 * b + c)) / 80e0 AS dy,
      ((d + f) / 2 - e) / 1e2 AS zd, ((b + h) / 2 - e) / 1e2 AS ze, (c + g - a - i) / 4e2 AS zf,
      (f - d) / 2e1 AS zg, (b - h) / 2e1 AS zh FROM windows),
shapes AS (SELECT tile_id, row, col, e AS elev,
      round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope_degrees,
      CASE WHEN dx <> 0 OR dy <> 0 THEN round(CASE
        WHEN 90 - degrees(atan2(dy, -dx)) < 0 THEN 450 - degrees(atan2(dy, -dx))
        ELSE 90 - degrees(atan2(dy, -dx)) END, 6) + 0.0 END AS aspect,
      CASE WHEN dx + dy + e IS NOT NULL THEN round(coalesce(2 * (zd * zh * zh + ze * zg * zg
        - zf * zg * zh) / nullif(zg * zg + zh * zh, 0), 0), 6) + 0.0 END AS planform_curvature,
      CASE WHEN dx + dy + e IS NOT NULL THEN round(coalesce(-2 * (zd * zg * zg + ze * zh * zh
        + zf * zg * zh) / nullif(zg * zg + zh * zh, 0), 0), 6) + 0.0 END AS profile_curvature
      FROM parts)"""
_COMPLETE = "a + b + c + d + e + f + g + h + i IS NOT NULL"
_SHAPES = "final AS (SELECT s.tile_id, s.row, s.col, elev, " + ", ".join(
    f"CASE WHEN {_COMPLETE} THEN {n} END AS {n}" for n in S.TERRAIN_ATTRIBUTES
) + " FROM shapes s JOIN windows w USING (tile_id, row, col))"
_BOUNDS = """bounds AS (SELECT c_custkey, l.tile_id, greatest(0, px - 3) AS xmin,
      least(width, px + 3) AS xmax, greatest(0, py - 3) AS ymin, least(height, py + 3) AS ymax
      FROM located l JOIN tiles t ON l.tile_id = t.tile_id)"""

ORACLE = {
    "dem_scan": f"WITH {_DEM} SELECT * FROM dem",
    "bounding_box": f"""WITH {_POINTS} SELECT c_custkey,
        round("Longitude" - degrees(1e4 / (6378137e0 * cos(radians("Latitude")))), 8) AS min_lon,
        round("Latitude" - degrees(1e4 / 6378137e0), 8) AS min_lat,
        round("Longitude" + degrees(1e4 / (6378137e0 * cos(radians("Latitude")))), 8) AS max_lon,
        round("Latitude" + degrees(1e4 / 6378137e0), 8) AS max_lat FROM points""",
    "point_to_pixel": f"""WITH {_POINTS} SELECT c_custkey,
        CAST(trunc(("Longitude" + 120e0) / 5e-1) AS INTEGER) AS px,
        CAST(trunc((38e0 - "Latitude") / 5e-1) AS INTEGER) AS py FROM points""",
    "point_in_tile": f"WITH {_BASE} SELECT * FROM located",
    "pixel_lookup": f"""WITH {_BASE} SELECT l.*, d.elev FROM located l LEFT JOIN dem d
        ON d.tile_id = l.tile_id AND d.row = l.py AND d.col = l.px""",
    "terrain_stencil": f"WITH {_DEM}, {_WINDOWS}, {_PARTS}, {_SHAPES} SELECT * FROM final",
    "terrain_enrich": f"WITH {_BASE}, {_WINDOWS}, {_PARTS}, {_SHAPES} SELECT c_custkey, "
                      "\"Latitude\", \"Longitude\", "
                      + ", ".join(f"{n} AS terrain_{n}" for n in S.TERRAIN_ATTRIBUTES)
                      + " FROM located l LEFT JOIN final f ON f.tile_id = l.tile_id "
                        "AND f.row = l.py AND f.col = l.px",
    "crop_bounds": f"""WITH {_BASE}, {_BOUNDS} SELECT l.c_custkey, l.tile_id, xmin, xmax, ymin,
        ymax, coalesce(xmax - xmin >= 2 AND ymax - ymin >= 2, FALSE) AS usable
        FROM located l LEFT JOIN bounds b ON l.c_custkey = b.c_custkey""",
    "crop_window": f"""WITH {_BASE}, {_BOUNDS} SELECT c_custkey, d.tile_id, d.row, d.col, d.elev
        FROM bounds b JOIN dem d ON d.tile_id = b.tile_id AND d.row >= ymin AND d.row < ymax
        AND d.col >= xmin AND d.col < xmax WHERE xmax - xmin >= 2 AND ymax - ymin >= 2""",
}
