"""Terrain attributes on elevation pixels and their lookup at event coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline import schema as S
from scarpline.functions import pixel_index
from scarpline.operators.columns import quoted
from scarpline.session import broadcast_if_small

BLOCK = 256
CROP_BLOCK = 64


def terrain_attributes(z: dict[str, Column], cell: Column) -> dict[str, Column]:
    """Slope and aspect (Horn 1981), curvatures (Zevenbergen and Thorne 1987) of a 3x3 window.

    ``z`` maps ``a b c / d e f / g h i`` (north row first) to elevations and ``cell`` is the pixel
    size. A missing neighbour makes all four null. Aspect is in compass degrees and null on flat
    ground; the curvatures keep the published signs, unscaled, and are 0 on flat ground.
    """
    a, b, c, d, e, f, g, h, i = (z[k] for k in "abcdefghi")
    dx = ((c + 2 * f + i) - (a + 2 * d + g)) / (8 * cell)
    dy = ((g + 2 * h + i) - (a + 2 * b + c)) / (8 * cell)
    complete = (a + b + c + d + e + f + g + h + i).isNotNull()

    angle = F.degrees(F.atan2(dy, -dx))
    compass = F.pmod(90.0 - angle, F.lit(360.0))

    curve_d = ((d + f) / 2 - e) / (cell * cell)
    curve_e = ((b + h) / 2 - e) / (cell * cell)
    curve_f = (c + g - a - i) / (4 * cell * cell)
    slope_g = (f - d) / (2 * cell)
    slope_h = (b - h) / (2 * cell)
    steep = slope_g * slope_g + slope_h * slope_h
    along = curve_d * slope_g * slope_g + curve_e * slope_h * slope_h + curve_f * slope_g * slope_h
    across = curve_d * slope_h * slope_h + curve_e * slope_g * slope_g - curve_f * slope_g * slope_h

    def curvature(value: Column) -> Column:
        return F.when(complete, F.coalesce(F.try_divide(value, steep), F.lit(0.0)))

    return {
        "slope_degrees": F.when(complete, F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))),
        "aspect": F.when(complete & ((dx != 0) | (dy != 0)), compass),
        "planform_curvature": curvature(2 * across),
        "profile_curvature": curvature(-2 * along),
    }


def _with_cell_size(dem: DataFrame, tiles: DataFrame) -> DataFrame:
    return dem.join(broadcast_if_small(tiles.select("tile_id", "cell_size")), "tile_id", "left")


def _blocks_of(index: str) -> Column:
    """Block numbers that need this row or column: its own and, on a border, the next one."""
    return F.array_distinct(F.transform(
        F.array(F.lit(-1), F.lit(0), F.lit(1)),
        lambda step: F.floor((F.col(index) + step) / BLOCK),
    ))


def terrain_stencil(dem: DataFrame, tiles: DataFrame, keep_gradients: bool = False) -> DataFrame:
    """Attributes of every pixel: (tile_id, row, col, elev, four attributes).

    The raster is cut into square blocks with a one-pixel halo and shuffled once by block; both
    neighbour windows then run inside the block, so a large tile is spread over many tasks.
    """
    block = ["tile_id", "__br", "__bc"]
    pixels = _with_cell_size(dem, tiles)
    spread = (
        pixels.withColumn("__br", F.explode(_blocks_of("row")))
        .withColumn("__bc", F.explode(_blocks_of("col")))
        .repartition(*block)
    )
    in_row = Window.partitionBy(*block, "row").orderBy("col")
    in_col = Window.partitionBy(*block, "col").orderBy("row")

    def beside(move, step: int) -> Column:
        adjacent = move("col").over(in_row) == F.col("col") + step
        return F.when(adjacent, move("elev").over(in_row))

    rows = spread.withColumns({"__w": beside(F.lag, -1), "__e": beside(F.lead, 1)})
    line = F.struct("row", F.col("__w").alias("w"), F.col("elev").alias("m"),
                    F.col("__e").alias("e"))
    stacked = rows.withColumns({
        "__n": F.lag(line).over(in_col), "__s": F.lead(line).over(in_col)
    })
    north = F.col("__n.row") == F.col("row") - 1
    south = F.col("__s.row") == F.col("row") + 1
    z = {
        "a": F.when(north, F.col("__n.w")), "b": F.when(north, F.col("__n.m")),
        "c": F.when(north, F.col("__n.e")), "d": F.col("__w"), "e": F.col("elev"),
        "f": F.col("__e"), "g": F.when(south, F.col("__s.w")),
        "h": F.when(south, F.col("__s.m")), "i": F.when(south, F.col("__s.e")),
    }
    own = (F.floor(F.col("row") / BLOCK) == F.col("__br")) & (
        F.floor(F.col("col") / BLOCK) == F.col("__bc"))
    attributes = terrain_attributes(z, F.col("cell_size"))
    return stacked.filter(own).select(
        "tile_id", "row", "col", "elev", *[c.alias(n) for n, c in attributes.items()]
    )


def locate_pixels(
    points: DataFrame, tiles: DataFrame, lat_col: str = S.LATITUDE, lon_col: str = S.LONGITUDE
) -> DataFrame:
    """Adds ``tile_id``, ``px`` and ``py``; null outside all tiles.

    A tile is filed at the grid level of its own size, whose cells are its longer side rounded up to a
    power of two, so it lies in at most four cells and a wide tile costs small ones nothing. A distinct
    place probes one cell of every level in use and takes the least candidate; points are joined to
    places once and keep their rows. Pixel indexes truncate toward zero, which counts a point up to one
    pixel before the first row or column as inside; a tile that truly contains the point goes first,
    then the smallest ``tile_id``.
    """
    extents = tiles.select(
        "tile_id", "minx", "xres", "maxy", "yres", "width", "height",
        (F.col("minx") - F.col("xres")).alias("west"),
        (F.col("minx") + F.col("width") * F.col("xres")).alias("east"),
        (F.col("maxy") + F.col("height") * F.col("yres")).alias("south"),
        (F.col("maxy") - F.col("yres")).alias("north"),
    )
    side = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(1e-9))
    levelled = extents.withColumn("__level", F.ceil(F.log2(side)).cast("int"))
    # Levels are exponents of two: some dozens, whatever the number of tiles.
    levels = [row[0] for row in levelled.select("__level").distinct().na.drop().collect()]

    def cell(value: Column) -> Column:
        return F.floor(value / F.pow(F.lit(2.0), F.col("__level")))

    filed = (
        levelled.withColumn("__cx", F.explode(F.sequence(cell(F.col("west")), cell(F.col("east")))))
        .withColumn("__cy", F.explode(F.sequence(cell(F.col("south")), cell(F.col("north")))))
        .select("__level", "__cx", "__cy", "tile_id", "minx", "xres", "maxy", "yres", "width", "height")
    )
    lat, lon = F.col("__lat"), F.col("__lon")
    located = points.withColumns({"__lat": quoted(lat_col), "__lon": quoted(lon_col)})
    probes = (
        located.select("__lat", "__lon").na.drop().distinct()
        .withColumn("__level", F.explode(F.lit(levels).cast("array<int>")))
        .withColumns({"__cx": cell(lon), "__cy": cell(lat)})
    )
    px, py = pixel_index(lat, lon, F.col("minx"), F.col("xres"), F.col("maxy"), F.col("yres"))
    before = (lon < F.col("minx")) | (lat > F.col("maxy"))
    inside = (px >= 0) & (px < F.col("width")) & (py >= 0) & (py < F.col("height"))
    best = (
        probes.join(broadcast_if_small(filed), ["__level", "__cx", "__cy"]).where(inside)
        .groupBy("__lat", "__lon")
        .agg(F.min(F.struct(before.alias("before"), "tile_id", px.alias("px"), py.alias("py"))).alias("__best"))
    )
    return located.join(best, ["__lat", "__lon"], "left").select(
        *[quoted(c) for c in points.columns], "__best.tile_id", "__best.px", "__best.py"
    )


def lookup_pixels(points: DataFrame, raster: DataFrame, values: list[str]) -> DataFrame:
    """Raster values at located points; null where the point or its pixel is missing."""
    pixels = raster.select("tile_id", F.col("row").alias("py"), F.col("col").alias("px"), *values)
    return points.join(pixels, ["tile_id", "py", "px"], "left")


def terrain_at_points(
    points: DataFrame, dem: DataFrame, tiles: DataFrame,
    lat_col: str = S.LATITUDE, lon_col: str = S.LONGITUDE,
) -> DataFrame:
    """Adds the four attributes, computed only for pixels that hold a point.

    Points are far fewer than pixels: the 3x3 neighbourhoods of the distinct hit pixels are fetched
    by one equi join with the raster instead of running a stencil over all of it.
    """
    located = locate_pixels(points, tiles, lat_col, lon_col)
    hit = located.select("tile_id", "px", "py").na.drop().distinct()
    names = "abcdefghi"
    offsets = F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(k // 3 - 1).alias("dr"), F.lit(k % 3 - 1).alias("dc"))
        for k, n in enumerate(names)
    ]))
    wanted = hit.withColumn("__o", offsets).select(
        "tile_id", "px", "py", F.col("__o.name").alias("name"),
        (F.col("py") + F.col("__o.dr")).alias("row"), (F.col("px") + F.col("__o.dc")).alias("col"),
    )
    found = dem.join(broadcast_if_small(wanted), ["tile_id", "row", "col"])
    windows = found.groupBy("tile_id", "px", "py").agg(*[
        F.max(F.when(F.col("name") == n, F.col("elev"))).alias(n) for n in names
    ])
    sized = _with_cell_size(windows, tiles)
    attributes = terrain_attributes({n: F.col(n) for n in names}, F.col("cell_size"))
    table = sized.select("tile_id", "px", "py", *[c.alias(n) for n, c in attributes.items()])
    return located.join(table, ["tile_id", "px", "py"], "left").select(
        *[quoted(c) for c in points.columns], *S.TERRAIN_ATTRIBUTES
    )


def crop_bounds(
    located: DataFrame, tiles: DataFrame, half_side_m: float = S.CROP_HALF_SIDE_M,
    resolution_m: float = S.DEM_RESOLUTION_M,
) -> DataFrame:
    """Adds the clamped pixel window of each located point and whether it is at least 2x2."""
    reach = int(half_side_m / resolution_m)
    sizes = broadcast_if_small(tiles.select("tile_id", "width", "height"))
    found = F.col("px").isNotNull()
    bounded = located.join(sizes, "tile_id", "left").withColumns({
        "xmin": F.when(found, F.greatest(F.lit(0), F.col("px") - reach)),
        "xmax": F.when(found, F.least(F.col("width"), F.col("px") + reach)),
        "ymin": F.when(found, F.greatest(F.lit(0), F.col("py") - reach)),
        "ymax": F.when(found, F.least(F.col("height"), F.col("py") + reach)),
    })
    usable = (F.col("xmax") - F.col("xmin") >= 2) & (F.col("ymax") - F.col("ymin") >= 2)
    return bounded.withColumn("usable", F.coalesce(usable, F.lit(False)))


def crop_windows(
    located: DataFrame, dem: DataFrame, tiles: DataFrame, key: str = S.ROW_ID,
    half_side_m: float = S.CROP_HALF_SIDE_M, resolution_m: float = S.DEM_RESOLUTION_M,
) -> DataFrame:
    """(key, tile_id, row, col, elev) of the pixels around each point with a usable window.

    Windows and pixels meet on (tile, block of 64 pixels), so no point is compared with a whole tile.
    """
    def block(value: Column) -> Column:
        return F.floor(value / CROP_BLOCK)

    def covered(low: str, high: str) -> Column:
        return F.explode(F.sequence(block(F.col(low)), block(F.col(high) - 1)))

    windows = (
        crop_bounds(located, tiles, half_side_m, resolution_m).filter("usable")
        .select(key, "tile_id", "xmin", "xmax", "ymin", "ymax")
        .withColumn("__br", covered("ymin", "ymax"))
        .withColumn("__bc", covered("xmin", "xmax"))
    )
    pixels = dem.withColumns({"__br": block(F.col("row")), "__bc": block(F.col("col"))})
    inside = (
        (F.col("row") >= F.col("ymin")) & (F.col("row") < F.col("ymax"))
        & (F.col("col") >= F.col("xmin")) & (F.col("col") < F.col("xmax"))
    )
    return windows.join(pixels, ["tile_id", "__br", "__bc"]).filter(inside).select(
        key, "tile_id", "row", "col", "elev"
    )
