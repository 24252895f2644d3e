"""Fixed names and schemas of the event table and the enrichment inputs."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------------------
# Column names, scenario names, year grid and unit factors that results must agree on.

LATITUDE = "Latitude"
LONGITUDE = "Longitude"
EVENT_DATE = "event_date"
TARGET = "Stability"
ROW_ID = "row_id"
KEY_COLUMNS = ["event_date", "Latitude", "Longitude"]

MAX_DAYS = [1, 3, 7, 14]
AVG_DAYS = [30, 60, 90, 365]
WEATHER_DAYS_BACK = 400
WEATHER_COLUMNS = [
    "max_1_day_prcp",
    "max_3_day_prcp",
    "max_7_day_prcp",
    "max_14_day_prcp",
    "avg_30_day_prcp",
    "avg_60_day_prcp",
    "avg_90_day_prcp",
    "avg_365_day_prcp",
]

TERRAIN_ATTRIBUTES = ["slope_degrees", "aspect", "planform_curvature", "profile_curvature"]
DEM_NODATA = -9999.0
EARTH_RADIUS_M = 6_378_137.0
DEM_BOX_M = 10_000.0
CROP_HALF_SIDE_M = 200.0
DEM_RESOLUTION_M = 10.0

HISTORY = "hist"
SCENARIOS = ["ssp126", "ssp245", "ssp370", "ssp585"]
FLUX_UNITS = "kg m-2 s-1"
SECONDS_PER_MONTH = 30.44 * 24 * 3600
FORECAST_YEARS = list(range(2025, 2101, 5))

SOIL_TEXT_COLUMNS = ["hydgrp", "hzname"]
SOIL_NUMERIC_COLUMNS = [
    "wtenthbar_r", "wthirdbar_r", "wetting_front", "prcent", "slope_r", "runoff", "erocl", "pi_r",
    "slopelenusle_r", "slope", "deptht", "depthb", "awc", "clay", "silt", "partdensity", "sand",
    "OM", "bulk_density", "th33", "pH", "sat_hidric_cond", "bd",
]
SOIL_KEY_COLUMNS = ["cokey", "latitude", "longitude"]

FEATURE_WEIGHT = 0.7
ROW_WEIGHT = 0.3
SOFTMAX_SHARPNESS = 10.0
N_FOLDS = 5
SEED = 42
TEST_SHARE = 0.2
STABLE_THRESHOLD = 0.5
# ---- end of fixed values ----------------------------------------------------------------

DAILY_WEATHER = T.StructType([
    T.StructField("station_id", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("prcp", T.DoubleType()),
])

CLIMATE_GRID = T.StructType([
    T.StructField("scenario", T.StringType()),
    T.StructField("time", T.DateType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("pr", T.DoubleType()),
    T.StructField("units", T.StringType()),
])

DEM_PIXELS = T.StructType([
    T.StructField("tile_id", T.IntegerType()),
    T.StructField("row", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("elev", T.DoubleType()),
])

DEM_TILES = T.StructType([
    T.StructField("tile_id", T.IntegerType()),
    T.StructField("minx", T.DoubleType()),
    T.StructField("xres", T.DoubleType()),
    T.StructField("maxy", T.DoubleType()),
    T.StructField("yres", T.DoubleType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("cell_size", T.DoubleType()),
])

SOIL_TABLES = [
    "sacatalog", "legend", "mapunit", "component", "comonth", "cosoilmoist", "chorizon",
    "chtexturegrp", "chtexture", "copmgrp", "corestrictions",
]
