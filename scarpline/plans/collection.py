"""Enriching an event table with terrain, soil, weather and climate columns."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scarpline import schema as S
from scarpline.operators import climate, soil, terrain, weather
from scarpline.operators.columns import column_groups, quoted, with_prefix
from scarpline.operators.profile import validation_report
from scarpline.session import cut_lineage
from scarpline.sources import read_events, save_collected, write_table

Collector = Callable[..., DataFrame]

# Module names, in the order they run, and the other names they go by.
MODULES = ["terrain", "soil", "weather", "climate"]
ALIASES = {"slope": "terrain", "meteostat": "weather", "cmip": "climate"}


@dataclass(frozen=True)
class Columns:
    lat: str = S.LATITUDE
    lon: str = S.LONGITUDE
    date: str = S.EVENT_DATE
    place: list[str] = field(default_factory=lambda: list(weather.PLACE))


def enrich_terrain(
    events: DataFrame, dem: DataFrame, tiles: DataFrame, columns: Columns = Columns()
) -> DataFrame:
    """Adds ``terrain_*``; null for points outside all tiles."""
    found = terrain.terrain_at_points(events, dem, tiles, columns.lat, columns.lon)
    return with_prefix(found, "terrain_", S.TERRAIN_ATTRIBUTES)


def enrich_soil(
    events: DataFrame, tables: dict[str, DataFrame], point_mukey: DataFrame,
    aggregate: bool = True, columns: Columns = Columns(), method: str = "weighted_mean",
    comonth_key: str = "cokey", distinct: bool = False, strict_compat: bool = True,
) -> DataFrame:
    """Adds ``soil_*`` from the survey rows of every distinct event place."""
    points = events.select(
        quoted(columns.lat).alias("latitude"), quoted(columns.lon).alias("longitude")
    ).na.drop()
    rows = soil.soil_at_points(points, point_mukey, tables, comonth_key, distinct)
    primary = soil.primary_properties(rows, strict_compat)
    if aggregate:
        classes = S.SOIL_TEXT_COLUMNS + ([] if strict_compat else soil.OPTIONAL_CLASSES)
        table = soil.aggregate_soil(primary.drop("chkey"), method, classes=classes)
    else:
        table = soil.last_row(primary)
    return soil.update_from_points(events, table, columns.lat, columns.lon)


def enrich_weather(
    events: DataFrame, daily: DataFrame, fill_missing_only: bool = True,
    columns: Columns = Columns(), **options,
) -> DataFrame:
    """Fills or replaces the eight rainfall columns."""
    missing = [c for c in S.WEATHER_COLUMNS if c not in events.columns]
    if fill_missing_only and missing and not options:
        events = events.withColumns({c: F.lit(None).cast("double") for c in missing})
    run = weather.fill_missing_weather if fill_missing_only else weather.replace_weather
    return run(events, daily, columns.place, columns.date, **options)


def enrich_climate(
    events: DataFrame, grid: DataFrame, months: int = 12, columns: Columns = Columns(),
    scenarios: list[str] = S.SCENARIOS,
) -> DataFrame:
    """Adds the rolling climate value of every scenario at the event."""
    rolling, axes = climate.rolling_at_events(
        events, grid, months, scenarios, columns.lat, columns.lon)
    return climate.forecast_at_events(
        events, rolling=rolling, axes=axes, scenarios=scenarios,
        lat_col=columns.lat, lon_col=columns.lon, date_col=columns.date,
    )


def collect_forecast_table(
    events: DataFrame, grid: DataFrame, variable: str = "pr", output_dir: str | None = None,
    months: int = 12, columns: Columns = Columns(), scenarios: list[str] = S.SCENARIOS,
) -> DataFrame:
    """Events with the rolling value of a named grid variable, ``{scenario}_event_{variable}``.

    With ``output_dir`` the table is saved as ``weather_forecast_data``. A variable the grid lacks raises.
    """
    if variable not in grid.columns:
        raise ValueError(f"the climate grid has no variable {variable}")
    named = grid.withColumn("pr", quoted(variable).cast("double"))
    rolling, axes = climate.rolling_at_events(events, named, months, scenarios, columns.lat, columns.lon)
    found = climate.forecast_at_events(
        events, rolling=rolling, axes=axes, scenarios=scenarios, lat_col=columns.lat, lon_col=columns.lon,
        date_col=columns.date, suffix=f"_event_{variable}")
    if output_dir is not None:
        write_table(found, f"{output_dir}/weather_forecast_data")
    return found


@dataclass(frozen=True)
class Collected:
    data: DataFrame
    status: DataFrame


MANIFEST = "module string, fingerprint string, path string, n_rows long, schema string"


def content_fingerprint(df: DataFrame) -> str:
    """Hash of schema and rows, whatever their order or layout; one scan."""
    row = F.xxhash64(*[quoted(c) for c in df.columns]).cast("decimal(38,0)")
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("s"), F.sum(row * F.lit(31) % F.lit(1_000_003)).alias("m")).first()
    return hashlib.sha256(f"{df.schema.json()}|{found['n']}|{found['s']}|{found['m']}".encode()).hexdigest()


def _committed(spark: SparkSession, folder: str) -> Row | None:
    """The manifest row of a stage, or None if it never finished."""
    try:
        return spark.read.schema(MANIFEST).parquet(folder).first()
    except AnalysisException:
        return None


def _staged(
    events: DataFrame, collector: Collector, name: str, stage_dir: str, fingerprint: str
) -> tuple[DataFrame, bool]:
    """The module's result below the shared stage folder, and whether an earlier run left it there.

    Data are written first, the manifest row after them: a run that was killed in between leaves no row,
    so its stage is written again.
    """
    spark = events.sparkSession
    path, manifest = f"{stage_dir}/{name}/{fingerprint[:32]}", f"{stage_dir}/manifest/{name}-{fingerprint[:32]}"
    row = _committed(spark, manifest)
    if row is not None:
        schema = StructType.fromJson(json.loads(row["schema"]))
        return spark.read.schema(schema).parquet(path), True
    result = collector(events)
    result.write.mode("overwrite").parquet(path)
    written = spark.read.schema(result.schema).parquet(path)
    spark.createDataFrame(
        [(name, fingerprint, path, written.count(), result.schema.json())], MANIFEST
    ).coalesce(1).write.mode("overwrite").parquet(manifest)
    return written, False


def collect_all(
    events: DataFrame, collectors: dict[str, Collector], modules: list[str] | None = None,
    stage_dir: str | None = None, versions: dict[str, str] | None = None,
) -> Collected:
    """Runs the chosen modules in order; one that fails, also at run time, leaves the table as it was.

    Each module's result is written and read back, so a success has really been computed and the plan
    stays short: below ``stage_dir`` (a folder all executors reach), or as a checkpoint. Stages are named
    by a fingerprint of the events, of the modules that went before, and of the module's entry in
    ``versions``, which should change with its sources and options. A run with the same fingerprints
    takes the committed stages of an earlier one and starts after the last.
    """
    chosen = [ALIASES.get(m, m) for m in (modules or MODULES)]
    status, fingerprint = [], content_fingerprint(events) if stage_dir is not None else ""
    for name in MODULES:
        if name not in chosen or name not in collectors:
            continue
        message = None
        try:
            if stage_dir is not None:
                version = (versions or {}).get(name, "")
                following = hashlib.sha256(f"{fingerprint}|{name}|{version}".encode()).hexdigest()
                result, resumed = _staged(events, collectors[name], name, stage_dir, following)
                fingerprint, message = following, "resumed" if resumed else None
            else:
                result = cut_lineage(collectors[name](events))
        except Exception as error:  # isolation: the other modules still run
            status.append((name, "failed", str(error)))
            continue
        events = result
        status.append((name, "success", message))
    table = events.sparkSession.createDataFrame(
        status, "module string, status string, message string")
    return Collected(events, table)


def collect_one(
    events: DataFrame, collectors: dict[str, Collector], data_type: str, **options
) -> DataFrame:
    """One module by either of its names; ``options`` go to its collector."""
    name = ALIASES.get(data_type, data_type)
    if name not in collectors:
        raise ValueError(f"unknown data type: {data_type}")
    return collectors[name](events, **options)


def validate_collected(df: DataFrame) -> DataFrame:
    """Numeric profile of the terrain, soil and rainfall columns, in one scan."""
    return validation_report(df, column_groups(df))


def run_collection(
    spark: SparkSession, input_path: str, collectors: dict[str, Collector],
    output_dir: str | None = None, modules: list[str] | None = None,
    stage_dir: str | None = None, **reader,
) -> tuple[Collected, DataFrame]:
    """Read, enrich, save, validate."""
    collected = collect_all(read_events(spark, input_path, **reader), collectors, modules, stage_dir)
    if output_dir is not None:
        save_collected(collected.data, collected.status, output_dir)
    return collected, validate_collected(collected.data)
