"""Gridded monthly climate series: units, stitching, rolling sums and lookups at events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scarpline import schema as S
from scarpline.functions import lon360, months_total, shift_year
from scarpline.operators.columns import quoted
from scarpline.operators.nearest import (
    Axis, Calendars, load_axes, load_calendars, with_nearest, with_nearest_in,
)

CELL = ["scenario", "lat", "lon"]


def monthly_series(grid: DataFrame) -> DataFrame:
    """Grid with fluxes turned into monthly totals."""
    return grid.select(
        *CELL, "time", months_total(F.col("pr"), F.col("units")).alias("pr"),
    )


def stitch(
    history: DataFrame, future: DataFrame, scenarios: list[str] = S.SCENARIOS,
    drop_overlap: bool = True,
) -> DataFrame:
    """History put in front of each scenario present in ``future``; ``segment`` keeps the order.

    ``drop_overlap`` ends the history where the scenario starts; without it both parts are kept.
    """
    wanted = future.filter(F.col("scenario").isin(scenarios))
    copies = F.explode(F.array(*[F.lit(s) for s in scenarios]))
    # One row per wanted scenario: the broadcast is bounded by the scenario list.
    starts = wanted.groupBy("scenario").agg(F.min("time").alias("__start"))
    front = history.withColumn("scenario", copies).join(F.broadcast(starts), "scenario")
    if drop_overlap:
        front = front.filter(F.col("time") < F.col("__start"))
    return front.drop("__start").withColumn("segment", F.lit(0)).unionByName(
        wanted.withColumn("segment", F.lit(1))
    )


def rolling_sum(
    series: DataFrame, months: int = 12, cell: list[str] = CELL, value: str = "pr",
    order: list[str] | None = None,
) -> DataFrame:
    """Centred rolling sum in place of ``value``; null unless the whole window has values.

    A grid cell of one scenario has one row per month, which bounds the window partition.
    """
    if order is None:
        order = ["segment", "time"] if "segment" in series.columns else ["time"]
    back = months // 2
    span = Window.partitionBy(*cell).orderBy(*order).rowsBetween(-back, months - 1 - back)
    full = F.count(value).over(span) == months
    return series.withColumn(value, F.when(full, F.sum(value).over(span)))


def process_scenarios(
    grid: DataFrame, months: int = 12, scenarios: list[str] = S.SCENARIOS,
    history: str = S.HISTORY, drop_overlap: bool = True,
) -> DataFrame:
    """Stitched rolling series of every scenario in one table (scenario, lat, lon, time, pr)."""
    series = monthly_series(grid)
    past = series.filter(F.col("scenario") == history)
    stitched = stitch(past, series, scenarios, drop_overlap)
    return rolling_sum(stitched, months).select(*CELL, "time", "pr")


def rolling_at_events(
    events: DataFrame, grid: DataFrame, months: int = 12, scenarios: list[str] = S.SCENARIOS,
    lat_col: str = S.LATITUDE, lon_col: str = S.LONGITUDE, history: str = S.HISTORY,
    drop_overlap: bool = True,
) -> tuple[DataFrame, dict[str, Axis | Calendars | None]]:
    """Rolling series of the grid cells that some event needs, and the axes of the whole grid.

    The cells meet the stitched grid by a semi join ahead of the window, whose partitions are cells, so
    the values are those of the whole grid and the rest of the cube is neither rolled nor shuffled.
    """
    series = monthly_series(grid)
    stitched = stitch(series.filter(F.col("scenario") == history), series, scenarios, drop_overlap)
    axes = grid_axes(stitched)
    places = events.select(quoted(lat_col), quoted(lon_col)).distinct()
    cells = with_grid_cell(places, axes, lat_col, lon_col).select(
        F.col("grid_lat").alias("lat"), F.col("grid_lon").alias("lon")).na.drop().distinct()
    near = stitched.join(cells, ["lat", "lon"], "left_semi")
    return rolling_sum(near, months).select(*CELL, "time", "pr"), axes


def year_range(series: DataFrame) -> DataFrame:
    return series.groupBy("scenario").agg(
        F.min(F.year("time")).alias("first_year"), F.max(F.year("time")).alias("last_year")
    )


def calendar_years(calendars: Calendars) -> DataFrame:
    """First and last year of every scenario's calendar."""
    return calendars.ends.select(
        "scenario", F.year(F.date_from_unix_date("__first")).alias("first_year"),
        F.year(F.date_from_unix_date("__last")).alias("last_year"))


def grid_axes(grid: DataFrame) -> dict[str, Axis | Calendars | None]:
    """Latitude and longitude axes of a grid or rolling table, and the calendar of each scenario."""
    axes = load_axes(grid, {"lat": F.col("lat"), "lon": F.col("lon")})
    return {**axes, "time": load_calendars(grid, "scenario", F.col("time"))}


def with_grid_cell(
    events: DataFrame, axes: dict[str, Axis | Calendars | None], lat_col: str = S.LATITUDE,
    lon_col: str = S.LONGITUDE,
) -> DataFrame:
    """Adds ``grid_lat`` and ``grid_lon``, the nearest grid axes (no wrap at 360 degrees)."""
    placed = with_nearest(events, quoted(lat_col), axes["lat"], "grid_lat")
    return with_nearest(placed, lon360(quoted(lon_col)), axes["lon"], "grid_lon")


def forecast_at_events(
    events: DataFrame, *, rolling: DataFrame, scenarios: list[str] = S.SCENARIOS,
    lat_col: str = S.LATITUDE, lon_col: str = S.LONGITUDE, date_col: str = S.EVENT_DATE,
    suffix: str = "_event_precipitation", axes: dict[str, Axis | Calendars | None] | None = None,
) -> DataFrame:
    """Adds ``{scenario}_event_precipitation`` for all scenarios, null where unknown.

    Every scenario is looked up in its own calendar, so one that ends early gives its last month. The
    lookups are made for distinct (grid cell, date) keys and pivoted; the events are joined once.
    """
    axes = axes or grid_axes(rolling)
    cell = ["grid_lat", "grid_lon", "__date"]
    placed = with_grid_cell(events, axes, lat_col, lon_col).withColumn("__date", quoted(date_col).cast("date"))
    keys = placed.select(*cell).na.drop().distinct()
    names = F.explode(F.array(*[F.lit(s) for s in scenarios]))
    dated = with_nearest_in(keys.withColumn("scenario", names), F.col("__date"), axes["time"], "grid_time")
    wide = dated.join(monthly_values(rolling, scenarios), ["scenario", "grid_lat", "grid_lon", "grid_time"]).groupBy(
        *cell).agg(*[F.max(F.when(F.col("scenario") == s, F.col("__pr"))).alias(f"{s}{suffix}") for s in scenarios])
    return placed.join(wide, cell, "left").select(
        *[quoted(c) for c in events.columns], *[f"{s}{suffix}" for s in scenarios]
    )


def monthly_values(rolling: DataFrame, scenarios: list[str]) -> DataFrame:
    """One value per scenario, cell and month: a series that keeps its overlap has two, the larger counts."""
    return rolling.filter(F.col("scenario").isin(scenarios)).groupBy(
        "scenario", F.col("lat").alias("grid_lat"), F.col("lon").alias("grid_lon"),
        F.col("time").alias("grid_time"),
    ).agg(F.max("pr").alias("__pr"))


def expand_scenarios(
    events: DataFrame, *, rolling: DataFrame, years: list[int] = S.FORECAST_YEARS,
    scenarios: list[str] = S.SCENARIOS, lat_col: str = S.LATITUDE, lon_col: str = S.LONGITUDE,
    date_col: str = S.EVENT_DATE, feature_map: dict[str, str] | None = None,
    axes: dict[str, Axis | Calendars | None] | None = None,
) -> DataFrame:
    """Every event in every year and scenario, with the climate value of that place and date.

    Adds ``forecast_year``, ``scenario`` and ``scenario_precipitation``. ``feature_map`` names, per
    scenario, the training column that takes the new value in the rows of that scenario.

    The values are looked up for distinct (grid cell, month, day) keys, each scenario in its own
    calendar, and packed as one short array per key; the wide event rows are joined once and expanded only afterwards.
    """
    cell = ["grid_lat", "grid_lon", "__monthday"]
    axes = axes or grid_axes(rolling)
    placed = with_grid_cell(events, axes, lat_col, lon_col)
    date = quoted(date_col).cast("date")
    placed = placed.withColumn("__monthday", F.month(date) * 100 + F.dayofmonth(date))

    steps = F.explode(F.array(*[F.lit(y) for y in years])).alias("forecast_year")
    keys = placed.filter(F.col("grid_lat").isNotNull() & F.col("grid_lon").isNotNull()
                         & date.isNotNull())
    # 29 February is kept as the leap day of 2000 and moved like any other date.
    keys = keys.select(
        *cell, F.make_date(F.lit(2000), F.floor(F.col("__monthday") / 100).cast("int"),
                           F.pmod("__monthday", F.lit(100)).cast("int")).alias("__day")
    ).distinct()
    dated = keys.select(*cell, "__day", steps).withColumn(
        "__moved", shift_year(F.col("__day"), F.col("forecast_year"))
    )
    names = F.explode(F.array(*[F.lit(s) for s in scenarios]))
    dated = with_nearest_in(dated.withColumn("scenario", names), F.col("__moved"), axes["time"], "grid_time")
    packed = dated.join(monthly_values(rolling, scenarios), ["scenario", "grid_lat", "grid_lon", "grid_time"]).groupBy(
        *cell).agg(
        F.map_from_entries(F.collect_list(F.struct(
            F.concat_ws("@", "scenario", "forecast_year"), F.col("__pr")
        ))).alias("__found")
    )
    grid = F.explode(F.array(*[
        F.struct(F.lit(s).alias("s"), F.lit(y).alias("y")) for s in scenarios for y in years
    ]))
    joined = placed.join(packed, cell, "left").withColumn("__step", grid)
    value = F.try_element_at(
        F.col("__found"), F.concat_ws("@", F.col("__step.s"), F.col("__step.y"))
    )
    by_column = {column: s for s, column in (feature_map or {}).items()}
    shown = []
    for name in events.columns:
        column = quoted(name)
        if name == date_col:
            column = shift_year(date, F.col("__step.y"))
        elif name in by_column:
            column = F.when(F.col("__step.s") == by_column[name], value).otherwise(column)
        shown.append(column.alias(name))
    return joined.select(
        *shown,
        F.col("__step.y").alias("forecast_year"),
        F.col("__step.s").alias("scenario"),
        value.alias("scenario_precipitation"),
    )


def scenario_dataset(expanded: DataFrame, scenario: str) -> DataFrame:
    """The rows of one scenario with its climate column named ``{scenario}_precipitation``."""
    return expanded.filter(F.col("scenario") == scenario).withColumnRenamed(
        "scenario_precipitation", f"{scenario}_precipitation"
    )
