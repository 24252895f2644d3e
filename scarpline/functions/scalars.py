"""Scalar column expressions; all of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scarpline import schema as S

__all__ = [
    "nan_to_null", "to_number", "to_date", "unreadable_dates", "months_total", "lon360", "shift_year", "days_before",
    "bounding_box", "pixel_index", "min_max_score", "is_stable", "soil_arithmetic",
]


def nan_to_null(column: Column) -> Column:
    """One missing marker only: NaN becomes NULL."""
    return F.nanvl(column, F.lit(None).cast("double"))


def to_number(column: Column) -> Column:
    """Text to double; text that is no number becomes NULL, and so does a NaN spelled out."""
    return nan_to_null(column.try_cast("double"))


# Text forms of a date beside ISO, month first; one or two digits for month, day and hour.
DATE_FORMATS = ["M/d/yyyy", "M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "yyyy/M/d"]


def to_date(column: Column, formats: list[str] | None = None) -> Column:
    """Date from a date, timestamp or text: ISO first, then ``formats`` in turn.

    Text that none of them reads becomes NULL; ``unreadable_dates`` counts it.
    """
    text = F.trim(column.cast("string"))
    others = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in (DATE_FORMATS if formats is None else formats)]
    return F.coalesce(column.try_cast("date"), *others)


def unreadable_dates(column: Column, formats: list[str] | None = None) -> Column:
    """Aggregate: how many values are there but are no date in any of the forms."""
    return F.count_if(column.isNotNull() & to_date(column, formats).isNull())


def months_total(value: Column, units: Column | str) -> Column:
    """Monthly total in millimetres when the units say it is a flux, unchanged otherwise."""
    units = F.lit(units) if isinstance(units, str) else units
    return F.when(units.contains(S.FLUX_UNITS), value * F.lit(S.SECONDS_PER_MONTH)).otherwise(value)


def lon360(lon: Column) -> Column:
    """Longitude on the 0..360 axis of the climate grids."""
    return F.when(lon >= 0, lon).otherwise(lon + 360)


def shift_year(date: Column, year: Column | int) -> Column:
    """Same month and day in another year; 29 February falls back to the 28th."""
    year = F.lit(year) if isinstance(year, int) else year
    return F.add_months(date, (year - F.year(date)) * 12)


def days_before(date: Column, days: int) -> Column:
    return F.date_sub(date, days)


def bounding_box(lat: Column, lon: Column, metres: float = S.DEM_BOX_M) -> dict[str, Column]:
    """Corner columns of a square around a point, on a sphere of the equatorial radius."""
    half_lat = F.degrees(F.lit(metres / S.EARTH_RADIUS_M))
    half_lon = F.degrees(F.lit(metres) / (F.lit(S.EARTH_RADIUS_M) * F.cos(F.radians(lat))))
    return {
        "min_lon": lon - half_lon,
        "min_lat": lat - half_lat,
        "max_lon": lon + half_lon,
        "max_lat": lat + half_lat,
    }


def pixel_index(
    lat: Column, lon: Column, minx: Column, xres: Column, maxy: Column, yres: Column
) -> tuple[Column, Column]:
    """(px, py) of a point, truncated toward zero; ``yres`` is negative as in a north-up raster."""
    px = ((lon - minx) / xres).cast("int")
    py = ((maxy - lat) / -yres).cast("int")
    return px, py


def min_max_score(value: Column, low: Column, high: Column) -> Column:
    """1 at the smallest value, 0 at the largest, NULL where all are equal."""
    return F.lit(1.0) - F.try_divide(value - low, high - low)


def is_stable(prediction: Column, threshold: float = S.STABLE_THRESHOLD) -> Column:
    return prediction >= F.lit(threshold)


def soil_arithmetic() -> dict[str, Column]:
    """Derived soil columns over the raw survey column names."""
    number = lambda name: to_number(F.col(name))
    return {
        "wetting_front": number("soimoistdept_r") - number("soimoistdepb_r"),
        "bd": (number("dbthirdbar_r") - number("wthirdbar_r")) / 100,
    }
