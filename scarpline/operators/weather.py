"""Rainfall statistics over the days before an event.

Events are reduced to distinct (place, date) keys first. The daily series is cut into chunks of
``days_back + 1`` days and every day is also given to the next chunk, so the window of any event lies
inside the chunk of its date. The interval join is thereby an equi join on (place, chunk) with a
date range, a busy station is spread over its chunks, and one shuffle per side carries the windows,
the join and the final aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline import schema as S
from scarpline.operators.columns import all_present, any_missing, quoted

PLACE = ["station_id"]
_CHUNK, _EVENT, _FIRST = "__chunk", "__event_date", "__first_date"


def stat_columns(max_days: list[int], avg_days: list[int]) -> list[str]:
    return [f"max_{k}_day_prcp" for k in max_days] + [f"avg_{n}_day_prcp" for n in avg_days]


def daily_totals(df: DataFrame, place: list[str], date: Column, value: Column) -> DataFrame:
    """One row per place and day, the form all weather operators expect."""
    return df.groupBy(*place, date.cast("date").alias("date")).agg(F.sum(value).alias("prcp"))


def _chunk_of(date: Column, days_back: int) -> Column:
    return F.floor(F.unix_date(date) / (days_back + 1)).cast("int")


def _chunked_days(daily: DataFrame, place: list[str], days_back: int) -> DataFrame:
    own = _chunk_of(F.col("date"), days_back)
    return daily.select(
        *place, "date", F.coalesce(F.col("prcp"), F.lit(0.0)).alias("p"),
        F.explode(F.array(own, own + 1)).alias(_CHUNK),
    )


def _event_keys(events: DataFrame, place: list[str], date_col: str, days_back: int) -> DataFrame:
    keys = events.filter(all_present([*place, date_col])).select(
        *[quoted(p) for p in place], quoted(date_col).cast("date").alias(_EVENT)
    ).distinct()
    return keys.withColumn(_CHUNK, _chunk_of(F.col(_EVENT), days_back)).withColumn(
        _FIRST, F.date_sub(_EVENT, days_back)
    )


def _needed_days(daily: DataFrame, keys: DataFrame, place: list[str], days_back: int) -> DataFrame:
    """Chunked days of the (place, chunk) pairs that some event needs, within the events' dates.

    The two dates come from one small aggregate and reach the scan as a filter; a day outside them, or
    of another chunk, is in no event's window.
    """
    first, last = keys.agg(F.min(_FIRST), F.max(_EVENT)).first()
    if first is None:
        return _chunked_days(daily.limit(0), place, days_back)
    near = daily.filter(F.col("date").between(F.lit(first), F.lit(last)))
    wanted = keys.select(*place, _CHUNK).distinct()
    return _chunked_days(near, place, days_back).join(wanted, [*place, _CHUNK], "left_semi")


def _in_window(date: Column) -> Column:
    return (date >= F.col(_FIRST)) & (date <= F.col(_EVENT))


def weather_window(
    events: DataFrame, daily: DataFrame, place: list[str] = PLACE,
    date_col: str = S.EVENT_DATE, days_back: int = S.WEATHER_DAYS_BACK,
) -> DataFrame:
    """Daily rows of each distinct event key, from ``days_back`` days before to the date itself."""
    found = _event_keys(events, place, date_col, days_back)
    keys, days = found.alias("k"), _needed_days(daily, found, place, days_back).alias("d")
    on = [F.col(f"k.{c}") == F.col(f"d.{c}") for c in [*place, _CHUNK]]
    return keys.join(days, [*on, _in_window(F.col("d.date"))]).select(
        *[F.col(f"k.{p}") for p in place], F.col(_EVENT).alias(date_col), "d.date",
        F.col("d.p").alias("prcp"),
    )


def weather_stats(
    events: DataFrame, daily: DataFrame, place: list[str] = PLACE,
    date_col: str = S.EVENT_DATE, days_back: int = S.WEATHER_DAYS_BACK,
    max_days: list[int] = S.MAX_DAYS, avg_days: list[int] = S.AVG_DAYS,
) -> DataFrame:
    """(place, date, statistics, has_weather), one row per distinct valid event key.

    ``max_k``: largest trailing k-row sum in the window, shorter sums at its start included;
    ``avg_n``: mean of the window's last n rows; each is 0.0 when the window holds fewer rows.
    ``daily`` must have one row per place and day (see ``daily_totals``).
    """
    by_day = Window.partitionBy(*place, _CHUNK).orderBy("date")
    sums = {k: F.sum("p").over(by_day.rowsBetween(1 - k, 0)).alias(f"s{k}")
            for k in max_days if k > 1}
    starts = [F.lag("date", k - 1).over(by_day).alias(f"from{k}") for k in sums]
    later = [F.lead("date", n).over(by_day).alias(f"after{n}") for n in avg_days]
    running = F.sum("p").over(by_day.rowsBetween(Window.unboundedPreceding, 0)).alias("run")
    keys = _event_keys(events, place, date_col, days_back)
    days = _needed_days(daily, keys, place, days_back).select(
        *place, _CHUNK, "date", "p", running, *sums.values(), *starts, *later
    )
    k, d = keys.alias("k"), days.alias("d")
    on = [F.col(f"k.{c}") == F.col(f"d.{c}") for c in [*place, _CHUNK]]
    joined = k.join(d, [*on, _in_window(F.col("d.date"))], "left")

    rows = F.count("d.date")
    before_first = F.min_by(F.col("d.run") - F.col("d.p"), F.col("d.date"))

    def enough(needed: int, value: Column) -> Column:
        return F.coalesce(F.when(rows >= needed, value), F.lit(0.0))

    stats = []
    for size in max_days:
        if size == 1:
            stats.append(enough(1, F.max("d.p")).alias("max_1_day_prcp"))
            continue
        whole = F.col(f"d.from{size}") >= F.col(_FIRST)
        largest = F.greatest(
            F.max(F.when(whole, F.col(f"d.s{size}"))),
            F.max(F.when(~F.coalesce(whole, F.lit(False)), F.col("d.run"))) - before_first,
        )
        stats.append(enough(size, largest).alias(f"max_{size}_day_prcp"))
    for size in avg_days:
        after = F.col(f"d.after{size}")
        among_last = F.when(after.isNull() | (after > F.col(_EVENT)), F.col("d.p"))
        stats.append(enough(size, F.sum(among_last) / size).alias(f"avg_{size}_day_prcp"))
    grouped = joined.groupBy(*[F.col(f"k.{c}") for c in [*place, _CHUNK, _EVENT]])
    return grouped.agg(*stats, (rows > 0).alias("has_weather")).select(
        *place, F.col(_EVENT).alias(date_col), *stat_columns(max_days, avg_days), "has_weather"
    )


def _overwrite(
    events: DataFrame, stats: DataFrame, place: list[str], date_col: str, columns: list[str]
) -> DataFrame:
    """Left join on the event key; every statistic of a matched row is replaced."""
    news = stats.select(
        *[F.col(p).alias(f"__{p}") for p in place], F.col(date_col).alias(_EVENT),
        *[F.col(c).alias(f"__new_{c}") for c in columns],
    )
    on = [quoted(p) == F.col(f"__{p}") for p in place]
    joined = events.join(news, [*on, quoted(date_col).cast("date") == F.col(_EVENT)], "left")
    hit = F.col(_EVENT).isNotNull()
    had = set(events.columns)
    kept = [
        (F.when(hit, F.col(f"__new_{n}")).otherwise(quoted(n)) if n in columns else quoted(n))
        .alias(n)
        for n in events.columns
    ]
    added = [F.col(f"__new_{n}").alias(n) for n in columns if n not in had]
    return joined.select(*kept, *added)


def fill_missing_weather(
    events: DataFrame, daily: DataFrame, place: list[str] = PLACE,
    date_col: str = S.EVENT_DATE, days_back: int = S.WEATHER_DAYS_BACK,
    max_days: list[int] = S.MAX_DAYS, avg_days: list[int] = S.AVG_DAYS,
) -> DataFrame:
    """Recompute the keys that have a null statistic; all rows of such a key are overwritten."""
    columns = stat_columns(max_days, avg_days)
    gaps = events.filter(any_missing([c for c in columns if c in events.columns]))
    stats = weather_stats(gaps, daily, place, date_col, days_back, max_days, avg_days)
    return _overwrite(events, stats, place, date_col, columns)


def replace_weather(
    events: DataFrame, daily: DataFrame, place: list[str] = PLACE,
    date_col: str = S.EVENT_DATE, days_back: int = S.WEATHER_DAYS_BACK,
    max_days: list[int] = S.MAX_DAYS, avg_days: list[int] = S.AVG_DAYS,
) -> DataFrame:
    """Statistics of every row with a valid key, replacing what was there."""
    stats = weather_stats(events, daily, place, date_col, days_back, max_days, avg_days)
    return _overwrite(events, stats, place, date_col, stat_columns(max_days, avg_days))
