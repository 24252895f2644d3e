"""Missing-data profile, the null-threshold sweep and numeric quality profiles.

Everything here is one or two aggregation passes whose shuffled size depends on the number of
columns, never on the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scarpline import schema as S
from scarpline.operators.columns import NUMERIC_TYPES, keep, quoted

_COUNTS = "column string, null_count long"
_SWEEP = "threshold long, features_kept int, rows_kept long, weighted_ratio double"


@dataclass(frozen=True)
class NullProfile:
    """Row count and nulls per column, in column order."""

    rows: int
    nulls: dict[str, int]

    def below(self, threshold: int) -> list[str]:
        return [name for name, count in self.nulls.items() if count < threshold]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(list(self.nulls.items()), _COUNTS)


def null_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, null_count) from a single aggregation."""
    names = names or df.columns
    wide = df.agg(*[F.count_if(quoted(n).isNull()).alias(f"n{i}") for i, n in enumerate(names)])
    pairs = F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"n{i}").alias("null_count"))
        for i, n in enumerate(names)
    ])
    return wide.select(F.inline(pairs))


def profile_nulls(df: DataFrame) -> NullProfile:
    """Run the null profile; the driver receives one row of counts."""
    counts = [F.count_if(quoted(n).isNull()) for n in df.columns]
    row = df.agg(F.count(F.lit(1)), *counts).first()
    return NullProfile(row[0], dict(zip(df.columns, row[1:])))


def drop_null_columns(
    df: DataFrame, profile: NullProfile | None = None, carry: list[str] | None = None
) -> DataFrame:
    """Only the columns without any null; ``carry`` adds keys that were not profiled."""
    return keep(df, [*(profile or profile_nulls(df)).below(1), *(carry or [])])


def drop_null_rows(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Complete rows over ``names``; NaN counts as missing too."""
    return df.na.drop("any", subset=[f"`{n}`" for n in names or df.columns])


def apply_threshold(
    df: DataFrame, threshold: int, profile: NullProfile | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Columns with fewer nulls than ``threshold``, then only their complete rows.

    ``carry`` adds keys that were not profiled; they take no part in the choice.
    """
    names = (profile or profile_nulls(df)).below(threshold)
    kept = keep(df, [*names, *(carry or [])])
    return drop_null_rows(kept, names) if names else kept


def row_bounds(df: DataFrame, profile: NullProfile) -> DataFrame:
    """(bound, n_rows): a row is complete at threshold t exactly when its bound is at least t.

    The bound of a row is the smallest null count among its null columns, so the table has at most
    one line per column plus one for complete rows (bound NULL) and is combined map-side.
    """
    gaps = [
        F.when(quoted(name).isNull(), F.lit(count))
        for name, count in profile.nulls.items() if count
    ]
    bound = F.least(*gaps, F.lit(None).cast("long")) if gaps else F.lit(None).cast("long")
    return df.groupBy(bound.alias("bound")).agg(F.count(F.lit(1)).alias("n_rows"))


def sweep_steps(df: DataFrame, profile: NullProfile) -> list[tuple[int, int, int]]:
    """(first threshold, features kept, rows kept) of every plateau of the sweep, ascending.

    Both counts change only just above a column's null count, so the plateaus describe the sweep
    over all thresholds 1..rows-1 completely.
    """
    by_bound = {row["bound"]: row["n_rows"] for row in row_bounds(df, profile).collect()}
    starts = sorted({1} | {count + 1 for count in profile.nulls.values()})
    steps = []
    for start in starts:
        kept = len(profile.below(start))
        if kept and start < profile.rows:
            rows = sum(n for bound, n in by_bound.items() if bound is None or bound >= start)
            steps.append((start, kept, rows))
    return steps


def _ratio(features_kept, rows_kept, n_columns: int, n_rows: int):
    return S.FEATURE_WEIGHT * (features_kept / n_columns) + S.ROW_WEIGHT * (rows_kept / n_rows)


def threshold_sweep(df: DataFrame, profile: NullProfile | None = None) -> DataFrame:
    """One row per threshold, from two passes over the data instead of one pass per threshold.

    The thresholds come from a distributed range; the plateau of each is looked up in a literal
    array with at most one entry per column.
    """
    spark = df.sparkSession
    profile = profile or profile_nulls(df)
    steps = sweep_steps(df, profile)
    if not steps:
        return spark.createDataFrame([], _SWEEP)
    entries = F.array(*[
        F.struct(F.lit(s).alias("start"), F.lit(f).alias("f"), F.lit(r).cast("long").alias("r"))
        for s, f, r in steps
    ])
    t = F.col("id")
    plateau = F.element_at(F.filter(entries, lambda e: e["start"] <= t), -1)
    features_kept, rows_kept = F.col("p.f"), F.col("p.r")
    return (
        spark.range(steps[0][0], profile.rows)
        .select(t, plateau.alias("p"))
        .select(
            t.alias("threshold"),
            features_kept.cast("int").alias("features_kept"),
            rows_kept.alias("rows_kept"),
            _ratio(features_kept, rows_kept, len(profile.nulls), profile.rows)
            .alias("weighted_ratio"),
        )
    )


def best_threshold(df: DataFrame, profile: NullProfile | None = None) -> int | None:
    """First threshold with the largest ratio; a plateau's left end always wins its plateau."""
    profile = profile or profile_nulls(df)
    best = None
    for start, kept, rows in sweep_steps(df, profile):
        ratio = _ratio(kept, rows, len(profile.nulls), profile.rows)
        if best is None or ratio > best[0]:
            best = (ratio, start)
    return None if best is None else best[1]


def top_threshold(sweep: DataFrame) -> DataFrame:
    """The best line of a sweep table as a one-row table."""
    return sweep.orderBy(F.desc("weighted_ratio"), F.asc("threshold")).limit(1)


def retention(df: DataFrame, threshold: int, profile: NullProfile | None = None) -> DataFrame:
    """How many columns and rows a threshold keeps, with their shares."""
    profile = profile or profile_nulls(df)
    names = profile.below(threshold)
    complete = reduce(lambda a, b: a & b, [quoted(n).isNotNull() for n in names], F.lit(True))
    kept = df.agg(F.count_if(complete).alias("rows_kept"), F.count(F.lit(1)).alias("rows_total"))
    return kept.select(
        F.lit(threshold).cast("long").alias("threshold"),
        F.lit(len(names)).alias("features_kept"),
        F.col("rows_kept"),
        F.lit(len(names) / len(profile.nulls)).alias("feature_share"),
        F.try_divide(F.col("rows_kept"), F.col("rows_total")).alias("row_share"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


_STATS = ["n", "missing", "low", "high", "mean", "std", "zeros", "negatives"]


def _stat_columns(name: str) -> list:
    value = quoted(name).cast("double")
    return [
        F.count(value), F.count_if(value.isNull()), F.min(value), F.max(value), F.avg(value),
        F.stddev_samp(value), F.count_if(value == 0), F.count_if(value < 0),
    ]


def _profile_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """One aggregation over all columns, then one output row per column."""
    aggregates = [
        stat.alias(f"{label}{i}")
        for i, name in enumerate(names)
        for label, stat in zip(_STATS, _stat_columns(name))
    ]
    structs = F.array(*[
        F.struct(F.lit(name).alias("column"),
                 *[F.col(f"{label}{i}").alias(label) for label in _STATS])
        for i, name in enumerate(names)
    ])
    return df.agg(*aggregates).select(F.inline(structs))


def numeric_profile(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """count, missing, min, max, mean and sample deviation of each numeric column."""
    numeric = set(numeric_columns(df))
    names = [n for n in (names or df.columns) if n in numeric]
    return _profile_rows(df, names).select(
        "column", F.col("n").alias("count"), "missing", F.col("low").alias("min"),
        F.col("high").alias("max"), "mean", "std",
    )


def quality_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """The numeric profile of the requested columns with a status, zero and negative counts.

    A requested column the table lacks gets the status ``missing_column``, one without any value
    ``no_data``; both carry no statistics.
    """
    present = [n for n in names if n in df.columns]
    absent = [n for n in names if n not in df.columns]
    valid = F.col("n") > 0
    shown = {"count": "n", "missing": "missing", "min": "low", "max": "high", "mean": "mean",
             "std": "std", "zero_count": "zeros", "negative_count": "negatives"}
    parts = []
    if present:
        parts.append(_profile_rows(df, present).select(
            "column",
            F.when(valid, "valid").otherwise("no_data").alias("status"),
            *[F.when(valid, F.col(source)).alias(name) for name, source in shown.items()],
        ))
    if absent:
        types = {"min", "max", "mean", "std"}
        schema = "column string, status string, " + ", ".join(
            f"{name} {'double' if name in types else 'long'}" for name in shown
        )
        rows = [(n, "missing_column", *[None] * len(shown)) for n in absent]
        parts.append(df.sparkSession.createDataFrame(rows, schema))
    return reduce(DataFrame.unionByName, parts)


def fill_report(df: DataFrame, names: list[str]) -> DataFrame:
    """Nulls left per column and the share of rows filled, in percent."""
    return _profile_rows(df, names).select(
        "column",
        F.col("missing").alias("still_missing"),
        (100 * F.try_divide(F.col("n"), F.col("n") + F.col("missing"))).alias("success_rate"),
    )


def validation_report(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Numeric profile of all groups in one scan, with the group name in front."""
    wanted = [(group, name) for group, names in groups.items() for name in names]
    if not wanted:
        return df.sparkSession.createDataFrame([], T.StructType.fromDDL(
            "`group` string, column string, count long, missing long, min double, max double, "
            "mean double, std double"
        ))
    membership = df.sparkSession.createDataFrame(wanted, "`group` string, column string")
    stats = numeric_profile(df, list(dict.fromkeys(name for _, name in wanted)))
    return membership.join(stats, "column").select(
        "group", "column", "count", "missing", "min", "max", "mean", "std"
    )
