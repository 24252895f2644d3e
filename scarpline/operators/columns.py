"""Column choices and row predicates of the event table."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scarpline import schema as S

NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def quoted(name: str):
    """Column by exact name, also when the name holds dots, blanks or colons."""
    return F.col(f"`{name}`")


def keep(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[quoted(n) for n in names])


def clean_features(df: DataFrame) -> DataFrame:
    """Without keys, index debris and ``_nc`` columns; absent names are no error."""
    return keep(df, [
        n for n in df.columns
        if n not in S.KEY_COLUMNS and "Unnamed" not in n and not n.endswith("_nc")
    ])


def clean_for_evaluation(df: DataFrame) -> DataFrame:
    """Without keys, index debris and ``Precipitation`` columns; absent names are no error."""
    return keep(df, [
        n for n in df.columns
        if n not in S.KEY_COLUMNS and "Unnamed" not in n and "Precipitation" not in n
    ])


def feature_names(df: DataFrame, target: str = S.TARGET, row_id: str = S.ROW_ID) -> list[str]:
    return [n for n in df.columns if n not in (target, row_id)]


def column_groups(df: DataFrame) -> dict[str, list[str]]:
    """Numeric columns by validation group."""
    rules = {
        "terrain": lambda n: n.startswith("terrain_"),
        "soil": lambda n: n.startswith("soil_"),
        "precipitation": lambda n: "prcp" in n.lower(),
    }
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
    return {group: [n for n in numeric if rule(n)] for group, rule in rules.items()}


def existing(df: DataFrame, names: list[str]) -> list[str]:
    """The requested names the table has, in the requested order."""
    present = set(df.columns)
    return [n for n in names if n in present]


def common_features(left: DataFrame, right: DataFrame) -> list[str]:
    return sorted(set(left.columns) & set(right.columns))


def with_prefix(df: DataFrame, prefix: str, names: list[str]) -> DataFrame:
    """Rename ``names`` to carry ``prefix``; other columns stay as they are."""
    chosen = set(names)
    return df.select(*[
        quoted(n).alias(f"{prefix}{n}" if n in chosen else n) for n in df.columns
    ])


def split_target(
    df: DataFrame, features: list[str], target: str = S.TARGET, extra: list[str] | None = None
) -> DataFrame:
    """Selected features, the target and any carried keys in one projection."""
    return keep(df, [*features, target, *(extra or [])])


def align_features(
    df: DataFrame, features: list[str], carry: list[str] | None = None
) -> DataFrame:
    """Training features in training order: absent columns and nulls become 0."""
    present = set(df.columns)
    aligned = [
        (F.coalesce(quoted(n).cast("double"), F.lit(0.0)) if n in present else F.lit(0.0)).alias(n)
        for n in features
    ]
    return df.select(*[quoted(n) for n in carry or []], *aligned)


def any_missing(names: list[str]):
    """True where at least one of the columns is null."""
    return reduce(or_, [quoted(n).isNull() for n in names])


def all_present(names: list[str]):
    return reduce(and_, [quoted(n).isNotNull() for n in names])


def rows_missing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.filter(any_missing(names))


def rows_with_keys(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows whose place and date are all known."""
    return df.filter(all_present(names or [S.LATITUDE, S.LONGITUDE, S.EVENT_DATE]))
