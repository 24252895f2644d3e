"""What the fits of one table share: one plain training table, its cut points, and where the work runs.

Cross-validation, selection and drop-column importance fit the same estimator again and again on one
table, without one fold or without some features. Such fits are ``Job``s; an estimator with a method
``many`` takes all of them at once. A table of checked size is broadcast and every task works on some of
the jobs; a larger one stays where it is, and each step is one aggregation keyed by job. Both ways add
integers, so they give the same models, on any file layout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline import schema as S
from scarpline.operators.columns import quoted

# A table of at most this many feature values is broadcast.
LOCAL_CELLS = 1 << 23
# Cut points come from at most this many rows, those of the smallest hash; no row is left out of a fit.
SAMPLE = 1 << 16


@dataclass(frozen=True)
class Job:
    """One fit of many: the features it may use and the fold it must not see."""

    features: tuple[str, ...]
    held_out: int | None = None


@dataclass(frozen=True)
class Rows:
    """Training rows in memory: hash, 0/1 label, fold and feature values."""

    key: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    x: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch | pa.Table, width: int) -> Rows:
        values = batch.column("x")
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        if len(x) != batch.num_rows or np.isnan(x).any():
            raise ValueError("training rows must not hold nulls")
        return Rows(batch.column("key").to_numpy(), batch.column("label").to_numpy().astype(np.int64),
                    batch.column("fold").to_numpy(), x)

    def take(self, which: np.ndarray) -> Rows:
        return Rows(self.key[which], self.label[which], self.fold[which], self.x[which])

    def seen_by(self, job: Job) -> np.ndarray:
        return np.ones(len(self.key), dtype=bool) if job.held_out is None else self.fold != job.held_out


def all_features(jobs: list[Job]) -> list[str]:
    return list(dict.fromkeys(f for job in jobs for f in job.features))


def training_table(df: DataFrame, features: list[str], label: str, fold: str | None = None) -> DataFrame:
    """(key, label, fold, x) with the feature values in one array; rows without a label teach nothing.

    The key hashes the row id, or the row's own values if it has none.
    """
    names = [S.ROW_ID] if S.ROW_ID in df.columns else [*features, label]
    return df.where(quoted(label).isNotNull()).select(
        F.xxhash64(*[quoted(n) for n in names]).alias("key"),
        quoted(label).cast("int").alias("label"),
        (F.lit(-1) if fold is None else F.coalesce(quoted(fold), F.lit(-1))).cast("int").alias("fold"),
        F.array(*[quoted(f).cast("double") for f in features]).alias("x"),
    )


def chunks(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[Rows]:
    """Training rows by the ``size`` or a batch more, whatever the size of the batches."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield Rows.of(pa.Table.from_batches(held), width)
            held, n = [], 0
    if n:
        yield Rows.of(pa.Table.from_batches(held), width)


def held_locally(table: DataFrame, width: int, cells: int | None = None) -> Rows | None:
    """The rows by key, if the table has at most ``cells`` feature values; else None.

    The rows are counted first, up to the bound; the driver receives none of a larger table.
    """
    bound = (LOCAL_CELLS if cells is None else cells) // max(width, 1)
    if table.select("label").limit(bound + 1).count() > bound:
        return None
    rows = Rows.of(table.toArrow(), width)
    return rows.take(np.lexsort((*rows.x.T, rows.label, rows.key)))


def sampled(table: DataFrame, rows: Rows | None, width: int) -> np.ndarray:
    """Feature values of the rows with the smallest hashes; the same whichever way they are held."""
    if rows is not None:
        return rows.x[:SAMPLE]
    return Rows.of(table.orderBy("key", "label", "x").limit(SAMPLE).toArrow(), width).x


def cut_points(sample: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature at most ``bins - 1`` cuts, half-way between neighbouring values; all if there are few.

    A value below a cut lies left of it.
    """
    out = []
    for values in np.sort(sample, axis=0).T:
        distinct = np.unique(values)
        if len(distinct) > bins:
            picks = np.unique(values[len(values) * np.arange(1, bins) // bins])
            upper = np.searchsorted(distinct, picks[picks > distinct[0]])
        else:
            upper = np.arange(1, len(distinct))
        out.append(between(distinct[upper - 1], distinct[upper]))
    return out


def between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Half-way, but above ``low`` also where the two are neighbours among floats."""
    middle = low + (high - low) / 2
    return np.where(middle > low, middle, high)


def codes_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: how many cuts lie at or below it."""
    out = np.empty(x.shape, dtype=np.uint16)
    for f, edges in enumerate(cuts):
        out[:, f] = np.searchsorted(edges, x[:, f], side="right")
    return out


def spread(spark, numbers: list[int], work: Callable[[int], Iterator[tuple]], schema: str) -> DataFrame:
    """``work(number)`` of every number as Spark tasks: rows of the number and what it gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("number").to_pylist():
                out = [(number, *row) for row in work(number)]
                columns = list(zip(*out, strict=True)) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    full = f"number int, {schema}"
    arrow = to_arrow_schema(spark.createDataFrame([], full).schema)
    tasks = min(len(numbers), 4 * spark.sparkContext.defaultParallelism)
    todo = spark.createDataFrame([(i % tasks, n) for i, n in enumerate(numbers)], "task int, number int")
    return todo.repartition(tasks, "task").select("number").mapInArrow(run, full)


def feature_struct(features: list[str]) -> Column:
    """The features as doubles in one struct; plain names, since feature names may hold dots."""
    return F.struct(*[quoted(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
