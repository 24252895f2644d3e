"""Small helpers that the operators share: row access in Arrow batches and the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scarpline.session import shared_dir

# The white space of the word contracts, as bytes; everything else belongs to a word.
SPACE = b" \t\n\v\f\r"
_TO_SPACE = bytes.maketrans(SPACE, b" " * len(SPACE))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns the operators work on, so extra columns cannot clash with theirs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_key() -> list[Column]:
    """What tells rows apart, null or repeated ids included: the id, -2^63 for none, and a text hash."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__id"),
            F.xxhash64(F.col("text").cast("string")).alias("__hash")]


def with_row_key(docs: DataFrame) -> DataFrame:
    return docs.select("*", *row_key())


def once_each(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns; of rows that repeat id and text one stays. With unique ids every window has
    one row; after a join on the row key there is no further shuffle."""
    order = Window.partitionBy("__id", "__hash").orderBy(F.lit(1))
    return keyed.withColumn("__row", F.row_number().over(order)).where("__row = 1").select(*columns)


def rows(batch: pa.RecordBatch | pa.Table, binary: bool = False) -> Iterator[tuple[int | None, bytes | str]]:
    """(doc_id, text) of a batch; a null text is empty."""
    text = batch.column("text")
    if binary:
        text = text.cast(pa.binary())
    empty = b"" if binary else ""
    for doc_id, value in zip(batch.column("doc_id").to_pylist(), text, strict=True):
        value = value.as_py()
        yield doc_id, empty if value is None else value


def one_space(text: bytes) -> bytes:
    """Every run of white space replaced by one space."""
    text = text.translate(_TO_SPACE)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors both reach."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
