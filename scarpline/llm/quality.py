"""Quality classifier: similarity-weighted votes of the nearest labelled documents.

A document becomes a vector of hashed character trigrams (square roots of their shares) and of a few
measures of repetition, letter case and punctuation. Latent-semantic directions are the leading
singular vectors of a labelled sample, and every text is projected on them. The labelled vectors, at
most ``MAX_LABELLED`` of ``LATENT`` numbers, are broadcast; each block of documents meets all of them
in one exact cosine product, and the ``NEIGHBOURS`` most similar ones vote with their similarity.

The sample is a documented bound on fitting alone: of the labelled rows offered, the ``MAX_LABELLED``
with the smallest hash of their id. Every document is scored, on its whole text. Label, language,
source and id are no inputs of a score.

Null and empty texts have a vector like any other. Rows whose label is null teach nothing; a document
with several label rows has their majority, ties count as 1. Without any labelled document all scores
are 0.5. Ids may repeat or be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scarpline.llm.common import SPACE, id_and_text, rows
from scarpline.llm.words import window_hashes, words_of

BUCKETS = 1024
LATENT = 48
MAX_LABELLED = 8192
NEIGHBOURS = 25
SHARPNESS = 4  # votes weigh similarity to this power
MEASURE_WEIGHT = 0.6  # of one measure against all trigrams together
THRESHOLD = 0.3
BLOCK = 1024  # documents in one product
FOLDS = 5

_KIND = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower, 3 digit, 4 space, 5 other ASCII, 6 the rest
_KIND[33:127] = 5
_KIND[ord("A"):ord("Z") + 1] = 1
_KIND[ord("a"):ord("z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 3
_KIND[list(SPACE)] = 4
_KIND[128:] = 6
MEASURES = 15


def _measures(data: np.ndarray, text: bytes, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n, size = max(len(hashes), 1), max(len(data), 1)
    kinds = np.bincount(_KIND[data], minlength=7) / size
    lines = text.split(b"\n")
    windows = window_hashes(hashes, 3)
    lengths = ends - begins
    same = np.count_nonzero(hashes[1:] == hashes[:-1])
    return np.array([
        kinds[1], kinds[3], kinds[4], kinds[5],
        1 - len(np.unique(hashes)) / n, 1 - len(np.unique(windows)) / max(len(windows), 1),
        1 - len(set(lines)) / len(lines), same / n,
        float(lengths.mean()) / 20 if len(lengths) else 0.0,
        float(lengths.std()) / 20 if len(lengths) else 0.0,
        np.log1p(n) / 10, len(lines) / n,
        np.count_nonzero(lengths == 1) / n, float(lengths.max(initial=0)) / 100,
        np.log1p(n / len(lines)) / 5,
    ], dtype=np.float32)


def vectors(texts: list[bytes]) -> np.ndarray:
    """One row per text: trigram shares and measures."""
    out = np.zeros((len(texts), BUCKETS + MEASURES), dtype=np.float32)
    for i, (text, words) in enumerate(zip(texts, words_of(texts), strict=True)):
        data = np.frombuffer(text, dtype=np.uint8)
        if len(data) > 2:
            wide = data.astype(np.uint32)
            grams = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77)
                     + wide[2:] * np.uint32(0xC2B2AE3D))
            counts = np.bincount(grams * np.uint32(0x27D4EB2F) >> np.uint32(22), minlength=BUCKETS)
            out[i, :BUCKETS] = np.sqrt(counts / len(grams))
        out[i, BUCKETS:] = _measures(data, text, *words)
    return out


@dataclass
class Model:
    """Centre and scale of the vectors, latent directions, labelled latent unit vectors."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    labelled: np.ndarray
    labels: np.ndarray

    def latent(self, rows_: np.ndarray) -> np.ndarray:
        found = ((rows_ - self.centre) * self.scale) @ self.directions
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[bytes], neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        if not len(self.labels):
            return out
        for first in range(0, len(texts), BLOCK):
            cosines = self.latent(vectors(texts[first:first + BLOCK])) @ self.labelled.T
            k = min(neighbours, len(self.labels))
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-3).astype(np.float64) ** SHARPNESS
            out[first:first + BLOCK] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def fit(sample: np.ndarray, labels: np.ndarray, latent: int = LATENT) -> Model:
    """Truncated singular vectors of the scaled sample."""
    width = sample.shape[1]
    if not len(labels):
        return Model(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros((0, 1)), labels)
    centre = sample.mean(axis=0)
    scale = np.ones(width, dtype=np.float32)
    spread = sample[:, :BUCKETS].std(axis=0)
    scale[:BUCKETS] = 1 / max(float(np.sqrt((spread**2).sum())), 1e-6)
    scale[BUCKETS:] = MEASURE_WEIGHT / np.maximum(sample[:, BUCKETS:].std(axis=0), 1e-3)
    scaled = ((sample - centre) * scale).astype(np.float64)
    _, axes = np.linalg.eigh(scaled.T @ scaled)
    directions = axes[:, ::-1][:, :min(latent, width)].astype(np.float32)
    model = Model(centre.astype(np.float32), scale, directions, np.zeros((0, 1)), labels)
    model.labelled = model.latent(sample).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Fits on at most ``max_labelled`` labelled documents that are not held out."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(target).cast("double").alias("__label"))
        .where(F.col("__label").isNotNull() & F.col("__id").isNotNull())
        .where(~held_out(F.col("__id")))
        .groupBy("__id").agg((F.avg("__label") >= 0.5).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    )
    # At most max_labelled rows of two numbers.
    found = id_and_text(docs).join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select(
        "doc_id", "text", "__label")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_ = vectors([text for _, text in rows(batch, binary=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("__label"), pa.array([v.tobytes() for v in found_], pa.binary())],
                ["doc_id", "label", "vector"])

    # The bounded sample, at most max_labelled vectors of about 4 KB; a repeated id may exceed it, so
    # each id gives one row.
    sample = found.mapInArrow(drawn, "doc_id long, label int, vector binary").groupBy("doc_id").agg(
        F.min("label").alias("label"), F.min("vector").alias("vector")).orderBy("doc_id").toArrow()
    width = BUCKETS + MEASURES
    matrix = np.frombuffer(b"".join(sample.column("vector").to_pylist()), dtype=np.float32).reshape(-1, width)
    return fit(matrix, np.array(sample.column("label").to_pylist(), dtype=np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: its columns (doc_id and text among them) and ``__score``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # MAX_LABELLED x LATENT numbers and the directions
    schema = StructType([*docs.schema.fields, StructField("__score", DoubleType())])
    names = schema.names

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            found = shared.value.scores([t.as_py() or b"" for t in text]) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names)

    return docs.mapInArrow(scored, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(id_and_text(docs), train(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    text = docs.withColumn("text", F.col("text").cast("string"))
    return score(text, train(docs, labels)).where(F.col("__score") >= THRESHOLD).select(*docs.columns)
