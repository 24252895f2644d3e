"""Exchange of many small facts about texts as packed arrays.

Substring operators compare millions of hashes per GB across all documents. One row per hash would
cost far more than the hash. Documents are therefore dealt into buckets of about ``BUCKET_BYTES`` of
text; a bucket's facts leave as one row per part, each a few compressed arrays. A part is the range
of hashes that one call compares; its answers go back to the buckets they came from.

The numbers of buckets and parts follow the text, so both keep their size at any table size as long as
no single hash has most facts. Equal facts are merged inside a bucket before they leave, so that a
passage that a large share of all documents holds costs one fact per bucket. An operator that sends
different facts under one hash, as op5 does with contexts, must bound their number itself.

Inside a bucket documents are ordered by id and text; a fact's place counts through that order, and so
needs no id. Rows with the same id and text are interchangeable and share a bucket: where such rows would
fill one, they are counted first and dealt as one row with its number of ``times``.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.llm.common import id_and_text, rows
from scarpline.session import cut_lineage

BUCKET_BYTES = 1 << 22
FACTS = "part long, dest long, payload binary"
ROW_BYTES = 64  # what a row weighs besides its text
TURN = 1 << 15  # copies made of a row at once
_CODEC = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join([
        struct.pack("<B", len(arrays)),
        *(struct.pack("<4sQ", a.dtype.str.encode().ljust(4), a.nbytes) + a.tobytes() for a in arrays)])
    return struct.pack("<Q", len(raw)) + _CODEC.compress(raw, asbytes=True)


def unpack(payload: bytes) -> list[np.ndarray]:
    (size,) = struct.unpack_from("<Q", payload)
    raw = _CODEC.decompress(payload[8:], size, asbytes=True)
    at, out = 1, []
    for _ in range(raw[0]):
        kind, length = struct.unpack_from("<4sQ", raw, at)
        at += 12
        out.append(np.frombuffer(raw, kind.decode().strip(), length // np.dtype(kind.decode().strip()).itemsize, at))
        at += length
    return out


def gaps(places: np.ndarray) -> np.ndarray:
    """Rising places as differences, which compress well."""
    return np.diff(places, prepend=0).astype("<u4")


def from_gaps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.int64)


def fact_rows(facts: list[tuple[int, int, bytes]]) -> pa.Table:
    part, dest, payload = zip(*facts, strict=True) if facts else ((), (), ())
    return pa.table({"part": pa.array(part, pa.int64()), "dest": pa.array(dest, pa.int64()),
                     "payload": pa.array(payload, pa.binary())})


def ordered(table: pa.Table) -> tuple[list[int | None], list[bytes], list[int]]:
    """Ids, texts and times of a bucket's rows in its fixed order."""
    found = sorted(zip(rows(table, binary=True), table.column("times").to_pylist(), strict=True),
                   key=lambda r: (r[0][0] is None, r[0][0] or 0, r[0][1]))
    return [r[0][0] for r in found], [r[0][1] for r in found], [r[1] for r in found]


def _counted(text_rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """(doc_id, text, times) and the bytes of all rows. Rows that repeat id and text, and would fill more
    than ``limit`` bytes, are one."""
    weight = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    keyed = text_rows.withColumn("__key", F.xxhash64("doc_id", "text"))
    # Only hashes and sizes are shuffled, merged on the map side.
    groups = keyed.groupBy("__key").agg(F.sum(weight).alias("bytes"), F.count(F.lit(1)).alias("n"))
    total, most = groups.agg(F.sum("bytes"), F.max(F.when(F.col("n") > 1, F.col("bytes")))).first()
    one = F.lit(1).cast("long").alias("times")
    if (most or 0) <= limit:
        return text_rows.select("doc_id", "text", one), total or 0
    hot = cut_lineage(groups.where((F.col("n") > 1) & (F.col("bytes") > limit)).select("__key"))
    merged = keyed.join(hot, "__key", "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("times"))
    others = keyed.join(hot, "__key", "left_anti").select("doc_id", "text", one)
    return others.unionByName(merged), total


def _each(found: DataFrame) -> DataFrame:
    """A row for each of a row's times, made in bounded arrays."""
    turns = found.withColumn("__turn", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {TURN}"))))
    return turns.withColumn("__i", F.explode(F.sequence(
        F.col("__turn") * TURN + 1, F.least(F.col("times"), (F.col("__turn") + 1) * TURN)))).drop("times", "__turn", "__i")


class Exchange:
    """Rounds of compare-and-answer over the documents of one table."""

    def __init__(self, docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, part_bytes: int = BUCKET_BYTES) -> None:
        """``part_bytes``: text whose facts one part should compare, at their usual density."""
        counted, total = _counted(id_and_text(docs), bucket_bytes)
        self.parts = total // part_bytes + 1
        dest = F.pmod(F.xxhash64("doc_id", "text"), F.lit(total // bucket_bytes + 1))
        # Every round groups this same projection, so its shuffle is made once and reused.
        self.dealt = counted.select(dest.alias("dest"), "doc_id", "text", "times")

    def facts(self, make: Callable, answers: DataFrame | None = None, schema: str = FACTS) -> DataFrame:
        """``make(dest, table, payloads)`` for every bucket, with the answers that came back to it."""
        groups = self.dealt.groupBy("dest")
        if answers is None:
            def alone(key: tuple, table: pa.Table) -> pa.Table:
                return make(key[0].as_py(), table, [])

            return groups.applyInArrow(alone, schema)

        def met(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
            return make(key[0].as_py(), table, back.column("payload").to_pylist())

        return groups.cogroup(answers.groupBy("dest")).applyInArrow(met, schema)

    def results(self, make: Callable, answers: DataFrame, schema: str) -> DataFrame:
        """The last round's rows; ``make`` gives each document's with its ``times``."""
        return _each(self.facts(make, answers, f"{schema}, times long"))

    def compared(self, facts: DataFrame, compare: Callable) -> DataFrame:
        """Answers (dest, payload): ``compare(dests, payloads)`` yields them for the facts of a part.

        A fact with a negative part is an answer its bucket found by itself and goes straight back.
        """
        def part(key: tuple, table: pa.Table) -> pa.Table:
            dests, payloads = table.column("dest").to_pylist(), table.column("payload").to_pylist()
            if key[0].as_py() >= 0:
                answers = list(compare(dests, payloads))
                dests, payloads = zip(*answers, strict=True) if answers else ((), ())
            return pa.table({"dest": pa.array(dests, pa.int64()), "payload": pa.array(payloads, pa.binary())})

        return facts.groupBy("part").applyInArrow(part, "dest long, payload binary")


def by_part(parts: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(part, indices in rising order) of every part that occurs."""
    order = np.argsort(parts, kind="stable")
    cuts = np.flatnonzero(np.diff(parts[order])) + 1
    return [(int(parts[i[0]]), i) for i in np.split(order, cuts) if len(i)]


def first_and_others(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first of every distinct value; whether each value occurs more than once."""
    _, first, inverse, counts = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    return np.sort(first), counts[inverse] > 1
