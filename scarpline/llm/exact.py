"""Exact deduplication by composable polynomial fingerprints.

A text is a number in base r, once modulo each of two primes. A chunk's value needs only the chunk,
and two neighbours combine by ``H(AB) = H(A) * r^|B| + H(B)``: chunks can be hashed anywhere and
merged in any bracketing. Rows with the same fingerprint and length form a candidate group; their
texts are then compared chunk by chunk, as a map-side combined min/max per (group, chunk), so a
group of any size never meets in one task. A group whose chunks differ (a fingerprint collision) is
split by the SHA-256 of the text.

Texts are equal when identical after every run of ``[\\x20\\x09-\\x0D]`` became one space. A null text
is empty, empty texts are equal to each other. Rows that repeat id and text are one document given
several times: all are returned, one is kept. A null id is larger than any other: it stays only in a
group without ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.llm.common import id_and_text, once_each, one_space, rows, with_row_key
from scarpline.session import cut_lineage

PRIMES = (2147483647, 2147483629)
BASES = (1000003579, 1732050823)
CHUNK = 1 << 16  # bytes; 2^8 * 2^31 * 2^16 stays below 2^64


def _powers(prime: int, base: int) -> np.ndarray:
    """base^(CHUNK-1) ... base^0."""
    table = np.empty(CHUNK, dtype=np.uint64)
    value = 1
    for i in range(CHUNK - 1, -1, -1):
        table[i] = value
        value = value * base % prime
    return table


_TABLES: list[np.ndarray] = []


def chunk_hash(chunk: bytes) -> tuple[int, int]:
    """The chunk's value modulo each prime; at most CHUNK bytes."""
    if not _TABLES:
        _TABLES.extend(_powers(p, b) for p, b in zip(PRIMES, BASES, strict=True))
    data = np.frombuffer(chunk, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(
        int(np.dot(data, table[CHUNK - len(data):])) % prime
        for table, prime in zip(_TABLES, PRIMES, strict=True)
    )


def combine(left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
    """Fingerprint of AB from those of A and B."""
    return tuple(
        (a * pow(base, right_length, prime) + b) % prime
        for a, b, prime, base in zip(left, right, PRIMES, BASES, strict=True)
    )


def fingerprint(text: bytes) -> int:
    """Both residues of a whole text in one integer, merged from its chunks."""
    value = (0, 0)
    for start in range(0, len(text), CHUNK):
        chunk = text[start:start + CHUNK]
        value = combine(value, chunk_hash(chunk), len(chunk))
    return value[0] << 31 | value[1]


def chunk_fingerprints(chunks: DataFrame) -> DataFrame:
    """For huge documents kept as chunk rows (doc_id, chunk_no, bytes): fingerprint, n_bytes per doc_id.

    Chunks of at most CHUNK bytes are hashed where they lie; one row of residues and shifts per chunk
    is shuffled, and the merge is a fold of modular arithmetic in the JVM.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, number, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                data = data or b""
                shift = [pow(base, len(data), prime) for base, prime in zip(BASES, PRIMES, strict=True)]
                out.append((doc_id, number, len(data), *chunk_hash(data), *shift))
            columns = [list(x) for x in zip(*out, strict=True)] or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "n", "size", "h1", "h2", "s1", "s2"])

    rows_ = chunks.select(F.col("doc_id").cast("long"), F.col("chunk_no").cast("long"), "bytes").mapInArrow(
        hashed, "doc_id long, n long, size long, h1 long, h2 long, s1 long, s2 long")
    parts = F.sort_array(F.collect_list(F.struct("n", "size", "h1", "h2", "s1", "s2")))

    def fold(h: str, s: str, prime: int):
        return F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: (a * x[s] + x[h]) % F.lit(prime))

    return rows_.groupBy("doc_id").agg(parts.alias("parts"), F.sum("size").alias("n_bytes")).select(
        "doc_id",
        (F.shiftleft(fold("h1", "s1", PRIMES[0]), 31) + fold("h2", "s2", PRIMES[1])).alias("fingerprint"),
        "n_bytes",
    )


TURN = 1 << 16  # copies of a repeated row in one array


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, prints, sizes, digests = [], [], [], []
        for doc_id, text in rows(batch, binary=True):
            text = one_space(text)
            ids.append(doc_id)
            prints.append(fingerprint(text))
            sizes.append(len(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), batch.column("row_hash"), pa.array(prints, pa.int64()),
             pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())],
            ["doc_id", "row_hash", "fingerprint", "n_bytes", "sha"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk of a text that shares its fingerprint with another row."""
    names = ["fingerprint", "n_bytes", "chunk_no", "bytes"]
    for batch in batches:
        out: list[list] = [[], [], [], []]
        keys = zip(batch.column("fingerprint").to_pylist(), batch.column("n_bytes").to_pylist(), strict=True)
        for (_, text), (mark, size) in zip(rows(batch, binary=True), keys, strict=True):
            text = one_space(text)
            for start in range(0, len(text), CHUNK):
                for column, value in zip(out, (mark, size, start // CHUNK, text[start:start + CHUNK]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
             pa.array(out[3], pa.binary())], names)


def _compared(text_rows: DataFrame, members: DataFrame) -> DataFrame:
    """Candidate groups whose texts are not all the same: (fingerprint, n_bytes)."""
    key = ["fingerprint", "n_bytes"]
    # A text meets the key of its own row hash alone, whatever rows share its id or have none.
    marked = text_rows.withColumn("row_hash", F.xxhash64("text"))
    wanted = members.select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"), *key).distinct()
    own = marked.join(wanted, marked.doc_id.eqNullSafe(F.col("__id")) & (
        F.col("row_hash").eqNullSafe(F.col("__hash")))).select("doc_id", "text", *key)
    chunks = own.mapInArrow(_chunks, "fingerprint long, n_bytes long, chunk_no long, bytes binary")
    spans = chunks.groupBy(*key, "chunk_no").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
    return spans.where("low <> high").select(*key).distinct()


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, fingerprint and
    row_hash, the hash of the text as it is."""
    text_rows = id_and_text(docs)
    prints = text_rows.select("doc_id", "text", F.xxhash64("text").alias("row_hash")).mapInArrow(
        _fingerprints, "doc_id long, row_hash long, fingerprint long, n_bytes long, sha binary")
    key = ["fingerprint", "n_bytes"]
    # Repeated rows collapse map-side, with their number, and come back at the end.
    found = cut_lineage(prints.groupBy(*key, "sha", "doc_id", "row_hash").agg(F.count(F.lit(1)).alias("times")))
    groups = found.groupBy(*key).agg(F.sum("times").alias("size"))
    shared = cut_lineage(groups.where("size > 1").select(*key))
    members = found.join(shared, key, "left_semi").select("doc_id", "row_hash", *key).where("n_bytes > 0")
    mixed = _compared(text_rows, members).withColumn("__mixed", F.lit(True))
    keyed = found.join(mixed, key, "left").withColumn(
        "__part", F.when(F.col("__mixed"), F.col("sha")).otherwise(F.lit(b""))).drop("__mixed")
    split = [*key, "__part"]
    keyed = cut_lineage(keyed)
    # The largest groups hold many rows of this join's left side, which adaptive execution can split.
    kept = cut_lineage(
        keyed.groupBy(*split).agg(
            F.min("doc_id").alias("keep_id"), F.sum("times").alias("group_size"),
            # Of texts that differ in white space only, under one id, the first hash.
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")).getField("row_hash").alias("first_hash"))
        .where("group_size > 1"))
    joined = keyed.join(kept, split, "left").withColumns({
        "keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")),
        "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
        "first_hash": F.coalesce("first_hash", "row_hash"),
    })
    # Rows that were counted come back one by one, in bounded arrays.
    turns = joined.withColumn("__turn", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {TURN}"))))
    each = turns.withColumn("__i", F.explode(F.sequence(
        F.col("__turn") * TURN + 1, F.least(F.col("times"), (F.col("__turn") + 1) * TURN))))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row_hash") == F.col("first_hash"))
    return each.select(
        "doc_id", "keep_id", "group_size", (first & (F.col("__i") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "n_bytes", "fingerprint", "row_hash",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`exact_groups` keeps."""
    kept = exact_groups(docs).where("kept").select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("row_hash").alias("__hash"))
    return once_each(with_row_key(docs).join(kept, ["__id", "__hash"], "left_semi"), docs.columns)
