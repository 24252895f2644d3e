"""Token ids on disk under a canonical length-limited Huffman code.

1. Every text is tokenized; ids are staged in the shared folder and counted.
2. The counts, at most one row per vocabulary entry, give code lengths by package-merge, at most
   ``LIMIT`` bits; canonical codes follow from the lengths alone.
3. Staged documents are range-partitioned and sorted by id; each task codes them, one block after
   another. A block decodes by itself: it has its documents' ids and lengths, and a bit length every
   ``STEP`` symbols. From these checkpoints, all stretches of a block are decoded side by side, one
   table look-up per symbol of each stretch.

File format: a folder ``blocks`` of block rows (part, first_token, n_tokens, payload) in Parquet
files, parts in ascending doc_id order, and a folder ``codebook`` of (token_id, bits). A payload is:

    magic "CHB1" | u32 documents | u32 stretches | u64 tokens            little-endian
    i64 doc_id of every document | u8 whether it is null | u32 tokens of every document
    u16 bits of every stretch | code bits, first bit highest, zero-padded to 8 bytes

A null text is empty and still has its end id. Null ids come first; rows that repeat an id are
documents of their own, side by side, in the order of a checksum of their token ids, so that reruns agree.
Rows that agree in both are dealt by their row number, so no range holds all of them. A long document is a
block of its own, of its own size. An empty table gives empty folders.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scarpline.llm.common import id_and_text, rows
from scarpline.llm.tokens import encoder, vocabulary_size

LIMIT = 18  # longest code
STEP = 128  # symbols between bit-offset checkpoints
BLOCK_TOKENS = 1 << 18
_HEAD = struct.Struct("<4sIIQ")
_STAGED = "doc_id long, check long, row long, ids binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for symbols that never occur."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes longer than {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    merged, levels = weights, [np.ones(len(weights), dtype=bool)]
    for _ in range(limit - 1):
        pairs = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        levels.append(order < len(weights))
    chosen, depth = 2 * len(weights) - 2, np.zeros(len(weights), dtype=np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:chosen].sum())
        depth[:leaves] += 1
        chosen = 2 * (chosen - leaves)
    lengths[used] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code, before = 0, 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        code <<= bits - before
        before = bits
        symbols = np.flatnonzero(lengths == bits)
        codes[symbols] = code + np.arange(len(symbols), dtype=np.uint64)
        code += len(symbols)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and code length for every value of the next ``width`` bits."""
    width = max(int(lengths.max(initial=0)), 1)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spread = 1 << (width - lengths[order].astype(np.int64))
    symbols, bits = np.repeat(order, spread), np.repeat(lengths[order], spread)
    room = (1 << width) - len(symbols)
    # Only a one-symbol code leaves values unused.
    return (np.concatenate([symbols, np.zeros(room, dtype=symbols.dtype)]).astype(np.int32),
            np.concatenate([bits, np.ones(room, dtype=bits.dtype)]), width)


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits of ``ids`` padded to 8 bytes, and the end of every symbol in bits."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 64 + 1, dtype=np.uint64)
    if len(ids):
        code = codes[ids]
        begin = ends - bits
        word, over = begin >> 6, (begin & 63) + bits - 64
        inside = over <= 0
        left = np.where(inside, -over, 0).astype(np.uint64)
        right = np.where(inside, 0, over).astype(np.uint64)
        value = np.where(inside, code << left, code >> right)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] = np.bitwise_or.reduceat(value, first)
        cut = np.flatnonzero(over > 0)
        words[word[cut] + 1] |= code[cut] << (64 - over[cut]).astype(np.uint64)
    return words[:(total + 63) // 64].astype(">u8").tobytes(), ends


def write_block(documents: list[tuple[int | None, np.ndarray]], codes: np.ndarray, lengths: np.ndarray) -> bytes:
    ids = np.concatenate([d[1] for d in documents])
    data, ends = pack_bits(ids, codes, lengths)
    marks = ends[np.minimum(np.arange(STEP - 1, len(ids) + STEP - 1, STEP), len(ids) - 1)] if len(ids) else ends
    return b"".join((
        _HEAD.pack(b"CHB1", len(documents), len(marks), len(ids)),
        np.array([d[0] or 0 for d in documents], dtype="<i8").tobytes(),
        np.array([d[0] is None for d in documents], dtype=np.uint8).tobytes(),
        np.array([len(d[1]) for d in documents], dtype="<u4").tobytes(),
        np.diff(marks, prepend=0).astype("<u2").tobytes(), data))


def read_block(payload: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, null marks, lengths and the ids of all documents of a block."""
    magic, n_docs, n_marks, n_tokens = _HEAD.unpack_from(payload)
    if magic != b"CHB1":
        raise ValueError("not a block of this format")
    at = _HEAD.size
    parts = []
    for kind, count in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u2", n_marks)):
        parts.append(np.frombuffer(payload, kind, count, at))
        at += parts[-1].nbytes
    doc_ids, absent, sizes, steps = parts
    symbols, bits, width = table
    data = np.concatenate([np.frombuffer(payload, np.uint8, offset=at), np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    # The 32 bits from every byte on: enough for a code that starts anywhere in it.
    ahead = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    place = np.cumsum(steps, dtype=np.int64) - steps
    last = np.int64(max(len(ahead) - 1, 0))
    out = np.empty((STEP, n_marks), dtype=np.int32)
    shift, mask = 32 - width, (1 << width) - 1
    for step in range(STEP):
        next_bits = ahead[np.minimum(place >> 3, last)] >> (shift - (place & 7)).astype(np.uint32) & np.uint32(mask)
        out[step] = symbols[next_bits]
        place += bits[next_bits]
    return doc_ids, absent, sizes, out.T.reshape(-1)[:n_tokens]


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int, kind: str) -> DataFrame:
    """(doc_id, check, row, ids): what orders the documents, and the token ids as bytes."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seen = encoder(tokenizer, end_id), 0
        for batch in batches:
            doc_ids, texts = zip(*rows(batch), strict=True) if batch.num_rows else ((), ())
            ids = [found.astype(kind).tobytes() for _, found in ids_of.batch(list(texts))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                 pa.array(range(seen, seen + len(ids)), pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "check", "row", "ids"])
            seen += len(ids)

    return id_and_text(docs).mapInArrow(encode, _STAGED)


def _counts(staged: DataFrame, kind: str, size: int) -> np.ndarray:
    """How often every id of the vocabulary occurs; tasks send one row per id they met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=size) if len(
                    ids.as_buffer()) > 8 * size else 0
            short = b"".join(x for x in batch.column("ids").to_pylist() if len(x) <= 8 * size)
            total += np.bincount(np.frombuffer(short, kind), minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["token_id", "n"])

    summed = staged.select("ids").mapInArrow(count, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, dtype=np.int64)
    for row in summed.collect():  # at most one row per vocabulary entry
        counts[row["token_id"]] = row["n"]
    return counts


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes ``folder/blocks`` and ``folder/codebook``; ``folder/staged`` is a work table."""
    spark = docs.sparkSession
    size = max(vocabulary_size(tokenizer), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    _tokenized(docs, tokenizer, end_id, kind).write.option("compression", "zstd").parquet(f"{folder}/staged")
    staged = spark.read.schema(_STAGED).parquet(f"{folder}/staged")
    lengths = code_lengths(_counts(staged, kind, size))
    codes = canonical_codes(lengths)
    met = np.flatnonzero(lengths)
    spark.createDataFrame(
        pa.table({"token_id": pa.array(met, pa.int64()), "bits": pa.array(lengths[met].astype(np.int64))})
    ).write.parquet(f"{folder}/codebook")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        held, tokens = [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (part, first, tokens)] + [pa.array([write_block(held, codes, lengths)], pa.binary())],
                ["part", "first_token", "n_tokens", "payload"])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(ids.as_buffer(), kind)
                held.append((doc_id, ids))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield block()
                    first, held, tokens = first + tokens, [], 0
        if held:
            yield block()

    # The bounds are sampled from the staged table, so nothing is computed twice for them.
    order = ["doc_id", "check", "row"]
    staged.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(
        blocks, "part long, first_token long, n_tokens long, payload binary"
    ).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_ids(spark, folder: str) -> DataFrame:
    """Per document of the written folder: doc_id, start, n_tokens, ids_crc32."""
    book = spark.read.parquet(f"{folder}/codebook").collect()  # at most one row per vocabulary entry
    lengths = np.zeros(max((r["token_id"] for r in book), default=0) + 1, dtype=np.uint8)
    for row in book:
        lengths[row["token_id"]] = row["bits"]
    blocks = spark.read.schema("part long, first_token long, n_tokens long, payload binary").parquet(f"{folder}/blocks")
    # One row per part, that is per task that wrote blocks.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = parts.select(
        F.col("part").alias("__part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("__before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for first, payload in zip(batch.column("first").to_pylist(), batch.column("payload"), strict=True):
                doc_ids, absent, sizes, ids = read_block(payload.as_py(), table)
                sizes = sizes.astype(np.int64)
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4").tobytes()
                checks = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64(), mask=absent.astype(bool)), pa.array(first + ends - sizes),
                     pa.array(sizes), pa.array(checks, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = blocks.join(starts, F.col("part") == F.col("__part")).select(
        (F.col("__before") + F.col("first_token")).alias("first"), "payload")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
