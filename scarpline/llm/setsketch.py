"""Near-duplicates by SetSketch registers.

A document is the set of its 5-word shingles. Register i holds the smallest of the exponentially
distributed values that hash i gives the shingles, rounded to a power of ``BASE`` and truncated to 16
bits: ``K = floor(1 - log_b(min))``. Registers of a union are the maxima of the registers. Two sets
agree in a register with about the probability of their similarity, so bands of ``ROWS`` registers
are locality-sensitive: at similarity 0.75 a pair misses all ``BANDS`` bands with probability 5e-6.

How often one sketch's registers are above, below or equal to the other's gives, with both set sizes
known, the likelihood of the similarity; its maximum decides which candidates are verified on their
full sets (``DOUBT`` standard deviations of slack, so a link is lost with probability below 1e-6).

Only connectivity is needed, so pairs inside a group that is already connected are never formed:

1. Documents with equal sets are one class, numbered in the order of set digests.
2. Every class is compared with the first class it shares a band with. The verified links form a
   forest, whose trees are the first components.
3. In bands that still hold several components, the sketches of classes of different components meet in
   cells of ``CELL`` by ``CELL``. Classes with a likely partner come back to their cell with one text each.
   Likely pairs are verified there, likeliest first, unless links found in the cell connect them
   already; only the links that connect leave the cell.

Words are runs outside ``[\\x20\\x09-\\x0D]`` after A-Z are lower-cased; a text of 1 to 4 words has its
whole sequence as one shingle; null, empty and blank texts have no shingle and no link. Rows of one id
with different texts are documents of their own. Rows without an id are linked like all others, also as
a bridge between rows with ids. A component without any id has a null ``component_id``; there the rows
of the text with the smallest hash are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.llm.common import id_and_text, once_each, rows, with_row_key
from scarpline.llm.components import components, roots
from scarpline.llm.words import mixed, window_hashes, words_of
from scarpline.session import cut_lineage

SHINGLE = 5
SIMILAR = 75  # per cent of the union
REGISTERS = 128
ROWS = 4
BANDS = REGISTERS // ROWS
BASE = 1.001
RATE = 20.0
LARGEST = (1 << 16) - 1
DOUBT = 5.0
CELL = 1024
_LOWER = bytes(range(256)).lower()
_STEP = 4096  # shingles hashed against all registers at once
_ROW = ["key", "l", "r", "side", "rep", "comp", "n", "sketch"]  # of a cell

_seeds = mixed(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = (_seeds[:REGISTERS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (_seeds[REGISTERS:] >> np.uint64(32)).astype(np.uint32)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a word sequence."""
    if len(hashes) >= SHINGLE:
        return np.unique(window_hashes(hashes, SHINGLE))
    # Fewer words: the whole sequence is one shingle.
    return window_hashes(hashes, len(hashes)) + np.uint64(len(hashes)) if len(hashes) else hashes


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    for hashes, _, _ in words_of([t.translate(_LOWER) for t in texts]):
        yield shingles(hashes)


def registers(elements: np.ndarray) -> np.ndarray:
    """The sketch of a set of mixed hashes; all zero for the empty set."""
    if not len(elements):
        return np.zeros(REGISTERS, dtype=np.uint16)
    high = (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for first in range(0, len(high), _STEP):
        values = _FACTOR[:, None] * high[None, first:first + _STEP]
        values += _SHIFT[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    smallest = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(left, right)


def _below(x: np.ndarray) -> np.ndarray:
    return -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-300)) / np.log(BASE)


def estimate(above: np.ndarray, below: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Similarity of the largest likelihood: ``above`` registers of the left sketch are larger.

    The likelihood is concave in the similarity; a ternary search finds its maximum.
    """
    u = n_left / (n_left + n_right)
    v = 1 - u
    equal = REGISTERS - above - below

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = _below(np.maximum(u - v * j, 0)), _below(np.maximum(v - u * j, 0))
        return (above * np.log(np.maximum(p, 1e-12)) + below * np.log(np.maximum(q, 1e-12))
                + equal * np.log(np.maximum(1 - p - q, 1e-12)))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):
        left, right = low + (high - low) / 3, high - (high - low) / 3
        rises = likelihood(left) < likelihood(right)
        low, high = np.where(rises, left, low), np.where(rises, high, right)
    return (low + high) / 2


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, the band's number mixed in."""
    packed = np.ascontiguousarray(sketch).view(np.uint64)
    return mixed(packed ^ mixed(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = zip(*rows(batch, binary=True), strict=True) if batch.num_rows else ((), ())
        sizes, digests, sketches = [], [], []
        for elements in shingle_sets(list(texts)):
            sizes.append(len(elements))
            digests.append(hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None)
            sketches.append(registers(elements).tobytes() if len(elements) else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), batch.column("row_hash"), pa.array(sizes, pa.int64()),
             pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
            ["doc_id", "row_hash", "n_shingles", "digest", "sketch"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
        keys = np.concatenate([band_keys(s) for s in sketches]) if len(sketches) else np.empty(0, dtype=np.int64)
        reps = np.repeat(np.array(batch.column("rep"), dtype=np.int64), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(reps)], ["key", "rep"])


def _verified(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose full sets are similar enough."""
    for batch in batches:
        pairs = list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
        left = shingle_sets([t or b"" for t in batch.column("text_a").cast(pa.binary()).to_pylist()])
        right = shingle_sets([t or b"" for t in batch.column("text_b").cast(pa.binary()).to_pylist()])
        linked = []
        for pair, one, other in zip(pairs, left, right, strict=True):
            common = len(np.intersect1d(one, other, assume_unique=True))
            if common and 100 * common >= similar * (len(one) + len(other) - common):
                linked.append(pair)
        a, b = zip(*linked, strict=True) if linked else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _likely(cell: list[tuple], similar: int, cut: float) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a cell's left with their likely partners on its right, likeliest first.

    Rows are (key, l, r, side, rep, comp, n, sketch, ...); side is 0 right, 1 left, 2 both. A pair is
    looked at only in the first band it shares, and not inside a component.
    """
    left, right = [r for r in cell if r[3]], [r for r in cell if r[3] != 1]
    if not left or not right:
        return
    sketches = np.frombuffer(b"".join(r[7] for r in right), dtype=np.uint16).reshape(-1, REGISTERS)
    side, rep, comp, n = (np.array([r[i] for r in right], dtype=np.int64) for i in (3, 4, 5, 6))
    band = int(np.argmax(band_keys(sketches[0]) == cell[0][0]))
    for row in left:
        fit = (comp != row[5]) & (100 * np.minimum(n, row[6]) >= similar * np.maximum(n, row[6]))
        if row[3] == 2:
            fit &= (side != 2) | (rep > row[4])
        at = np.flatnonzero(fit)
        if not len(at):
            continue
        sketch, others = np.frombuffer(row[7], dtype=np.uint16), sketches[at]
        equal = sketch == others
        first = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
        # An equal register has about the probability of the similarity.
        ok = (first == band) & (equal.sum(axis=1) >= REGISTERS * (cut - 0.15))
        if not ok.any():
            continue
        at, others = at[ok], others[ok]
        above, below = (sketch > others).sum(axis=1), (sketch < others).sum(axis=1)
        j = estimate(above, below, np.full(len(at), float(row[6])), n[at].astype(float))
        found = at[np.argsort(-j, kind="stable")][:int((j >= cut).sum())].tolist()
        if found:
            yield row, [right[i] for i in found]


def _links(cell: list[tuple], similar: int, cut: float) -> list[tuple[int, int]]:
    """Verified links that connect different components of a cell, whose rows end with a text; at most
    one link for each row. Pairs that links of this cell already connect are not looked at."""
    top: dict[int, int] = {}
    sets: dict[bytes, np.ndarray] = {}
    out = []

    def root(c: int) -> int:
        while top.get(c, c) != c:
            c = top[c]
        return c

    def elements(text: bytes) -> np.ndarray:
        if text not in sets:
            sets[text] = next(shingle_sets([text]))
        return sets[text]

    for row, partners in _likely(cell, similar, cut):
        for partner in partners:
            mine, other = root(row[5]), root(partner[5])
            if mine == other:
                continue
            one, two = elements(row[8]), elements(partner[8])
            common = len(np.intersect1d(one, two, assume_unique=True))
            if common and 100 * common >= similar * (len(one) + len(two) - common):
                top[max(mine, other)] = min(mine, other)
                out.append((row[4], partner[4]))
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each cell; they come sorted by cell, and a cell fits in memory."""
    held: list[tuple] = []
    for batch in batches:
        columns = [c.cast(pa.binary()) if name == "text" else c for name, c in zip(batch.schema.names, batch.columns, strict=True)]
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            if held and row[:3] != held[0][:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _cut(similar: int) -> float:
    return similar / 100 - DOUBT * np.sqrt(similar / 100 * (1 - similar / 100) / REGISTERS)


def _wanted(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    """The rows of cells that have a likely partner there."""
    schema = pa.schema([(n, pa.binary() if n == "sketch" else pa.int64()) for n in _ROW])
    for cell in _cells(batches):
        found = {}
        for row, partners in _likely(cell, similar, _cut(similar)):
            found |= {(r[3], r[4]): r for r in (row, *partners)}
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*found.values(), strict=True), schema, strict=True)], schema=schema)


def _linked(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    """Verified links (a, b) of each cell."""
    for cell in _cells(batches):
        a, b = zip(*found, strict=True) if (found := _links(cell, similar, _cut(similar))) else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _check(pairs: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """Verified pairs. ``b`` may be one class in a great many pairs: its side is unique, so that
    adaptive execution can split the other."""
    first = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        lambda batches: _verified(batches, similar), "a long, b long").distinct()


def _open_links(members: DataFrame, comps: DataFrame, facts: DataFrame, texts: DataFrame, similar: int,
                cell: int) -> DataFrame:
    """Verified links (a, b) between components that share a band; bands with one component are done."""
    placed = cut_lineage(members.select("key", "rep").join(comps, "rep"))
    open_ = placed.groupBy("key").agg(
        F.min("comp").alias("main"), F.max("comp").alias("last"), F.count(F.lit(1)).alias("m")
    ).where("main < last").select("key", "main", "m")
    rest = placed.join(open_, "key").join(facts, "rep").withColumns({
        "blocks": (F.floor(F.col("m") / cell) + 1).cast("long"), "other": F.col("comp") != F.col("main")})
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("own")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("every")
    # Every pair of different components has a member outside the main one: that is its left. In a band
    # of one block the same row stands on both sides.
    both = F.when(F.col("other") & (F.col("blocks") == 1), 2).otherwise(0).cast("long")
    side = [both.alias("side"), *_ROW[4:]]
    right = rest.select("key", every.alias("l"), own.alias("r"), *side)
    left = rest.where("other and blocks > 1").select(
        "key", own.alias("l"), every.alias("r"), F.lit(1).cast("long").alias("side"), *_ROW[4:])

    def by_cell(rows_: DataFrame) -> DataFrame:
        return rows_.repartition("key", "l", "r").sortWithinPartitions("key", "l", "r", "rep")

    schema = ", ".join(f"{name} {'binary' if name == 'sketch' else 'long'}" for name in _ROW)
    wanted = cut_lineage(by_cell(left.union(right)).mapInArrow(lambda batches: _wanted(batches, similar), schema))
    return by_cell(wanted.join(texts, "rep").select(*_ROW, "text")).mapInArrow(
        lambda batches: _linked(batches, similar), "a long, b long")


def near_groups(docs: DataFrame, similar: int = SIMILAR, cell: int = CELL) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept and row_hash, a hash of the text."""
    text_rows = id_and_text(docs)
    sketched = cut_lineage(text_rows.select("doc_id", "text", F.xxhash64("text").alias("row_hash")).mapInArrow(
        _sketched, "doc_id long, row_hash long, n_shingles long, digest binary, sketch binary"))
    no_id = F.lit(-(1 << 63))
    grouped = sketched.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.min("row_hash").alias("least_hash"),
        F.min(F.struct(F.coalesce("doc_id", no_id).alias("__id"), F.col("row_hash").alias("__hash"))).alias("one"),
        F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut_lineage(grouped.sortWithinPartitions("digest").withColumn("rep", F.monotonically_increasing_id()))
    banded = classes.select("rep", "sketch").mapInArrow(_banded, "key long, rep long")
    centres = cut_lineage(
        banded.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last"))
        .where("centre < last").select("key", "centre"))
    members = cut_lineage(banded.join(centres, "key"))

    nodes = members.select("rep").distinct()
    # One row of each class that shares a band; rows that repeat id and text are merged before the shuffle.
    ones = classes.join(nodes, "rep", "left_semi").select("rep", "one.*")
    texts = cut_lineage(with_row_key(text_rows).join(ones, ["__id", "__hash"]).select("rep", "text").dropDuplicates(["rep"]))
    stars = members.where("centre < rep").groupBy(F.col("rep").alias("a")).agg(F.min("centre").alias("b"))
    linked = _check(stars, texts, similar).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    alone = nodes.select(F.col("rep").alias("node"), F.col("rep").alias("root"))
    trees = roots(alone.join(linked.withColumnRenamed("root", "__root"), "node", "left").select(
        "node", F.coalesce("__root", "root").alias("root")))

    facts = classes.select("rep", "n", "sketch")
    comps = trees.select(F.col("node").alias("rep"), F.col("root").alias("comp"))
    links = cut_lineage(_open_links(members, comps, facts, texts, similar, cell).distinct())
    if not links.isEmpty():
        joined = links.join(comps.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), "a").join(
            comps.select(F.col("rep").alias("b"), F.col("comp").alias("cb")), "b")
        merged = components(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        trees = trees.join(merged.select(F.col("node").alias("root"), F.col("root").alias("__top")), "root", "left").select(
            "node", F.coalesce("__top", "root").alias("root"))

    final = trees.select(F.col("node").alias("rep"), "root")
    placed = cut_lineage(classes.select("digest", "rep", "least", "least_hash").join(final, "rep", "left").withColumn(
        "root", F.coalesce("root", "rep")))
    named = placed.groupBy("root").agg(F.min("least").alias("top"), F.min("least_hash").alias("first_hash"))
    of_class = cut_lineage(placed.select("digest", "root").join(named, "root").select("digest", "top", "first_hash"))
    # A class may hold a large share of all rows; its side here is unique.
    found = sketched.drop("sketch").join(of_class, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    kept = F.when(F.col("digest").isNull(), True).when(
        F.col("top").isNull(), F.col("row_hash") == F.col("first_hash")).otherwise(
        F.coalesce(F.col("doc_id") == F.col("top"), F.lit(False)))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "row_hash")


def keep_first(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`near_groups` keeps, one per id and text. Rows with
    neither id nor word all stay, since nothing says that they are the same document."""
    kept = near_groups(docs, similar).where("kept").select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("row_hash").alias("__hash"))
    nothing = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    named = with_row_key(docs.where(~nothing)).join(kept.distinct(), ["__id", "__hash"], "left_semi")
    return once_each(named, docs.columns).unionByName(docs.where(nothing))
