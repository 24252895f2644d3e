"""Periodic runs of words: stretches that repeat with a period, found by seeds and extended on diagonals.

Two places ``q`` apart lie on the diagonal of lag ``q``. A run of period ``q`` and length ``m`` is a
stretch of ``m - q`` equal places on that diagonal, at least ``max(min_length - q, q)``. So with grams of
``k`` words, twice ``k`` less one being at most that many, the stretch holds a whole gram that starts at
a multiple of ``k``. Lags are served in classes by their ``k``, a power of two: the grams of a class are
indexed, each gram at a multiple of ``k`` is paired with its occurrences at the lags of the class, at
most two times ``k`` of them, and so a class has at most two pairs per word however often a gram occurs.

Pairs are taken by lag and place; a table of the furthest place covered on each lag drops a seed that
starts where the last one ended, as it belongs to the stretch that is already extended. Inside a run of a
period of at most ``k / 2`` every equal pair repeats that run, so pairs that lie in one such run are not
made, and grams that occur nowhere else leave the index. A stretch is extended to both sides by less
than ``k``, by comparing grams of all smaller powers of two. Grams are known by exact ranks, made by
doubling; nothing is hashed.

Everything is local to a text, so there is one pass and no shuffle; texts are handled together up to
``SLICE`` bytes, a longer one alone. Ranks take 4 bytes per word for each doubling up to the length
of the longest repeat that is no part of one run; with the index about 100 bytes per word at that
moment. A null text has no words. Ids may repeat or be null, rows may repeat; each row is answered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.llm.common import id_and_text, rows
from scarpline.llm.words import batches_of

MIN_LENGTH = 12
PAIRS = 1 << 22  # pairs held at once
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_KINDS = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_dropped": pa.int64(), "runs": pa.list_(_RUN),
          "collapsed": pa.string()}
_SCHEMA = ("doc_id long, n_words long, n_dropped long, "
           "runs array<struct<start: long, length: long, period: long>>, collapsed string")


def word_ids(texts: list[list[bytes]]) -> np.ndarray:
    """Numbers of the words of all texts, one after another; texts share no number."""
    out, base = [], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        out.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)) + np.int32(base))
        base += len(seen)
    return np.concatenate(out) if out else np.empty(0, np.int32)


def gram_size(lag: int, min_length: int) -> int:
    """The largest power of two of which a stretch on this diagonal must hold a whole aligned gram."""
    return 1 << ((max(min_length - lag, lag) + 1) // 2).bit_length() - 1


def lags_of(size: int, min_length: int) -> tuple[int, int]:
    """First and last lag served by grams of this size; an empty range if there are none."""
    half = min_length // 2  # up to here the length of a stretch follows from min_length, beyond from the lag
    lags = [lag for lag in range(1, half + 1) if gram_size(lag, min_length) == size]
    if 4 * size - 2 > half:
        lags += [max(2 * size - 1, half + 1), 4 * size - 2]
    return min(lags, default=1), max(lags, default=0)


def _doubled(rank: np.ndarray, size: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of grams of twice the size, and the places whose gram occurs elsewhere, by rank and place."""
    n = len(rank)
    left = np.flatnonzero(alive[:n - size] & alive[size:]) if n > size else np.empty(0, np.int64)
    key = rank[left].astype(np.int64) << 32 | rank[left + size]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    number = np.cumsum(first) - 1
    out = np.arange(len(left), len(left) + n, dtype=np.int32)  # a gram that occurs once has its own rank
    out[left[order]] = number
    return out, left[order][(np.bincount(number) > 1)[number] if len(number) else []]


class _Found:
    """Runs as rows (start, end, period)."""

    def __init__(self) -> None:
        self.rows = np.empty((0, 3), dtype=np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, lag: np.ndarray) -> None:
        """Of one stretch found with several periods the smallest stays; the others are its multiples."""
        both = np.concatenate([self.rows, np.stack([start, end, lag], axis=1)])
        both = both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))]
        new = np.ones(len(both), dtype=bool)
        new[1:] = (both[1:, :2] != both[:-1, :2]).any(axis=1)
        self.rows = both[new]

    def label(self, size: int, n: int) -> np.ndarray:
        """Per place the end of the run of a period up to half the size that holds its gram, else -1.

        Two such runs share less than a gram, so a gram lies in one at most.
        """
        start, end, period = self.rows[(self.rows[:, 2] <= size // 2) & (self.rows[:, 1] - self.rows[:, 0] >= size)].T
        out = np.full(n, -1, dtype=np.int64)
        counts = end - size + 1 - start
        at = np.repeat(start - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        out[at] = np.repeat(end, counts)
        return out


def _stretches(places: np.ndarray, rank: np.ndarray, ends: np.ndarray, size: int, low: int, high: int
               ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first place, end, lag) of joined seeds on the diagonals low..high."""
    n = len(rank)
    index = rank[places].astype(np.int64) * n + places
    anchors = places[places % size == 0]
    base = rank[anchors].astype(np.int64) * n
    step = max(1, PAIRS // max(len(anchors), 1))
    for first in range(low, high + 1, step):
        last = min(high, first + step - 1)
        # Partners inside the anchor's own run of a small period are skipped.
        near = np.maximum(anchors + first, ends[anchors] - size + 1)
        near = np.searchsorted(index, base + np.minimum(near, n))
        far = np.searchsorted(index, base + np.minimum(anchors + last, n - 1), side="right")
        counts = np.maximum(far - near, 0)
        which = np.repeat(np.arange(len(anchors)), counts)
        partner = places[np.repeat(near - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        place = anchors[which]
        lag = partner - place
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        fresh = np.ones(len(place), dtype=bool)
        fresh[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + size)  # not where the lag is covered up to
        begins = np.flatnonzero(fresh)
        if len(begins):
            final = np.append(begins[1:], len(place)) - 1
            yield place[begins], place[final] + size, lag[begins]


def runs(ids: np.ndarray, min_length: int = MIN_LENGTH, longest: int | None = None) -> np.ndarray:
    """All runs (start, length, period) of at least ``max(min_length, 2 * period)`` words, by start and period.

    ``longest`` is the length of the longest text among those the numbers come from.
    """
    longest = len(ids) if longest is None else longest
    n = len(ids)
    found = _Found()
    levels = [np.ascontiguousarray(ids, dtype=np.int32)]
    places, size = np.argsort(levels[0], kind="stable"), 1
    places = places[np.bincount(levels[0])[levels[0][places]] > 1] if n else places
    while len(places):
        low, high = lags_of(size, min_length)
        high = min(high, longest // 2)
        ends = found.label(size, n)
        for start, end, lag in _stretches(places, levels[-1], ends, size, low, high):
            for smaller in range(len(levels) - 2, -1, -1):
                rank, step = levels[smaller], 1 << smaller
                m = len(rank)
                same = end + lag + step <= m
                same[same] = rank[end[same]] == rank[(end + lag)[same]]
                end = end + step * same
                same = start >= step
                same[same] = rank[start[same] - step] == rank[(start + lag)[same] - step]
                start = start - step * same
            long = end - start >= np.maximum(min_length - lag, lag)
            found.add(start[long], (end + lag)[long], lag[long])
        # A gram all of whose occurrences lie in one run says nothing new, nor do longer ones.
        ends = found.label(size, n)[places]
        rank = levels[-1][places]
        first = np.ones(len(places), dtype=bool)
        first[1:] = rank[1:] != rank[:-1]
        group = np.cumsum(first) - 1
        mixed = np.logical_or.reduceat((ends < 0) | (ends != ends[first][group]), np.flatnonzero(first))
        alive = np.zeros(n, dtype=bool)
        alive[places[mixed[group]]] = True
        rank, places = _doubled(levels[-1], size, alive)
        levels.append(rank)
        size *= 2
    result = found.rows[np.lexsort((found.rows[:, 2], found.rows[:, 0]))]
    return np.stack([result[:, 0], result[:, 1] - result[:, 0], result[:, 2]], axis=1)


def _answered(batches: Iterator[pa.RecordBatch], min_length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = list(rows(batch, binary=True))
        for first, last in batches_of([text for _, text in held]):
            texts = [text.split() for _, text in held[first:last]]  # bytes split at the six white spaces
            found = runs(word_ids(texts), min_length, max(map(len, texts)))
            edges = np.cumsum([0, *map(len, texts)])
            cuts = np.searchsorted(found[:, 0], edges)
            dropped = np.zeros(edges[-1] + 1, dtype=np.int64)
            np.add.at(dropped, found[:, 0] + found[:, 2], 1)
            np.add.at(dropped, found[:, 0] + found[:, 1], -1)
            kept = np.cumsum(dropped[:-1]) == 0
            left = []
            for words, begin, end in zip(texts, edges[:-1], edges[1:], strict=True):
                own = kept[begin:end]
                left.append(b" ".join(words if own.all() else compress(words, own)))
            start = found[:, 0] - np.repeat(edges[:-1], np.diff(cuts))
            spans = pa.StructArray.from_arrays([pa.array(start), pa.array(found[:, 1]), pa.array(found[:, 2])],
                                               fields=list(_RUN))
            gone = np.add.reduceat(np.append(~kept, False), edges[:-1]) if len(texts) else []
            sizes = np.diff(edges)
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in held[first:last]], pa.int64()), pa.array(sizes),
                pa.array(np.where(sizes > 0, gone, 0).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans),
                pa.array(left, pa.binary()).cast(pa.string()),
            ], list(_KINDS))


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Per document its runs, by start and period, and the text without what they repeat.

    A word leaves ``collapsed`` if some run holds it after that run's first period.
    """
    if min_length < 2:
        raise ValueError("min_length must be at least 2")
    return id_and_text(docs).mapInArrow(lambda batches: _answered(batches, min_length), _SCHEMA)


def looped(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, chosen by their id, end in a loop of some of their own words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.when(F.expr("h % 10 = 0"), F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    turned = F.expr("array_join(transform(sequence(0L, n - 1), i -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), number.alias("h"))
        .withColumn("words", words)
        .withColumns({"n": F.when(F.size("words") > 0, F.size("words").cast("long")), "g": F.expr("h div 10")})
        .withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
        .select("doc_id", F.when(F.col("n").isNotNull(), turned).otherwise(F.col("text")).alias("text"))
    )


def digests(found: DataFrame) -> DataFrame:
    """The longest run, and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(
        r[name].cast("string") for name in ("start", "length", "period")))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words", "n_dropped")
