"""Removal of repeated word sequences by difference-cover anchors.

``COVER`` is a difference cover modulo ``PERIOD``: for any two positions some shift below PERIOD moves
both onto cover positions. So whenever two windows of ``WINDOW`` words are equal, both hold an equal
anchor, the ``ANCHOR`` words at a cover position, less than PERIOD words into the window. One word
position in four is hashed to find all windows that may repeat:

1. Anchors are hashed and compared over all documents; single ones are dropped.
2. Around the anchors left, every window that holds one is extended to its full length and its
   64-bit hash is compared over all documents. A window that repeats removes all its words.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Windows lie in one document and are judged on the input.
Null texts have no words. Rows that repeat an id or a text are documents of their own, so a row given
twice loses all of its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scarpline.llm.common import one_space
from scarpline.llm.exchange import (
    Exchange, by_part, fact_rows, first_and_others, from_gaps, gaps, ordered, pack, unpack)
from scarpline.llm.words import window_hashes, words_of

WINDOW = 35
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a bucket, and where each document's words start (one more entry at the end)."""
    found = [hashes for hashes, _, _ in words_of(texts)]
    return (np.concatenate(found) if found else np.empty(0, dtype=np.uint64),
            np.cumsum([0, *map(len, found)]))


def _at(hashes: np.ndarray, offsets: np.ndarray, size: int, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the windows of ``size`` words that lie in one document."""
    whole = window_hashes(hashes, size)
    inside = np.zeros(len(hashes) + 1, dtype=np.int64)
    ends = np.maximum(offsets[1:] - size + 1, offsets[:-1])
    np.add.at(inside, offsets[:-1], 1)
    np.add.at(inside, ends, -1)
    ok = np.cumsum(inside)[:len(whole)] > 0
    if chosen is not None:
        ok &= chosen[:len(whole)]
    places = np.flatnonzero(ok)
    return places, whole[places]


def _sent(dest: int, places: np.ndarray, hashes: np.ndarray, again: np.ndarray, parts: int,
          width: str) -> list[tuple[int, int, bytes]]:
    """Facts of a bucket: one for each distinct hash, and the places of those that repeat here, or that
    lie in words of a row given ``again``."""
    first, many = first_and_others(hashes)
    many |= again[places]
    out = []
    if many.any():
        out.append((-1 - dest, dest, pack(gaps(places[many]))))
    chosen = hashes[first]
    for part, at in by_part(((chosen >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)):
        out.append((part, dest, pack(chosen[at].astype(width), gaps(places[first[at]]))))
    return out


def _repeated(dests: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Back to every bucket: the places of hashes that another bucket has too."""
    found = [unpack(p) for p in payloads]
    hashes = np.concatenate([f[0] for f in found])
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    many = np.zeros(len(hashes), dtype=bool)
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    at = 0
    for dest, (own, steps) in zip(dests, found, strict=True):
        places = from_gaps(steps)[many[at:at + len(own)]]
        at += len(own)
        if len(places):
            yield dest, pack(gaps(places))


def _places(answers: list[bytes], size: int) -> np.ndarray:
    marked = np.zeros(size, dtype=bool)
    for answer in answers:
        marked[from_gaps(unpack(answer)[0])] = True
    return marked


def _spread(marked: np.ndarray, before: int, after: int) -> np.ndarray:
    """Places from ``before`` ahead of a marked one to ``after`` behind it."""
    at = np.flatnonzero(marked)
    change = np.zeros(len(marked) + 1, dtype=np.int64)
    np.add.at(change, np.maximum(at - before, 0), 1)
    np.add.at(change, np.minimum(at + after + 1, len(marked)), -1)
    return np.cumsum(change)[:len(marked)] > 0


def remove_repeats(docs: DataFrame, **sizes: int) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    exchange = Exchange(docs, **sizes)
    parts = exchange.parts
    cover = np.isin(np.arange(PERIOD), COVER)

    def repeated_rows(times: list[int], offsets: np.ndarray) -> np.ndarray:
        return np.repeat(np.array(times, dtype=np.int64) > 1, np.diff(offsets))

    def anchors(dest: int, table: pa.Table, _: list[bytes]) -> pa.Table:
        _, texts, times = ordered(table)
        hashes, offsets = _words(texts)
        index = np.arange(len(hashes)) - np.repeat(offsets[:-1], np.diff(offsets))
        found = _at(hashes, offsets, ANCHOR, cover[index % PERIOD])
        # 32 bits next to the part are enough: an anchor that seems to repeat only costs time.
        return fact_rows(_sent(dest, *found, repeated_rows(times, offsets), parts, "<u4"))

    def windows(dest: int, table: pa.Table, answers: list[bytes]) -> pa.Table:
        if not table.num_rows or not answers:
            return fact_rows([])
        _, texts, times = ordered(table)
        hashes, offsets = _words(texts)
        likely = _spread(_places(answers, len(hashes)), PERIOD - 1, 0)
        found = _at(hashes, offsets, WINDOW, likely)
        return fact_rows(_sent(dest, *found, repeated_rows(times, offsets), parts, "<u8"))

    def removed(dest: int, table: pa.Table, answers: list[bytes]) -> pa.Table:
        ids, texts, times = ordered(table)
        normal = [one_space(t).strip() for t in texts]
        sizes_ = [t.count(b" ") + 1 if t else 0 for t in normal]
        offsets = np.cumsum([0, *sizes_])
        gone = _spread(_places(answers, int(offsets[-1])), 0, WINDOW - 1)
        counts, digests = [], []
        for i, text in enumerate(normal):
            own = gone[offsets[i]:offsets[i + 1]]
            counts.append(int(own.sum()))
            if counts[-1]:
                text = b" ".join(compress(text.split(b" "), (~own).tolist()))
            digests.append(hashlib.sha256(text).hexdigest())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(sizes_, pa.int64()),
                         "n_removed": pa.array(counts, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
                         "times": pa.array(times, pa.int64())})

    likely = exchange.compared(exchange.facts(anchors), _repeated)
    repeated = exchange.compared(exchange.facts(windows, likely), _repeated)
    return exchange.results(removed, repeated, _SCHEMA)
