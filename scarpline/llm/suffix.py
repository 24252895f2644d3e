"""Removal of repeated byte strings by suffix buckets.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id. Suffixes need an order only up to LENGTH bytes, and only where they can be equal:

1. Initial buckets. Every LENGTH-byte string is filed under its smallest ``GRAM``-byte gram by hash
   (all of them if there are equals), about one position in eighteen. Grams that occur once in all
   documents hold no repeat and leave.
2. Buckets of the grams left are refined. A gram's context is all the bytes that strings filed under
   it can reach. Equal contexts are one, held by its smallest document; the others are repeats as a
   whole. In buckets with different contexts all suffixes of the contexts are sorted by bucket
   pointers: 8-byte buckets, then pairs of a suffix's bucket and that of its suffix 8 bytes later, then
   16, then 18 bytes later, each round using the bucket numbers of the round before, until the
   buckets agree on LENGTH bytes. The smallest document of a bucket keeps its string.

A gram at more than HOT places is no bucket for one task: a frequent phrase has another context nearly
everywhere. The strings filed under it are filed under their own hash instead, once per bucket, with the
smallest document that holds them there.

Texts are UTF-8 bytes and matches never cross documents. Null texts are empty; texts below LENGTH
bytes lose nothing. A null id is larger than every other. Rows that share an id are no repeats of each
other, as neither id is smaller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scarpline.llm.exchange import (
    Exchange, by_part, fact_rows, from_gaps, gaps, ordered, pack, unpack)
from scarpline.llm.words import SLICE, batches_of, mixed, powers, window_hashes

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM + 1  # grams of one string
TURN_BYTES = 1 << 20
HOT = TURN_BYTES // (2 * LENGTH - GRAM)  # contexts of one gram that fill a turn
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max  # stands for a null id
_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _sliding(values: np.ndarray, size: int, choose: np.ufunc) -> np.ndarray:
    """Smallest or largest of every ``size`` consecutive values, by doubling."""
    width = 1
    while 2 * width <= size:
        values = choose(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return choose(values[:len(values) - rest], values[rest:]) if rest else values


def _crossing(sizes: list[int], count: int) -> np.ndarray:
    """Of ``count`` strings, those across two documents."""
    crossing = np.ones(count, dtype=bool)
    begin = 0
    for size in sizes:
        crossing[begin:begin + max(size - LENGTH + 1, 0)] = False
        begin += size
    return crossing


def _among(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places of the values that are among the chosen ones."""
    low = np.uint64((1 << 20) - 1)
    likely = np.zeros(1 << 20, dtype=bool)
    likely[chosen & low] = True
    at = np.flatnonzero(likely[values & low])
    return at[np.isin(values[at], chosen)]


def _strings(data: np.ndarray, size: int) -> np.ndarray:
    return window_hashes(data.astype(np.uint64) + np.uint64(1), size)


def _grams(texts: list[bytes]) -> Iterator[
        tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of a bucket: its first byte, data, places of filed grams, their hashes, the bounds of
    the document that each lies in, and the hash of the gram that each string is filed under."""
    base = 0
    for first, last in batches_of(texts):
        part = texts[first:last]
        data = np.frombuffer(b"".join(part), dtype=np.uint8)
        sizes = np.array([len(t) for t in part], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if len(data) >= LENGTH:
            hashes = _strings(data, GRAM)
            least = _sliding(hashes, SPAN, np.minimum)
            # Strings across two documents choose nothing.
            least[_crossing(sizes.tolist(), len(least))] = 0
            padded = np.concatenate([np.zeros(SPAN - 1, dtype=np.uint64), least, np.zeros(SPAN - 1, dtype=np.uint64)])
            places = np.flatnonzero(_sliding(padded, SPAN, np.maximum) == hashes)
            doc = np.searchsorted(offsets, places, side="right") - 1
            yield base, data, places, hashes[places], offsets[doc], offsets[doc + 1], least
        base += len(data)


def _bounds(places: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context of a gram: from the first to behind the last byte that its strings reach."""
    return np.maximum(places + GRAM - LENGTH, begin), np.minimum(places + LENGTH, end)


def _prefix(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(1)) * powers(len(data) + 1)[0][:len(data)], out=total[1:])
    return total


def _content(total: np.ndarray, left: np.ndarray, right: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """64-bit name of a context: its bytes and where the gram lies in it."""
    raw = (total[right] - total[left]) * powers(len(total) + 1)[1][left]
    shape = (right - left).astype(np.uint64) * np.uint64(256) + (gram - left).astype(np.uint64)
    return mixed(raw + mixed(shape + np.uint64(1)))


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices starts[i] .. starts[i] + lengths[i] - 1."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _names(data: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the strings at some places, a slice of bytes at a time."""
    step = SLICE // size
    return np.concatenate([
        _strings(data[_ragged(at, np.full(len(at), size))], size)[::size]
        for at in np.split(places, range(step, len(places), step))])


def refine(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket-pointer refinement of the suffixes of many strings, up to LENGTH bytes.

    Returns the places of all suffixes with at least LENGTH bytes left in their string, and their
    final buckets: equal numbers for equal LENGTH-byte strings.
    """
    bucket = np.zeros(len(data), dtype=np.int64)
    places = _ragged(starts, np.maximum(lengths - 7, 0))
    wide = data.astype(np.uint64)
    value = np.zeros(len(places), dtype=np.uint64)
    for i in range(8):
        value = value << np.uint64(8) | wide[places + i]
    bucket[places] = np.unique(value, return_inverse=True)[1]
    depth = 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        places = _ragged(starts, np.maximum(lengths - depth - step + 1, 0))
        pair = bucket[places] * len(data) + bucket[places + step]
        refined = np.unique(pair, return_inverse=True)[1]
        bucket[places] = refined
        depth += step
    return places, bucket[places]


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _removed_strings(text: np.ndarray, docs: np.ndarray, before: np.ndarray, sizes: np.ndarray,
                     gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, first byte in its context, length) of what is removed, for all contexts of some grams."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    name = _content(_prefix(text), begins, ends, begins + before)
    _, same = np.unique(name, return_inverse=True)
    smallest = np.full(int(same.max(initial=-1)) + 1, _LAST, dtype=np.int64)
    np.minimum.at(smallest, same, docs)
    whole = np.flatnonzero(docs > smallest[same])

    # Of the smallest documents' contexts, those that meet another context of their gram.
    held = np.flatnonzero(docs == smallest[same])
    _, bucket = np.unique(gram[held], return_inverse=True)
    pairs = np.unique(np.stack([bucket, same[held]]), axis=1)[0] if len(held) else bucket
    held = held[(np.bincount(pairs, minlength=int(bucket.max(initial=-1)) + 1) > 1)[bucket]]
    if not len(held):
        return whole, np.zeros(len(whole), dtype=np.int64), sizes[whole]
    places, final = refine(text, begins[held], sizes[held])
    entry = np.repeat(held, np.maximum(sizes[held] - LENGTH + 1, 0))
    least = np.full(int(final.max(initial=-1)) + 1, _LAST, dtype=np.int64)
    np.minimum.at(least, final, docs[entry])
    marked = np.zeros(len(text), dtype=bool)
    marked[places[docs[entry] > least[final]]] = True
    # Runs of removed strings end with their context, whose last string starts LENGTH before its end.
    first, last = _runs(marked)
    owner = np.searchsorted(ends, first, side="right")
    return (np.concatenate([whole, owner]),
            np.concatenate([np.zeros(len(whole), dtype=np.int64), first - begins[owner]]),
            np.concatenate([sizes[whole], last - first + LENGTH - 1]))


def _compared(dests: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Back to every bucket: removed spans of contexts, removed strings of hot grams."""
    found = [(dest, unpack(payload)) for dest, payload in zip(dests, payloads, strict=True)]
    for compare, arrays in ((_compared_strings, 3), (_compared_contexts, 5)):
        of = [(dest, f) for dest, f in found if len(f) == arrays]
        if of:
            yield from compare([dest for dest, _ in of], [f for _, f in of])


def _compared_strings(dests: list[int], found: list[list[np.ndarray]]) -> Iterator[tuple[int, bytes]]:
    """Back to every bucket: one place of each string that a smaller document holds elsewhere."""
    _, same = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    docs = np.concatenate([f[1] for f in found])
    smallest = np.full(int(same.max()) + 1, _LAST, dtype=np.int64)
    np.minimum.at(smallest, same, docs)
    gone = docs > smallest[same]
    at = 0
    for dest, (own, _, steps) in zip(dests, found, strict=True):
        place = from_gaps(steps)[gone[at:at + len(own)]]
        at += len(own)
        if len(place):
            yield dest, pack(gaps(place))


def _compared_contexts(dests: list[int], found: list[list[np.ndarray]]) -> Iterator[tuple[int, bytes]]:
    """Back to every bucket: removed spans, as starts and lengths.

    The contexts of a part are compared in turns of about TURN_BYTES, each with all contexts of its grams.
    """
    text = np.concatenate([f[0] for f in found])
    docs = np.concatenate([f[1] for f in found])
    lefts = np.concatenate([from_gaps(f[2]) for f in found])
    before = np.concatenate([f[3] for f in found]).astype(np.int64)  # bytes ahead of the gram
    sizes = np.concatenate([f[4] for f in found]).astype(np.int64)
    source = np.repeat(np.arange(len(found)), [len(f[1]) for f in found])
    begins = np.cumsum(sizes) - sizes
    gram = np.zeros(len(docs), dtype=np.uint64)
    for i in range(GRAM):
        gram = gram * _BASE + text[begins + before + i]
    gram = mixed(gram)
    turns = np.uint64(len(text) // TURN_BYTES + 1)
    entries, starts, lengths = [], [], []
    for _, at in by_part((gram % turns).astype(np.int64)):
        entry, start, length = _removed_strings(
            text[_ragged(begins[at], sizes[at])], docs[at], before[at], sizes[at], gram[at])
        entries.append(at[entry])
        starts.append(start)
        lengths.append(length)
    entry, start, length = map(np.concatenate, (entries, starts, lengths))
    place = lefts[entry] + start
    for i, at in by_part(source[entry]):
        order = at[np.argsort(place[at], kind="stable")]
        yield dests[i], pack(gaps(place[order]), length[order].astype("<u2"))


def remove_repeats(docs: DataFrame, **sizes: int) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    exchange = Exchange(docs, **({"part_bytes": 1 << 23} | sizes))
    parts = np.uint64(exchange.parts)

    def grams(dest: int, table: pa.Table, _: list[bytes]) -> pa.Table:
        places, hashes = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)]
        for base, _, at, values, _, _, _ in _grams(ordered(table)[1]):
            places.append(base + at)
            hashes.append(values)
        place, value = np.concatenate(places), np.concatenate(hashes)
        _, first, same, counts = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
        many = counts[same] > 1
        out = []
        if many.any():
            out.append((-1 - dest, dest, pack(gaps(place[many]))))
        first = np.sort(first)
        times = np.minimum(counts[same[first]], HOT + 1)
        chosen = value[first]
        for part, at in by_part(((chosen >> np.uint64(32)) % parts).astype(np.int64)):
            # 32 bits next to the part: a gram that seems to repeat only costs time.
            out.append((part, dest, pack(chosen[at].astype("<u4"), gaps(place[first[at]]), times[at].astype("<u2"))))
        return fact_rows(out)

    def repeated(dests: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """Back to every bucket: places of repeated grams, and of hot ones."""
        found = [unpack(p) for p in payloads]
        _, same, buckets = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True, return_counts=True)
        many = buckets[same] > 1
        # Sums of integers below 2^53 are exact.
        hot = np.bincount(same, np.concatenate([f[2] for f in found]))[same] > HOT
        at = 0
        for dest, (own, steps, _) in zip(dests, found, strict=True):
            place, here = from_gaps(steps), slice(at, at + len(own))
            at += len(own)
            if many[here].any() or hot[here].any():
                yield dest, pack(gaps(place[many[here]]), gaps(place[hot[here]]))

    def contexts(dest: int, table: pa.Table, answers: list[bytes]) -> pa.Table:
        ids, texts, _ = ordered(table)
        if not answers or not texts:
            return fact_rows([])
        likely = np.zeros(sum(map(len, texts)), dtype=bool)
        hot = [np.empty(0, dtype=np.int64)]
        for answer in answers:
            found = unpack(answer)
            likely[from_gaps(found[0])] = True
            hot += map(from_gaps, found[1:])
        hot_grams = _names(np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate(hot), GRAM)
        bounds = np.cumsum([0, *map(len, texts)])
        order = np.array([_LAST if i is None else i for i in ids], dtype=np.int64)
        kept: list[list[np.ndarray]] = [[] for _ in range(6)]
        single: list[list[np.ndarray]] = [[] for _ in range(3)]
        for base, data, at, values, begin, end, least in _grams(texts):
            chosen = likely[base + at]
            if len(hot_grams):
                chosen[_among(values, hot_grams)] = False
                alone = _among(least, hot_grams)
                doc = order[np.searchsorted(bounds, base + alone, side="right") - 1]
                for column, value in zip(single, (_strings(data, LENGTH)[alone], doc, base + alone), strict=True):
                    column.append(value)
            at, values, begin, end = at[chosen], values[chosen], begin[chosen], end[chosen]
            if not len(at):
                continue
            left, right = _bounds(at, begin, end)
            doc = order[np.searchsorted(bounds, base + at, side="right") - 1]
            name = _content(_prefix(data), left, right, at)
            for column, value in zip(kept, (base + left, base + right, base + at, values, doc, name), strict=True):
                column.append(value)
        out = []
        if single[0]:
            out += string_facts(dest, *map(np.concatenate, single))
        if kept[0]:
            out += context_facts(dest, texts, *map(np.concatenate, kept))
        return fact_rows(out)

    def string_facts(dest: int, name: np.ndarray, doc: np.ndarray, place: np.ndarray) -> list[tuple[int, int, bytes]]:
        if not len(name):
            return []
        _, same = np.unique(name, return_inverse=True)
        smallest = np.full(int(same.max()) + 1, _LAST, dtype=np.int64)
        np.minimum.at(smallest, same, doc)
        out = []
        gone = place[doc > smallest[same]]
        if len(gone):
            cuts = np.flatnonzero(np.diff(gone) > 1)
            start, last = gone[np.r_[0, cuts + 1]], gone[np.r_[cuts, len(gone) - 1]]
            out.append((-1 - dest, dest, pack(gaps(start), (last - start + LENGTH).astype("<u4"))))
        held = np.flatnonzero(doc == smallest[same])
        held = held[np.sort(np.unique(same[held], return_index=True)[1])]
        for part, at in by_part(((name[held] >> np.uint64(32)) % parts).astype(np.int64)):
            at = held[at]
            out.append((part, dest, pack(name[at], doc[at], gaps(place[at]))))
        return out

    def context_facts(dest: int, texts: list[bytes], left: np.ndarray, right: np.ndarray, gram: np.ndarray,
                      value: np.ndarray, doc: np.ndarray, name: np.ndarray) -> list[tuple[int, int, bytes]]:
        # Equal contexts of larger documents are repeats already; they need not leave the bucket.
        _, same = np.unique(name, return_inverse=True)
        smallest = np.full(int(same.max()) + 1, _LAST, dtype=np.int64)
        np.minimum.at(smallest, same, doc)
        gone = np.flatnonzero(doc > smallest[same])
        out = []
        if len(gone):
            out.append((-1 - dest, dest, pack(gaps(left[gone]), (right - left)[gone].astype("<u2"))))
        sent = np.flatnonzero(doc == smallest[same])
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        for part, at in by_part(((value[sent] >> np.uint64(32)) % parts).astype(np.int64)):
            at = sent[at]
            lengths = right[at] - left[at]
            out.append((part, dest, pack(
                data[_ragged(left[at], lengths)], doc[at], gaps(left[at]),
                (gram - left)[at].astype("u1"), lengths.astype("u1"))))
        return out

    def removed(dest: int, table: pa.Table, answers: list[bytes]) -> pa.Table:
        ids, texts, times = ordered(table)
        offsets = np.cumsum([0, *map(len, texts)])
        change = np.zeros(int(offsets[-1]) + 1, dtype=np.int64)
        alone = [np.empty(0, dtype=np.int64)]
        for answer in answers:
            steps, *lengths = unpack(answer)
            start = from_gaps(steps)
            if lengths:
                np.add.at(change, start, 1)
                np.add.at(change, start + lengths[0], -1)
            else:
                alone.append(start)
        # Where a string alone is gone, all its copies in the bucket are: none is of a smaller document.
        places = np.concatenate(alone)
        if len(places):
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            names = _names(data, places, LENGTH)
            base = 0
            for first, last in batches_of(texts):
                sizes = [len(t) for t in texts[first:last]]
                hashes = _strings(data[base:base + sum(sizes)], LENGTH)
                start = _among(hashes, names)
                start = base + start[~_crossing(sizes, len(hashes))[start]]
                np.add.at(change, start, 1)
                np.add.at(change, start + LENGTH, -1)
                base += sum(sizes)
        gone = np.cumsum(change[:-1]) > 0
        counts, spans, digests = [], [], []
        for i, text in enumerate(texts):
            own = gone[offsets[i]:offsets[i + 1]]
            counts.append(int(own.sum()))
            spans.append(len(_runs(own)[0]) if counts[-1] else 0)
            if counts[-1]:
                text = np.frombuffer(text, dtype=np.uint8)[~own].tobytes()
            digests.append(hashlib.sha256(text).hexdigest())
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "n_removed": pa.array(counts, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()), "times": pa.array(times, pa.int64())})

    likely = exchange.compared(exchange.facts(grams), repeated)
    spans = exchange.compared(exchange.facts(contexts, likely), _compared)
    return exchange.results(removed, spans, _SCHEMA)
