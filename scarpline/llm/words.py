"""Words of whole texts as arrays: hashes and byte places, for many texts at once.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``, which in UTF-8 is the same as a run of
such characters. A word's hash is a polynomial of its bytes modulo 2^64, mixed afterwards; it is read
off prefix sums, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from scarpline.llm.common import SPACE

_BASE = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE)] = True
SLICE = 1 << 19  # bytes handled at once

_power = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``length`` of each."""
    global _power, _inverse
    if len(_power) < length:
        length = max(length, 2 * SLICE)
        _power = np.cumprod(np.r_[np.uint64(1), np.full(length, _BASE, dtype=np.uint64)])
        _inverse = np.cumprod(np.r_[np.uint64(1), np.full(length, pow(_BASE, -1, 1 << 64), dtype=np.uint64)])
    return _power, _inverse


def mixed(values: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on all bits of the value."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive values (uint64), mixed; empty if there are fewer."""
    count = len(values) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    power, inverse = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[:len(values)], out=total[1:])
    return mixed((total[size:] - total[:-size]) * inverse[:count])


def batches_of(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes together, a longer text alone."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < SLICE):
            size += len(texts[last]) + 1
            last += 1
        yield first, last
        first = last


def words_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, begins, ends) of the words of every text, in bytes of that text."""
    for first, last in batches_of(texts):
        part = texts[first:last]
        data = np.frombuffer(b" " + b" ".join(part) + b" ", dtype=np.uint8)
        space = _IS_SPACE[data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        begins, ends = edges[::2], edges[1::2]
        power, inverse = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data + np.uint64(1)) * power[:len(data)], out=total[1:])
        hashes = mixed((total[ends] - total[begins]) * inverse[begins])
        offsets = np.cumsum([1, *(len(t) + 1 for t in part)])
        cuts = np.searchsorted(begins, offsets)
        for i in range(len(part)):
            own = slice(cuts[i], cuts[i + 1])
            yield hashes[own], begins[own] - offsets[i], ends[own] - offsets[i]
