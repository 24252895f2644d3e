"""Rows of doubles as short exact bytes, for shuffles that carry the same rows many times.

A column whose values have up to four decimals is kept as integers above its least value, one of few
values as places in their list, any other as its 64 bits. The columns of a row are joined to words; the
rows of a block come in the order of their first word, of which only the steps are written. Decoded
values equal the given ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SCALES = (1.0, 10.0, 100.0, 1000.0, 10000.0)
# A column of at most so many values is kept as places in their list.
LISTED = 2048
SCALED, LIST, BITS = range(3)


@dataclass(frozen=True)
class Column:
    """How one column is written: at which bits of which word, and what the integers there mean."""

    kind: int
    scale: float
    low: float
    values: np.ndarray
    bits: int

    @staticmethod
    def of(column: np.ndarray) -> Column:
        none = np.empty(0)
        for scale in SCALES if len(column) and np.isfinite(column).all() else ():
            for part in (column[:100], column):
                whole = np.rint(part * scale)
                if not ((np.abs(whole) < 1 << 52).all() and (whole / scale == part).all()):
                    break
            else:
                return Column(SCALED, scale, float(whole.min()), none, int(whole.max() - whole.min()).bit_length())
        values = np.unique(column)
        if 0 < len(values) <= LISTED:
            return Column(LIST, 1.0, 0.0, values, (len(values) - 1).bit_length())
        return Column(BITS, 1.0, 0.0, none, 64)

    def coded(self, column: np.ndarray) -> np.ndarray:
        if self.kind == SCALED:
            return (np.rint(column * self.scale) - self.low).astype(np.uint64)
        if self.kind == LIST:
            return np.searchsorted(self.values, column).astype(np.uint64)
        return np.ascontiguousarray(column).view(np.uint64)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        if self.kind == SCALED:
            return (codes.astype(np.float64) + self.low) / self.scale
        return self.values.take(codes.astype(np.intp)) if self.kind == LIST else codes.view(np.float64)


@dataclass(frozen=True)
class Layout:
    """The columns of a block and where each lies: (word, first bit)."""

    columns: list[Column]
    places: list[tuple[int, int]]

    @staticmethod
    def placed(columns: list[Column]) -> Layout:
        places, word, bit = [(0, 0)] * len(columns), 0, 0
        for at in sorted(range(len(columns)), key=lambda k: columns[k].bits):  # short ones share the first words
            if bit + columns[at].bits > 64:
                word, bit = word + 1, 0
            places[at] = word, bit
            bit += columns[at].bits
        return Layout(columns, places)

    @staticmethod
    def of(x: np.ndarray) -> Layout:
        return Layout.placed([Column.of(column) for column in x.T])

    def words(self, x: np.ndarray) -> np.ndarray:
        """(word, row) of the columns of ``x``."""
        out = np.zeros((1 + max(word for word, _ in self.places), len(x)), dtype=np.uint64)
        for column, (word, bit), values in zip(self.columns, self.places, x.T, strict=True):
            out[word] |= column.coded(values) << np.uint64(bit)
        return out

    def head(self) -> bytes:
        """The layout itself, as doubles."""
        parts = [np.array([len(self.columns)], dtype=float)]
        for c in self.columns:
            parts += [np.array([c.kind, c.scale, c.low, c.bits, len(c.values)], dtype=float), c.values]
        return np.concatenate(parts).tobytes()


def packed(head: bytes, words: np.ndarray) -> bytes:
    """A block of rows, given in the order of their first word."""
    parts = []
    for k, word in enumerate(words):
        steps = np.diff(word, prepend=np.uint64(0)) if k == 0 else np.ascontiguousarray(word)
        first = steps[:1].copy() if len(steps) else np.zeros(1, dtype=np.uint64)
        if k == 0:
            steps[:1] = 0
        size = (int(steps.max(initial=0)).bit_length() + 7) // 8
        parts += [first.tobytes(), bytes([size]),
                  np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()]
    return np.array([words.shape[1], len(head)], dtype=np.int64).tobytes() + head + b"".join(parts)


def unpacked(data: bytes | memoryview) -> np.ndarray:
    """The rows of a block, in its order."""
    rows, size = np.frombuffer(data, np.int64, 2).tolist()
    head = np.frombuffer(data, np.float64, size // 8, 16)
    columns, at = [], 1
    for _ in range(int(head[0])):
        kind, scale, low, bits, n = head[at:at + 5]
        columns.append(Column(int(kind), float(scale), float(low), head[at + 5:at + 5 + int(n)], int(bits)))
        at += 5 + int(n)
    layout, at, words = Layout.placed(columns), 16 + size, []
    for k in range(1 + max(word for word, _ in layout.places)):
        steps = np.zeros((rows, 8), dtype=np.uint8)
        width = data[at + 8]
        steps[:, :width] = np.frombuffer(data, np.uint8, rows * width, at + 9).reshape(width, rows).T
        word = steps.view(np.uint64).ravel()
        if k == 0:
            word[:1] = np.frombuffer(bytes(data[at:at + 8]), np.uint64)[:rows]
            word = np.cumsum(word, dtype=np.uint64)
        words.append(word)
        at += 9 + rows * width
    out = np.empty((rows, len(columns)))
    for f, (column, (word, bit)) in enumerate(zip(columns, layout.places, strict=True)):
        codes = words[word] >> np.uint64(bit)
        if column.bits < 64:
            codes &= np.uint64((1 << column.bits) - 1)
        out[:, f] = column.decoded(codes)
    return out
