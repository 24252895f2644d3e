"""Packing token sequences into fixed windows by the sum-of-squares rule.

A task packs its documents online. ``level[h]`` counts its open windows that hold h tokens. A
document of s tokens goes to the fill level h (0: a new window) for which the sum of the squared
counts grows least; full windows leave. A document longer than a window is cut into whole windows
first, and its rest is placed.

Every token stays in the window that the rule chose. A window still open at the end is cut, as it stands,
into sequences whose lengths are powers of two, which need no padding; so are the fuller two thirds of the open
windows once there are more than ``MAX_OPEN`` to hold. So no sequence is padded at all; documents are cut
only when longer than a window or at a power of two.

Every id lies in exactly one piece. Null and empty texts still have their end id. Ids may repeat or be
null; each row is a document. Sequence ids are unique, not consecutive: task number and counter.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from scarpline.llm.common import id_and_text, rows
from scarpline.llm.tokens import encoder

WINDOW = 4096
MAX_OPEN = 4096  # open windows of a task: 64 MB of ids
_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
           "offset long")
_NAMES = [field.split()[0] for field in _SCHEMA.split(",")]

Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, tokens of the document


class Packer:
    """Online packing of one task's documents; finished pieces gather in ``done``."""

    def __init__(self, window: int = WINDOW, first: int = 0, max_open: int = MAX_OPEN) -> None:
        self.window, self.next, self.max_open = window, first, max_open
        # Twice the number of open windows at a level. Filling a window up removes it, which changes
        # the sum by 1 - 2N(h); with -1 at the full level the formula below covers that case too.
        self.level = np.zeros(window + 1, dtype=np.int64)
        self.level[window] = -1
        self.stacks: dict[int, list[list[Piece]]] = defaultdict(list)
        self.open = 0
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while total - start >= self.window:
            self._close([(doc_id, start, ids[start:start + self.window], total)])
            start += self.window
        if start < total:
            self._place((doc_id, start, ids[start:], total))

    def _place(self, piece: Piece) -> None:
        size = len(piece[2])
        here = self.level[1:self.window - size + 1]
        there = self.level[1 + size:]
        growth = np.where(here > 0, there - here + 2, np.iinfo(np.int64).max)
        best, cost = 0, self.level[size] + 1
        if len(growth):
            # Of equal levels the fullest.
            at = len(growth) - 1 - int(np.argmin(growth[::-1]))
            if growth[at] <= cost:
                best = at + 1
        if best:
            pieces = self.stacks[best].pop()
            self.level[best] -= 2
            self.open -= 1
        else:
            pieces = []
        pieces.append(piece)
        filled = best + size
        if filled == self.window:
            self._close(pieces)
            return
        self.stacks[filled].append(pieces)
        self.level[filled] += 2
        self.open += 1
        if self.open > self.max_open:
            self._close_fullest(2 * self.max_open // 3, but=pieces)

    def _close_fullest(self, count: int, but: list[Piece] | None = None) -> None:
        """Closes that many open windows as they stand, the fullest first."""
        for filled in sorted((h for h, stack in self.stacks.items() if stack), reverse=True):
            stack = self.stacks[filled]
            while count and stack and not (len(stack) == 1 and stack[0] is but):
                pieces = stack.pop(0)
                if pieces is but:  # the newest window stays
                    stack.append(pieces)
                    continue
                self.level[filled] -= 2
                self.open -= 1
                count -= 1
                self._close_in_powers(pieces)

    def _close_in_powers(self, pieces: list[Piece]) -> None:
        """One open window as sequences of power-of-two lengths, the longest first."""
        left = sum(len(p[2]) for p in pieces)
        rest = list(pieces)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            current = []
            while room:
                doc_id, start, ids, total = rest[0]
                part = ids[:room]
                current.append((doc_id, start, part, total))
                room -= len(part)
                if len(part) < len(ids):
                    rest[0] = (doc_id, start + len(part), ids[len(part):], total)
                else:
                    rest.pop(0)
            self._close(current)

    def finish(self) -> None:
        """Closes all open windows."""
        self._close_fullest(self.open)

    def _close(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            check = zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
            self.done.append((doc_id, start, len(ids), check, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.done, strict=True)) or [[]] * len(_NAMES)
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], _NAMES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers file, the same on all machines. There is no shuffle:
    every input split is packed by its own task.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        for batch in batches:
            doc_ids, texts = zip(*rows(batch), strict=True) if batch.num_rows else ((), ())
            for i, ids in encode.batch(list(texts)):
                packer.add(doc_ids[i], ids.copy())
            yield packer.take()
        packer.finish()
        yield packer.take()

    return id_and_text(docs).mapInArrow(pack, _SCHEMA)
