"""Quality rules on repetition, from a suffix array over the words of each text.

Words are ranked, and prefix doubling ranks the suffixes by their first 1, 2, 4, ... words until all
ranks differ. The ranks of all rounds give the common prefix of neighbours in suffix order. Neighbours
that share at least ``MIN_REPEAT`` words form the intervals of repeated substrings; at each of its
occurrences a suffix's longest such prefix is a maximal repeat. Their spans are united. A text is
rejected when the spans cover more than ``MAX_COVERED`` of its words, or when its longest repeat is
longer than ``MAX_LONGEST`` of them.

Everything is local to a text: one pass, no shuffle. A null text has no words; it and all texts of
fewer than 50 words fail the base rules. Ids may repeat or be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scarpline.llm.common import SPACE, id_and_text, rows
from scarpline.llm.words import window_hashes, words_of

MIN_REPEAT = 8
MAX_COVERED = 0.4
MAX_LONGEST = 0.3
SYMBOLS = b"#*$%&|<>"
_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long")
_NAMES = [field.split()[0] for field in _SCHEMA.split(", ")]
_CONTINUES = np.zeros(256, dtype=bool)
_CONTINUES[0x80:0xC0] = True  # UTF-8 bytes that do not start a character


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:n]) > 0


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a sequence, and the common prefix of each suffix with the one before it."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    levels, width = [np.append(rank, -1).astype(np.int32)], 1
    while n and rank.max() < n - 1:
        later = np.zeros(n, dtype=np.int64)
        later[:n - width] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
        levels.append(np.append(rank, -1).astype(np.int32))
        width *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, dtype=np.int64)
    left, right = order[:-1].copy(), order[1:].copy()
    for exponent in range(len(levels) - 1, -1, -1):
        ranks, step = levels[exponent], 1 << exponent
        same = ranks[np.minimum(left, n)] == ranks[np.minimum(right, n)]
        common[1:][same] += step
        left[same] += step
        right[same] += step
    return order, common


def repeats(symbols: np.ndarray, shortest: int = MIN_REPEAT) -> tuple[int, int]:
    """(words in maximal repeats of at least ``shortest`` words, length of the longest repeat)."""
    order, common = suffix_array(symbols)
    if not len(common):
        return 0, 0
    longest = np.maximum(common, np.append(common[1:], 0))  # of each suffix, with either neighbour
    inside = longest >= shortest
    return int(covered(order[inside], longest[inside], len(symbols)).sum()), int(common.max())


def _repeat_words(hashes: np.ndarray) -> np.ndarray:
    """Which words lie in a 3-word window that occurs twice or more."""
    windows = window_hashes(hashes, 3)
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    return covered(starts, np.full(len(starts), 3), len(hashes))


def _longest_run(marks: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def _measured(batches: Iterator[pa.RecordBatch], min_repeat: int, max_covered: float,
              max_longest: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        doc_ids, texts = zip(*rows(batch, binary=True), strict=True) if batch.num_rows else ((), ())
        for doc_id, text, (hashes, begins, ends) in zip(doc_ids, texts, words_of(list(texts)), strict=True):
            n = len(hashes)
            data = np.frombuffer(text, dtype=np.uint8)
            chars = len(data) - int(_CONTINUES[data].sum()) - sum(text.count(bytes([c])) for c in SPACE)
            lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
            marks = _repeat_words(hashes)
            again = int(marks.sum())
            failed = n < 50 or 100 * again > 50 * n
            # A repeat of m >= 3 words is covered by repeated 3-word windows: no run of m, no repeat.
            spans, longest = repeats(hashes, min_repeat) if _longest_run(marks) >= min_repeat else (0, 0)
            good = spans <= max_covered * n and longest <= max_longest * n
            out.append((doc_id, n, chars, sum(text.count(bytes([c])) for c in SYMBOLS),
                        len(lines) - len(set(lines)), again, failed, good and not failed, spans, longest))
        columns = list(zip(*out, strict=True)) or [()] * len(_NAMES)
        kinds = [pa.bool_() if name in ("base_failed", "kept") else pa.int64() for name in _NAMES]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


def repetition_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
                     max_longest: float = MAX_LONGEST) -> DataFrame:
    """Per document the base counts, the verdict, words in repeats and the longest repeat.

    ``longest_repeat`` is 0 where no repeat reaches ``min_repeat`` (3 or more) words.
    """
    if min_repeat < 3:
        raise ValueError("min_repeat must be at least 3")
    return id_and_text(docs).mapInArrow(
        lambda batches: _measured(batches, min_repeat, max_covered, max_longest), _SCHEMA)
