"""License scans: short notices found with a bounded number of edits.

A text becomes its words, lower-cased in A-Z, joined by one space. A notice with up to ``k`` edits is cut
into ``k + 1`` pieces; an occurrence within the bound holds one of them unchanged and at most ``k``
characters off its place (the pigeonhole principle). One automaton finds the pieces of all notices in one
pass; the places they imply are verified in a short window by the fuzzy matching of the ``regex`` library,
which gives the span and its edits. Phrases are found word by word without edits; they are the base, to
which notices add labels.

A span starts and ends at word ends and must hold the notice's key words unchanged, where an edit would
name another license. Of spans of one notice that overlap, the one with the fewest edits stays.

Local to a text: one pass, no shuffle. A null or empty text has no words and no span: its words are null,
its labels empty, its score 0. Ids may repeat or be null; each row is answered. Every occurrence is
verified, in texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from scarpline.llm.common import id_and_text, rows

# The phrases of the base, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Public license notices as words, their label, and the words that no edit may touch.
NOTICES = [
    ("released under the mit license", "mit", "mit"),
    ("licensed under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", ""),
    ("licensed under the apache license version 2 0", "apache-2", "2"),
    ("redistribution and use in source and binary forms with or without modification", "bsd", ""),
    ("under the gnu general public license version 2", "gpl-2", "2"),
    ("under the gnu general public license version 3", "gpl-3", "3"),
    ("under the gnu lesser general public license", "lgpl", ""),
    ("under the gnu affero general public license", "agpl", ""),
    ("under the mozilla public license version 2 0", "mpl-2", "2"),
    ("licensed under cc by 4 0", "cc-by", "cc by 4"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc nc"),
    ("creative commons attribution 4 0 international license", "cc-by", ""),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa", ""),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc", ""),
    ("this is free and unencumbered software released into the public domain", "unlicense", ""),
]
CHARS_PER_EDIT = 10
_WORD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256))
_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()),
                   ("edits", pa.int64()), ("text", pa.string())])
_KINDS = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(),
    "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
    "spans": pa.list_(_SPAN)}
_SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
           "labels string, score double, "
           "spans array<struct<label: string, first_word: long, n_words: long, edits: long, text: string>>")


def normal(text: bytes) -> list[bytes]:
    """Words of a text: letters A-Z lower-cased, everything but ASCII letters, digits and non-ASCII cut."""
    return text.translate(_WORD).split()


@dataclass
class Notice:
    """A notice, the edits it bears, its pieces with their offsets, and its matcher."""

    text: str
    label: str
    keys: frozenset[str]
    edits: int
    pieces: list[tuple[int, str]] = field(init=False)

    def __post_init__(self) -> None:
        n, parts = len(self.text), self.edits + 1
        cuts = [n * i // parts for i in range(parts + 1)]
        self.pieces = [(a, self.text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.matcher = regex.compile(
            f"(?<= )(?:{regex.escape(self.text)}){{e<={self.edits}}}(?= )", regex.BESTMATCH)


@dataclass
class Span:
    """A verified occurrence, in characters of the padded text."""

    start: int
    end: int
    edits: int
    notice: Notice


class Scanner:
    """Phrases and notices made ready for texts."""

    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str, str]], chars_per_edit: int) -> None:
        self.phrases = [(f" {phrase} ", label) for phrase, label in phrases.items()]
        self.notices = [
            Notice(text, label, frozenset(keys.split()), len(text) // chars_per_edit) for text, label, keys in notices]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for offset, piece in notice.pieces:
                places.setdefault(piece, []).append((i, offset + len(piece) - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        if places:
            self.automaton.make_automaton()

    def phrase_places(self, padded: str) -> Iterator[tuple[int, str]]:
        for phrase, label in self.phrases:
            at = padded.find(phrase)
            while at >= 0:
                yield at + 1, label
                at = padded.find(phrase, at + 1)

    def spans(self, padded: str) -> list[Span]:
        """Verified occurrences of all notices, by start."""
        if not len(self.automaton):
            return []
        starts: list[list[int]] = [[] for _ in self.notices]
        for end, where in self.automaton.iter(padded):
            for i, offset in where:
                starts[i].append(end - offset)
        out: list[Span] = []
        for notice, implied in zip(self.notices, starts, strict=True):
            out += self._verified(notice, sorted(set(implied)), padded)
        return sorted(out, key=lambda s: (s.start, s.end, s.notice.label))

    @staticmethod
    def _verified(notice: Notice, implied: list[int], padded: str) -> list[Span]:
        """One window for each place and those up to 2 k behind it; overlapping spans give way to the closer."""
        slack, found, i = notice.edits, [], 0
        while i < len(implied):
            first = last = implied[i]
            while i < len(implied) and implied[i] <= first + 2 * slack:
                last, i = implied[i], i + 1
            low = max(first - slack - 1, 0)
            hit = notice.matcher.search(padded, low, last + len(notice.text) + slack + 2)
            while hit:
                if notice.keys <= set(hit.group().split(" ")):
                    span = Span(hit.start(), hit.end(), sum(hit.fuzzy_counts), notice)
                    if not found or found[-1].end <= span.start:
                        found.append(span)
                    elif span.edits < found[-1].edits:
                        found[-1] = span
                    break
                hit = notice.matcher.search(padded, hit.start() + 1, last + len(notice.text) + slack + 2)
        return found


def _word_numbers(padded: str, places: list[int]) -> dict[int, int]:
    """Number of the word that starts at each place."""
    out, before, count = {}, 0, 0
    for place in sorted(set(places)):
        count += padded.count(" ", before, place)
        before = place
        out[place] = count - 1
    return out


def _scanned(batches: Iterator[pa.RecordBatch], phrases: dict[str, str], notices: list[tuple[str, str, str]],
             chars_per_edit: int) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(phrases, notices, chars_per_edit)
    for batch in batches:
        out = []
        for doc_id, text in rows(batch, binary=True):
            words = normal(text)
            padded = f" {b' '.join(words).decode()} "
            base = list(scanner.phrase_places(padded))
            spans = scanner.spans(padded)
            number = _word_numbers(padded, [at for at, _ in base] + [s.start for s in spans])
            firsts = [number[at] for at, _ in base]
            base_labels = {label for _, label in base}
            closeness = [1 - s.edits / len(s.notice.text) for s in spans] + [1.0] * bool(base)
            out.append((
                doc_id, len(words), len(base), min(firsts, default=None), max(firsts, default=None),
                ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {s.notice.label for s in spans})),
                max(closeness, default=0.0),
                [(s.notice.label, number[s.start], padded.count(" ", s.start, s.end) + 1, s.edits,
                  padded[s.start:s.end]) for s in spans]))
        columns = list(zip(*out, strict=True)) or [()] * len(_KINDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, _KINDS.values(), strict=True)], list(_KINDS))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str, str]] = NOTICES,
         chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Per document the base phrases, all labels, the closest match and the spans of the notices.

    ``phrases`` maps lower-case words to a label; a notice is (words, label, key words). A notice may
    differ by one edit for every ``chars_per_edit`` characters. ``score`` is 1 for an exact phrase or
    notice, less by the share of edited characters otherwise, 0 without any.
    """
    if chars_per_edit < 4:
        raise ValueError("chars_per_edit must be at least 4, or pieces become too short to find")
    return id_and_text(docs).mapInArrow(
        lambda batches: _scanned(batches, phrases, notices, chars_per_edit), _SCHEMA)
