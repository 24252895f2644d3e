"""Token ids of whole texts from a tokenizers file, with the model's answers remembered per piece.

The library pre-tokenizes a text with the pattern in its file and runs the BPE model on every piece
by itself, so a piece's ids do not depend on its neighbours. Pieces repeat; each worker asks the
library's model once per piece and looks the ids up afterwards. Cutting, hashing and lookup run on
whole slices of texts as arrays. Texts with characters outside the Latin blocks, control characters
or special-token strings are encoded by the library as a whole, and so are all texts under a file
with another pattern.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

# The pre-tokenization patterns of the two public files.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-įı-ɏ‐-‧‰-⁞€]*")
_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)
SLICE = 1 << 19  # characters handled at once
MAX_PIECES = 800_000  # remembered pieces of a worker; then it starts anew
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """Kind of every code point that _PLAIN admits; 0 is the mark behind each text."""
    kinds = np.full(0x2100, _OTHER, dtype=np.uint8)
    for code in range(1, 0x2100):
        kind = unicodedata.category(chr(code))[0]
        kinds[code] = {"L": _LETTER, "N": _NUMBER, "Z": _SPACE}.get(kind, _OTHER)
    kinds[[9, 10, 13]] = _SPACE
    kinds[0] = _END
    return kinds


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Pieces:
    """Hash table from a piece's 64-bit hash to its ids."""

    def __init__(self, model, end_ids: list[int]) -> None:
        self.model, self.letters = model, _byte_letters()
        self.bits = 21
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.slots = np.zeros(1 << self.bits, dtype=np.int32)
        self.flat, self.used, self.count = np.empty(1 << 20, dtype=np.int32), 0, 0
        self.start, self.length = np.empty(MAX_PIECES * 2, dtype=np.int64), np.empty(MAX_PIECES * 2, dtype=np.int64)
        self.end_ids = end_ids

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key, -1 where it is not known."""
        mask = (1 << self.bits) - 1
        at = self._home(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.slots[at], -1)
        rest = np.flatnonzero((held != keys) & (held != 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & mask
            held = self.keys[at[rest]]
            same = held == keys[rest]
            found[rest[same]] = self.slots[at[rest[same]]]
            rest = rest[~same & (held != 0)]
        return found

    def learn(self, keys: list[int], pieces: list[str]) -> None:
        mask = (1 << self.bits) - 1
        tokenize, letters = self.model.tokenize, self.letters
        homes = self._home(np.array(keys, dtype=np.uint64)).tolist()
        for key, piece, at in zip(keys, pieces, homes, strict=True):
            if piece == "\0":
                ids = self.end_ids
            else:
                ids = [t.id for t in tokenize(piece.encode().decode("latin-1").translate(letters))]
            end = self.used + len(ids)
            if end > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), end), dtype=np.int32)])
            while self.keys[at]:
                at = (at + 1) & mask
            self.flat[self.used:end] = ids
            self.start[self.count], self.length[self.count] = self.used, len(ids)
            self.keys[at], self.slots[at] = key, self.count
            self.used, self.count = end, self.count + 1


class Encoder:
    """Ids of texts, equal to the library's ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, end_id: int | None = None) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.end_ids = [] if end_id is None else [end_id]
        before = spec["pre_tokenizer"] or {}
        parts = before.get("pretokenizers", [{}])
        self.folds = parts[0].get("pattern", {}).get("Regex") == WORD_PATTERN
        self.known = self.folds or (before == BYTE_LEVEL and spec["normalizer"] is None)
        self.kinds = _classes()
        self.power = np.empty(0, dtype=np.uint64)
        self.inverse = np.empty(0, dtype=np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.pieces = _Pieces(self.tokenizer.model, self.end_ids)

    def whole(self, text: str) -> np.ndarray:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if text else []
        return np.array([*ids, *self.end_ids], dtype=np.int32)

    def batch(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(index, ids with the end id) of every text, in order."""
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) < SLICE):
                size += len(texts[last]) + 1
                last += 1
            part = texts[first:last]
            plain = [self.known and _PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special)
                     for t in part]
            kept = [t for t, ok in zip(part, plain, strict=True) if ok]
            found = iter(self._plain(kept)) if kept else iter(())
            for i, (text, ok) in enumerate(zip(part, plain, strict=True)):
                yield first + i, next(found) if ok else self.whole(text)
            first = last

    def _starts(self, code: np.ndarray) -> np.ndarray:
        """Where pieces start."""
        kind = self.kinds[code]
        start = np.empty(len(code), dtype=bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == _END
        text = (kind != _SPACE) & (kind != _END)
        quote = code == 39
        if self.folds:
            start |= kind == _NUMBER
        else:
            # The last white space before a text run is cut off, and joins the run if it is a space.
            joint = np.flatnonzero(text[1:] & (kind[:-1] == _SPACE))
            start[joint] = True
            start[joint[code[joint] == 32] + 1] = False
        if quote.any():
            # Contractions: a quote that starts a piece, with one or two letters.
            at = np.flatnonzero(quote & start)
            at = at[at + 2 < len(code)]  # the mark behind the text leaves one place
            one, two = code[at + 1], code[at + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            size = np.where(short, 1, np.where(long, 2, 0))
            at, size = at[size > 0], size[size > 0]
            start[at + 1] = False
            start[at + 1 + size] = True
        return start

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        if self.folds:
            texts = [unicodedata.normalize("NFC", t).lower() for t in texts]
        joined = "\0".join(texts) + "\0"
        code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        if len(self.power) < len(code) + 1:
            base = int(_BASE) | 1
            length = max(len(code) + 1, SLICE + 2)
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(length, base, dtype=np.uint64)])
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(length, pow(base, -1, 1 << 64), dtype=np.uint64)])
        begins = np.flatnonzero(self._starts(code))
        total = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum((code + np.uint64(1)) * self.power[:len(code)], out=total[1:])
        ends = np.r_[begins[1:], len(code)]
        if self.folds:  # white space is dropped
            text = self.kinds[code[begins]] != _SPACE
            begins, ends = begins[text], ends[text]
        keys = (total[ends] - total[begins]) * self.inverse[begins]
        keys ^= keys >> np.uint64(29)
        keys += keys == 0
        slots = self.pieces.find(keys)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            if self.pieces.count > MAX_PIECES:
                self._forget()
                missing = np.arange(len(keys))
            new, at = np.unique(keys[missing], return_index=True)
            at = missing[at]
            for i in range(0, len(new), MAX_PIECES):
                self.pieces.learn(new[i:i + MAX_PIECES].tolist(), [
                    joined[b:e] for b, e in zip(begins[at[i:i + MAX_PIECES]].tolist(), ends[at[i:i + MAX_PIECES]].tolist(), strict=True)])
            slots[missing] = self.pieces.find(keys[missing])
        p = self.pieces
        lengths = p.length[slots]
        last = np.cumsum(lengths)
        ids = p.flat[np.repeat(p.start[slots] - last + lengths, lengths) + np.arange(last[-1])]
        return np.split(ids, last[np.flatnonzero(code[begins] == 0)][:-1])


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None = None) -> Encoder:
    """One per worker process, file and end id."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def vocabulary_size(path: str) -> int:
    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
