"""Plain statements of the results, on lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = "[^\x20\x09-\x0d]+"
LAST = float("inf")


def words(text):
    return re.findall(WORD, text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def removed_words(rows, size=35):
    held = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i:i + size]) for w in held for i in range(len(w) - size + 1))
    out = []
    for (doc_id, _), w in zip(rows, held, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        out.append((doc_id, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def removed_bytes(rows, size=50):
    rank = lambda i: LAST if i is None else i
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - size + 1):
            key = data[i:i + size]
            first[key] = min(first.get(key, LAST), rank(doc_id))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            if first[data[i:i + size]] < rank(doc_id):
                gone[i:i + size] = b"\1" * size
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), sum(gone), spans, sha(kept)))
    return out


def base_rules(doc_id, text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    again = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    n = len(again)
    return (doc_id, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), n,
            len(w) < 50 or 100 * n > 50 * len(w))


def repeats(w, shortest):
    """(covered words, longest repeat of at least ``shortest``) by comparing all pairs of places."""
    gone, longest = set(), 0
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            n = 0
            while j + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            if n >= shortest:
                gone |= {*range(i, i + n), *range(j, j + n)}
                longest = max(longest, n)
    return len(gone), longest


def shingles(text):
    w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    """{doc_id: (n_shingles, component)} of rows with ids."""
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                top[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}
