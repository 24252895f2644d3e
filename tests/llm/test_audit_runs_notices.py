"""Filter audit, periodic runs and license notices against plain statements of their results."""

import random
import re
import zlib
from itertools import permutations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.llm import filters, notices, periodic
from scarpline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


# 11: filter audit


def failing(rows):
    """Per (doc_id, text) the filters it fails, all texts seen."""
    first = {}
    for doc_id, text in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        text = text or ""
        w = brute.words(text)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > first[text]}
        out.append({f for f, bad in fails.items() if bad})
    return out


def walked(rows, labels):
    """Every order applied to every part, document by document; rows are (doc_id, text, part)."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    fails = failing([r[:2] for r in rows])
    out = []
    for part in {r[2] or "" for r in rows}:
        docs = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        found, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                total[name] += len(gone)
                found.append((
                    part, "".join(order), step, len(left), len(gone),
                    sum(name in f for _, f in docs) - len(gone), sum(f == {name} for _, f in docs),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out += [(*row, total[row[1][row[2] - 1]]) for row in found]
    return sorted(out)


def test_path_counts_join_to_all_orders():
    for n in (1, 3, 5):
        forward, backward = filters.path_counts(n)
        orders = len(list(permutations(range(n))))
        for size in range(n + 1):
            assert sum(f * b for s, (f, b) in enumerate(zip(forward, backward, strict=True))
                       if s.bit_count() == size) == orders


def test_audit_walks_every_order(spark, docs, odd):
    rows = docs.select("doc_id", "text", "lang").union(
        odd.select((F.col("doc_id") + 100).alias("doc_id"), "text", "lang"))  # some ids and texts twice
    held = [(r.doc_id, r.text, r.lang) for r in rows.collect()]
    labels = [(i, i % 2, (i // 3) % 2) for i in range(0, 200, 2)] + [
        (4, 1, 1), (4, None, None), (None, 1, 1), (6, None, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality long, toxic long").withColumn("text", F.lit("clash"))
    counts = filters.counted_masks(rows.withColumn("mask", F.lit(1)).withColumn("good", F.lit(True)), frame)
    result = filters.audit(counts)
    assert result.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                              "good_lost", "toxic_lost", "shapley"]
    expected = walked(held, labels)
    assert sorted(map(tuple, result.collect())) == expected
    assert any(r[5] for r in expected) and any(r[8] for r in expected)


def test_audit_without_ids_documents_or_labels(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert filters.audit(filters.counted_masks(none, labels)).isEmpty()
    rows = [(None, "same"), (None, "same"), (7, "same"), (7, "same"), (9, "same"), (3, None), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    counts = {r["mask"]: r["n"] for r in filters.counted_masks(frame, labels).collect()}
    assert counts == {1: 5, 17: 2}
    with pytest.raises(ValueError):
        filters.audit(filters.counted_masks(frame, labels), "ABCDEFG")


def test_a_text_of_a_third_of_all_rows_is_counted_before_it_is_shuffled(spark):
    frame = spark.range(30_000, numPartitions=8).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    labels = spark.range(0, 30_000, 7).select(
        F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"), F.lit(0).alias("toxic"))
    counts = {r["mask"]: (r["n"], r["good"]) for r in filters.counted_masks(frame, labels).collect()}
    goods = [i for i in range(0, 30_000, 7) if i % 2]
    assert counts == {1: (20_001, sum(i % 3 != 0 for i in goods)), 17: (9_999, sum(i % 3 == 0 for i in goods))}


# 12: periodic runs


def all_runs(w, shortest):
    """Every diagonal, place by place; of equal stretches the smallest period."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(shortest, 2 * q) and j > i:
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in best.items())


def sequences():
    generator = random.Random(12)
    for _ in range(600):
        size, kinds = generator.choice([14, 40, 120, 260]), generator.randint(1, 4)
        roll = generator.random()
        if roll < 0.4:
            yield [generator.randrange(kinds) for _ in range(generator.randint(0, size))]
        elif roll < 0.7:
            out = []
            while len(out) < size:
                root = [generator.randrange(3) for _ in range(generator.randint(1, 9))]
                out += (root * 9)[:generator.randint(1, 60)]
            yield out
        elif roll < 0.8:
            a, b = [0], [0, 1]
            while len(b) < size:
                a, b = b, b + a
            yield b[:size]
        elif roll < 0.9:
            yield [i.bit_count() & 1 for i in range(size)]
        else:
            yield sum(([0, 1] * generator.randint(0, 20) + [0] * generator.randint(0, 4) for _ in range(4)), [])


@pytest.mark.parametrize("shortest", [2, 3, 12, 30])
def test_runs_of_all_kinds_of_sequences(shortest):
    for w in sequences():
        assert [tuple(r) for r in periodic.runs(np.array(w, dtype=np.int32), shortest).tolist()] == all_runs(w, shortest)


def test_one_word_a_million_times_makes_few_pairs(monkeypatch):
    made = []
    plain = periodic._stretches

    def counted(places, *rest):
        for found in plain(places, *rest):
            made.append(len(found[0]))
            yield found

    monkeypatch.setattr(periodic, "_stretches", counted)
    assert periodic.runs(np.zeros(1_000_000, dtype=np.int32)).tolist() == [[0, 1_000_000, 1]]
    assert sum(made) < 100


def turned(doc_id, text):
    """The words that the query looks at: a tenth of the documents ends in a loop."""
    w = brute.words(text)
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def digested(doc_id, w, shortest=12):
    found = all_runs(w, shortest)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    length, start, period = max(((m, -s, -q) for s, m, q in found), default=(None, 0, 0))
    head = (None,) * 4 if length is None else (-start, length, -period, 1000 * length // -period)
    return (doc_id, len(found), *head, brute.sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted(
        found, key=lambda r: (r[0], r[2])))), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_query_on_short_texts_and_odd_rows(docs, odd):
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).where("length(text) < 6000 or text is null")
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    result = periodic.digests(periodic.periodic_runs(periodic.looped(rows.withColumn("words", F.lit(1)))))
    found = sorted((tuple(r) for r in result.select(*names).collect()), key=key)
    expected = sorted((digested(r.doc_id, turned(r.doc_id, r.text)) for r in rows.collect()), key=key)
    assert found == expected
    assert sum(r[1] for r in found) > 10


def test_runs_and_collapsed_text_are_returned(spark, odd, none):
    rows = [(1, "start " + "one two three four " * 4 + "end"), (2, None), (3, " \n"), (None, "a b " * 13)]
    found = {r["doc_id"]: r for r in periodic.periodic_runs(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["runs"] == [(1, 16, 4)] and found[1]["collapsed"] == "start one two three four end"
    assert (found[1]["n_words"], found[1]["n_dropped"]) == (18, 12)
    assert found[2]["runs"] == [] == found[3]["runs"] and found[2]["collapsed"] == ""
    assert found[None]["runs"] == [(0, 13, 1)] and found[None]["collapsed"] == "a b"
    assert periodic.periodic_runs(odd).count() == odd.count()
    assert periodic.digests(periodic.periodic_runs(periodic.looped(none))).isEmpty()
    with pytest.raises(ValueError):
        periodic.periodic_runs(odd, 1)


# 13: notices


def notice_words(text):
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def base_of(doc_id, text):
    w = notice_words(text)
    places = [(i, label) for phrase, label in notices.PHRASES.items() for i in range(len(w))
              if w[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return (doc_id, len(w), len(places), min(at, default=None), max(at, default=None),
            ",".join(sorted({label for _, label in places})))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(text, w):
    """Fewest edits between the notice and any stretch of whole words."""
    best, size = len(text), len(text.split())
    for i in range(len(w)):
        for j in range(max(i + 1, i + size - 4), min(len(w), i + size + 4) + 1):
            part = " ".join(w[i:j])
            if abs(len(part) - len(text)) < best:
                best = min(best, edit_distance(text, part))
    return best


def test_base_phrases_of_whole_texts(spark, docs, odd):
    rows = [(1, "Under the MIT License; under the mit\nLICENSE (CC-BY-NC)"), (2, "apache license version 2.0"),
            (3, "xunder the mit license"), (4, "under the mit licenses"), (5, "cc by nc cc by nc"), (6, "é cc_by_nc")]
    frame = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(
        spark.createDataFrame(rows, "doc_id long, text string"))
    result = notices.scan(frame.withColumn("spans", F.lit("clash"))).cache()
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    found = sorted((tuple(r) for r in result.select(*names).collect()), key=key)
    assert found == sorted((base_of(r.doc_id, r.text) for r in frame.collect()), key=key)
    assert sum(r[2] for r in found) > 5
    for r in result.collect():
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and (r.score > 0) == bool(r.labels)


def test_edited_notices_are_found_where_the_distance_says_so(spark):
    generator = random.Random(13)
    letters = "abcdefghij klmnop"
    plain = [(text, label, "") for text, label, _ in notices.NOTICES]
    rows, expected = [], {}
    for doc_id in range(160):
        text, _, _ = plain[doc_id % len(plain)]
        chars = list(text)
        for _ in range(generator.randint(0, len(text) // 10 + 2)):
            i, roll = generator.randrange(len(chars)), generator.randrange(3)
            chars[i:i + 1] = [[], [generator.choice(letters)], [chars[i], generator.choice(letters)]][roll]
        body = f"some words before {''.join(chars)} and after"
        rows.append((doc_id, body))
        w = notice_words(body)
        expected[doc_id] = {label for notice, label, _ in plain if nearest(notice, w) <= len(notice) // 10}
    found = notices.scan(spark.createDataFrame(rows, "doc_id long, text string"), {}, plain).collect()
    assert {r.doc_id: set(r.labels.split(",")) - {""} for r in found} == expected
    assert 30 < sum(map(bool, expected.values())) < 160
    for r in found:
        w = notice_words(rows[r.doc_id][1])
        for s in r.spans:
            assert s.text == " ".join(w[s.first_word:s.first_word + s.n_words])
            assert s.edits >= min(edit_distance(n, s.text) for n, label, _ in plain if label == s.label)


def test_spans_keys_and_odd_rows(spark, odd, none):
    rows = [
        (1, "Released under the MIT Licence!"), (2, "This work is licenced under the GNU General Public License, v. 3"),
        (3, "licensed under the GNU Generel Public Licence, version 3"), (4, "licensed under CC BY SA 4.0 here"),
        (5, "Released  under\nthe MIT License. " * 3), (6, "the license of the mit building was released"),
        (7, None), (8, "a b c " * 30_000 + "Released under the MIT Licence.")]
    found = {r.doc_id: r for r in notices.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.labels for i, r in found.items()} == {
        1: "mit", 2: "", 3: "gpl-3", 4: "cc-by-sa", 5: "mit", 6: "", 7: "", 8: "mit"}
    assert found[1].base_labels == "" and found[1].spans[0][1:4] == (0, 5, 1) and 0.9 < found[1].score < 1
    assert [s.first_word for s in found[5].spans] == [0, 5, 10] and found[5].score == 1.0
    assert found[8].spans[0].first_word == 90_000
    assert notices.scan(odd).count() == odd.count() and notices.scan(none).isEmpty()
    assert [r.labels for r in notices.scan(spark.createDataFrame(rows, "doc_id long, text string"), {}, []).collect()
            if r.labels] == []


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_periodic_runs", "op13_license_scan"])
def test_queries_answer_their_whole_table(spark, docs, name):
    result = QUERIES[name](spark, SF)
    languages = docs.select("lang").distinct().count()
    assert result.count() == (600 * languages if name.startswith("op11") else docs.count())
