"""Every operator against a plain statement of its result, and on odd rows and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scarpline.llm import chat, exact, exchange, huffman, mixing, packing, quality, repetition, setsketch, substring, suffix
from scarpline.llm.common import shared_folder
from scarpline.llm.components import components
from scarpline.llm.queries import ORACLE, QUERIES
from scarpline.llm.tokens import Encoder
from scarpline.llm.words import words_of

SF = "/root/testdata/sf0.001"


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def got(frame, *names):
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=key)


def texts(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def both(docs, odd):
    """The smallest table and the odd rows, whose ids are moved out of its way."""
    return docs.select("doc_id", "text", "source").union(
        odd.select(F.col("doc_id") + 1000, "text", "source")).cache()


def test_one_query_each():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 14))


# 2, 5: substrings


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 20_000, "part_bytes": 50_000}])
def test_repeated_words(both, sizes):
    found = got(substring.remove_repeats(both, **sizes), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == sorted(brute.removed_words(texts(both)), key=key)


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 20_000, "part_bytes": 50_000}])
def test_repeated_bytes(both, sizes):
    found = got(suffix.remove_repeats(both, **sizes), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == sorted(brute.removed_bytes(texts(both)), key=key)


@pytest.mark.parametrize("remove, plain", [
    (substring.remove_repeats, brute.removed_words), (suffix.remove_repeats, brute.removed_bytes)])
def test_rows_given_very_often_are_dealt_once(spark, docs, remove, plain):
    passage = " ".join(f"given{i}" for i in range(80))
    once = texts(docs)[:40] + [(500, "before " + passage + " after"), (7000, passage + " tail")]
    often = [(None, passage), (600, passage + " twice"), (None, None), (5, ""), (6, "few words here")]
    frame = spark.createDataFrame(once + often * 2000, "doc_id long, text string")
    dealt = exchange.Exchange(frame, bucket_bytes=1 << 15).dealt
    assert dealt.count() == len(once) + len(often) and dict(dealt.groupBy("times").count().collect()) == {
        1: len(once), 2000: len(often)}
    result = remove(frame, bucket_bytes=1 << 15, part_bytes=1 << 15)
    found = Counter(map(tuple, result.collect()))
    # Two rows say the same as two thousand.
    assert found == {r: 1000 * n if n > 1 else n for r, n in Counter(plain(once + often * 2)).items()}


def test_frequent_phrase_in_varied_surroundings_is_no_single_part(spark, monkeypatch):
    phrase = "as has often been said in such matters, "
    rows = [(None if i % 7 == 0 else i % 9000, f"{hash_hex(i)}{phrase}{hash_hex(-i if i % 5 else 3)}")
            for i in range(suffix.HOT + 1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sent = []
    compared = suffix.Exchange.compared
    monkeypatch.setattr(suffix.Exchange, "compared", lambda self, facts, by: sent.append(facts) or compared(self, facts, by))
    found = got(suffix.remove_repeats(frame, bucket_bytes=1 << 18, part_bytes=1 << 16),
                "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == sorted(brute.removed_bytes(rows), key=key)
    assert sum(r[2] for r in found) > 0
    parts = [r[0] for r in sent[1].where("part >= 0").groupBy("part").agg(F.sum(F.length("payload"))).select(
        F.col("sum(length(payload))")).collect()]
    assert max(parts) < 0.2 * sum(parts)


def hash_hex(i):
    return hashlib.sha256(str(i).encode()).hexdigest()[:40]


def test_cover_moves_any_two_positions_onto_it():
    p, cover = substring.PERIOD, set(substring.COVER)
    for i in range(p):
        for j in range(p):
            assert any((i + s) % p in cover and (j + s) % p in cover for s in range(p))


def test_bucket_pointers_group_equal_strings():
    generator = np.random.default_rng(1)
    data = generator.integers(0, 2, 4000).astype(np.uint8)
    data[1000:1200] = data[3000:3200]
    starts, lengths = np.array([0, 900, 2500]), np.array([800, 1300, 1500])
    places, bucket = suffix.refine(data, starts, lengths)
    expected = [p for s, n in zip(starts, lengths, strict=True) for p in range(s, s + n - suffix.LENGTH + 1)]
    assert places.tolist() == expected
    strings = [data[p:p + suffix.LENGTH].tobytes() for p in places]
    assert len(set(zip(strings, bucket.tolist(), strict=True))) == len(set(strings)) == len(set(bucket.tolist()))


# 3: rules


def test_base_rules_and_repeats(both):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    result = repetition.repetition_rules(both).cache()
    assert got(result, *names) == sorted((brute.base_rules(*r) for r in texts(both)), key=key)
    assert result.where("base_failed and kept").isEmpty()
    small = [r for r in texts(both) if len(brute.words(r[1])) < 400][:60]
    measured = {(r.doc_id, r.n_words): (r.covered_words, r.longest_repeat) for r in result.collect()}
    for doc_id, text in small:
        w = brute.words(text)
        assert measured[doc_id, len(w)] == brute.repeats(w, repetition.MIN_REPEAT)


def test_verdict_on_repeated_paragraph(spark):
    once = " ".join(f"w{i}" for i in range(100))
    frame = spark.createDataFrame([(1, once), (2, f"{once}\n{once} " + " ".join(f"v{i}" for i in range(200)))], "doc_id long, text string")
    result = {r.doc_id: r for r in repetition.repetition_rules(frame, max_covered=0.5, max_longest=0.2).collect()}
    assert result[1].kept and result[1].longest_repeat == 0
    assert result[2].longest_repeat == 100 and result[2].covered_words == 200 and not result[2].kept


def test_suffix_array_of_words():
    symbols = np.array([hash(c) for c in "mississippi$banana$mississippi"])
    order, common = repetition.suffix_array(symbols)
    text = [symbols[i:].tolist() for i in order]
    rank = {s: i for i, s in enumerate(np.unique(symbols).tolist())}
    assert [[rank[s] for s in t] for t in text] == sorted([rank[s] for s in t] for t in text)
    for a, b, n in zip(text, text[1:], common[1:], strict=False):
        assert a[:n] == b[:n] and a[:n + 1] != b[:n + 1]


# 4: near-duplicates


@pytest.mark.parametrize("cell", [setsketch.CELL, 1])
def test_components_match_all_pairs(both, cell):
    result = setsketch.near_groups(both.where("doc_id is not null"), cell=cell)
    expected = brute.components(texts(both.where("doc_id is not null")))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in result.collect()} == expected


def test_rows_without_id_in_near_groups(odd):
    rows = setsketch.near_groups(odd).where("doc_id is null").collect()
    assert sorted((r.component_id is None, r.kept) for r in rows) == [(False, False), (True, True)]


def replaced(n):
    return " ".join([f"v{j}" for j in range(n)] + [f"w{j}" for j in range(n, 100)])


def test_rows_without_id_are_linked_and_are_bridges(spark):
    """Texts that differ in 8 words are linked, those that differ in 16 are not."""
    rows = [(7, replaced(0)), (None, replaced(8)), (3, replaced(16)), (9, replaced(100)),
            (None, "n" + replaced(40)), (None, "n" + replaced(41)), (None, "n" + replaced(41))]
    frame = spark.createDataFrame(rows * 30, "doc_id long, text string")
    result = Counter((r.doc_id, r.component_id, r.kept) for r in setsketch.near_groups(frame, cell=1).collect())
    assert result[7, 3, False] == result[3, 3, True] == result[None, 3, False] == result[9, 9, True] == 30
    assert sorted(n for r, n in result.items() if r[:2] == (None, None)) == [30, 60]
    assert sum(r[2] for r in result if r[:2] == (None, None)) == 1
    left = Counter(r.doc_id for r in setsketch.keep_first(frame).collect())
    assert left == {3: 1, 9: 1, None: 1}


def test_rows_with_neither_id_nor_word_stay(spark):
    rows = [(None, None), (None, ""), (None, " "), (None, ""), (1, ""), (1, ""), (2, None), (3, "a b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(r.doc_id for r in setsketch.keep_first(frame).collect()) == {None: 4, 1: 1, 2: 1, 3: 1}


def test_only_classes_with_a_likely_partner_get_their_text():
    """Two of 200 sketches in one cell are alike; the others share its band by chance."""
    generator = np.random.default_rng(8)
    sets = [generator.integers(0, 2**63, 400).astype(np.uint64) for _ in range(199)]
    sets.append(np.concatenate([sets[0][:390], sets[1][:10]]))
    sketches = [setsketch.registers(s) for s in sets]
    for s in sketches:
        s[:setsketch.ROWS] = 1
    key_ = int(setsketch.band_keys(sketches[0])[0])
    table = setsketch.pa.table({
        **{name: setsketch.pa.array(values, setsketch.pa.int64()) for name, values in {
            "key": [key_] * 200, "l": [0] * 200, "r": [0] * 200, "side": [0] + [2] * 199, "rep": range(200),
            "comp": range(200), "n": [400] * 200}.items()},
        "sketch": [s.tobytes() for s in sketches]})
    wanted = [r for b in setsketch._wanted(iter(table.to_batches()), 75) for r in b.column("rep").to_pylist()]
    assert sorted(wanted) == [0, 199]


def test_chain_through_a_large_group_is_linked(spark):
    """Each text differs from the next by one word, so the ends share nothing like 0.75."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        w = list(base)
        w[:i] = [f"v{j}" for j in range(i)]
        rows.append((i, " ".join(w)))
    result = setsketch.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), cell=8)
    assert {r.component_id for r in result.collect()} == {0}


def test_registers_merge_and_estimate():
    generator = np.random.default_rng(3)
    everything = generator.integers(0, 2**63, 3000).astype(np.uint64)
    errors = []
    for common in (500, 900, 1400):
        left, right = everything[:1500 + common // 2], everything[1500 - common // 2:]
        a, b = setsketch.registers(left), setsketch.registers(right)
        assert (setsketch.merge(a, b) == setsketch.registers(everything)).all()
        truth = len(np.intersect1d(left, right)) / len(everything)
        found = setsketch.estimate(np.array([(a > b).sum()]), np.array([(a < b).sum()]),
                                   np.array([float(len(left))]), np.array([float(len(right))]))[0]
        errors.append(abs(found - truth))
    assert max(errors) < 0.15


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (102, 101)], "a long, b long")
    assert dict(got(components(edges), "node", "root")) == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 102: 100}


# 10: exact duplicates


def expected_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not done, brute.sha(text)))
            done |= i == keep
    return sorted(out, key=key)


def test_exact_groups(both):
    found = got(exact.exact_groups(both), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert found == expected_groups(texts(both))


def test_exact_groups_survive_fingerprint_collisions(both, monkeypatch):
    """With one fingerprint for all texts of a length, the comparison of chunks decides."""
    real = exact._fingerprints

    def weak(batches):
        for batch in real(batches):
            zero = np.zeros(batch.num_rows, dtype=np.int64)
            yield batch.set_column(2, "fingerprint", __import__("pyarrow").array(zero))

    monkeypatch.setattr(exact, "_fingerprints", weak)
    found = got(exact.exact_groups(both), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert found == expected_groups(texts(both))


def test_fingerprints_compose(spark):
    data = bytes(np.random.default_rng(5).integers(0, 256, 300_000, dtype=np.uint8))
    whole = exact.fingerprint(data)
    rows = [(1, i, data[a:b]) for i, (a, b) in enumerate([(0, 10), (10, 60_000), (60_000, 60_000), (60_000, 120_000), (120_000, 180_000), (180_000, 240_000), (240_000, 300_000)])]
    frame = spark.createDataFrame(rows[::-1], "doc_id long, chunk_no long, bytes binary")
    assert [tuple(r) for r in exact.chunk_fingerprints(frame).collect()] == [(1, whole, len(data))]


# 6: chat


@pytest.fixture(scope="module")
def talk(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "anna", "hi"), (1, 2, "bob", None), (1, 3, None, "who?"),
            (1, 3, None, "who?"), (1, None, "anna", "first"), (None, 1, "anna", "no id"), (2, 0, "system", "alone"),
            *[(3, i, "ab"[i % 2], "t" * i) for i in range(700)]]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_matches_sql(talk):
    connection = duckdb.connect()
    conversations = talk.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    connection.register("conversations", conversations)
    cursor = connection.execute(chat.ROTATE_SQL)
    names = [c[0] for c in cursor.description]
    assert got(chat.rotate(talk), *names) == sorted(cursor.fetchall(), key=key)


def test_masks_cover_the_speakers_texts(talk):
    rows = chat.rotate(talk).where("conv_id = 1 and speaker = 'anna'").orderBy("seq").collect()
    whole = "".join(r.segment for r in rows)
    assert [whole[r.mask_start:r.mask_end] for r in rows if r.mask_start is not None] == [
        "first<|im_end|>", "hi<|im_end|>"]
    assert "user name=bob" in whole and "<|im_start|>system\nbe brief" in whole


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_registered_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "conversations", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = connection.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert got(QUERIES[name](spark, SF), *names) == sorted(cursor.fetchall(), key=key)


# 7: mixing


def loop_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    limited = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in limited)
        share = rest / max(sum(weight[s] for s in names if s not in limited), 1)
        new = {s for s in names if s not in limited and share * weight[s] > 3 * sizes[s] + 1e-9}
        if not new:
            return {s: 3 * sizes[s] if s in limited else share * weight[s] for s in names}
        limited |= new


def test_mix(both):
    result = mixing.mix(both).collect()
    sizes = Counter()
    for r in both.collect():
        sizes[r.source] += len(brute.words(r.text))
    assert {r.source: r.source_size for r in result} == sizes
    targets, taken = loop_targets(sizes), Counter()
    for r in result:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.target == pytest.approx(targets[r.source])
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 4 * mixing.BLOCK
    again = mixing.mix(both.repartition(7)).collect()
    assert sorted((key((r.doc_id, r.size)), r.taken) for r in again) == sorted((key((r.doc_id, r.size)), r.taken) for r in result)


def test_mix_over_shards(docs):
    result = mixing.mix(docs, shard_words=2000).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.first("source_size").alias("s"))
    for r in result.collect():
        assert abs(r.n - r.t) <= 4 * mixing.BLOCK * (r.s // 2000 + 1)


def test_sainte_lague_seats(spark):
    claims = {"a": 53000.0, "b": 24000.0, "c": 23000.0, "d": 10.0, "e": 0.0, "f": 23000.0}
    for seats in (0, 1, 7, 20, 101):
        won = Counter()
        for _ in range(seats):
            best = max(claims, key=lambda s: (claims[s] / (2 * won[s] + 1), claims[s], [-ord(c) for c in s]))
            won[best] += 1
        units = spark.createDataFrame([(0, s, c, seats, 10**6) for s, c in claims.items()], "g int, name string, claim double, seats long, most long")
        assert dict(got(mixing.apportion(units, "claim", "seats", "most", ["g"]), "name", "quota")) == {s: won[s] for s in claims}


def test_mixed_documents_hold_the_taken_words(both):
    ids = both.where("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    taken = {r.doc_id: r.taken for r in mixing.mix(ids).collect() if r.taken}
    given = Counter()
    whole = {r.doc_id: brute.words(r.text) for r in ids.collect()}
    result = mixing.mixed_documents(ids)
    assert result.columns == ids.columns
    for r in result.collect():
        w = iter(whole[r.doc_id])
        assert all(x in w for x in brute.words(r.text))
        given[r.doc_id] += len(brute.words(r.text))
    assert given == taken


# 8, 9: tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(both, name):
    generator = np.random.default_rng(9)
    held = [t or "" for _, t in texts(both)] + [
        "", " ", "it's 'S I'LL --'s 's\n's 're", "a<|endoftext|> b", "\x1c\x0b x", "İ é́ ﬁ ſ ẞ K",
        *("".join(generator.choice(list(" \n\t's tremvld1½.-é"), 40)) for _ in range(300))]
    encoder = Encoder(public_tokenizers.path(name), 5)
    library = Tokenizer.from_file(public_tokenizers.path(name))
    for i, ids in encoder.batch(held):
        assert ids.tolist() == [*library.encode(held[i], add_special_tokens=False).ids, 5]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_coded_ids_come_back(spark, both):
    folder, path = shared_folder(spark, "test-ids"), public_tokenizers.path("byte_bpe_50k.json")
    huffman.write_ids(both.repartition(3), folder, path, 0, block_tokens=5000)
    library, start, expected = Tokenizer.from_file(path), 0, []
    result = sorted((tuple(r) for r in huffman.read_ids(spark, folder).collect()), key=lambda r: r[1])
    coded = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in texts(both)]
    assert sorted(key((r[0], r[2], r[3])) for r in result) == sorted(key((i, len(x), crc(x))) for i, x in coded)
    assert [(r[0] is not None, r[0] or 0) for r in result] == sorted((r[0] is not None, r[0] or 0) for r in result)
    for r in result:
        assert r[1] == start
        start += r[2]


@pytest.mark.parametrize("counts", [[5], [0, 7, 0], [1, 1], [2**i for i in range(40)], list(range(500))])
def test_huffman_codes(counts):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= huffman.LIMIT
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    ids = np.repeat(np.arange(len(counts)), np.minimum(counts, 50))
    np.random.default_rng(2).shuffle(ids)
    codes = huffman.canonical_codes(lengths)
    documents = [(None, ids[:0]), (3, ids[:len(ids) // 2]), (3, ids[len(ids) // 2:])]
    back = huffman.read_block(huffman.write_block(documents, codes, lengths), huffman.decode_table(lengths))
    assert back[3].tolist() == ids.tolist() and back[2].tolist() == [len(d[1]) for d in documents]
    assert back[1].tolist() == [1, 0, 0]


def test_lengths_are_optimal():
    import heapq

    counts = np.random.default_rng(4).zipf(1.4, 300)
    heap, cost = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both_ = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both_
        heapq.heappush(heap, both_)
    free = huffman.code_lengths(counts, 40)
    assert int((free * counts).sum()) == cost
    tight = huffman.code_lengths(counts, 9)
    assert tight.max() <= 9 and int((tight * counts).sum()) >= cost


def check_packed(rows, coded, window):
    assert Counter((key((r.doc_id,)), r.doc_tokens) for r in rows if r.start == 0) == Counter((key((i,)), len(x)) for i, x in coded)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for pieces in sequences.values():
        total = 0
        for offset, length in sorted(pieces):
            assert offset == total and length > 0
            total += length
        assert total <= window
        padding += 0 if total & (total - 1) == 0 else window - total
    return padding


@pytest.mark.parametrize("parts", [1, 5])
def test_packing(both, parts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    unique = both.where("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    rows = packing.pack_documents(unique.repartition(parts), path, 2).collect()
    coded = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts(unique)}
    assert check_packed(rows, coded.items(), packing.WINDOW) == 0
    seen = Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.ids_crc32 == crc(coded[r.doc_id][r.start:r.start + r.length])
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in coded.items()}


def test_sum_of_squares_choice_and_folding():
    generator = np.random.default_rng(8)
    packer = packing.Packer(window=32, max_open=6)
    fill = np.zeros(33, dtype=np.int64)
    for i in range(400):
        size = int(generator.integers(1, 80))
        rest = size % 32
        levels = packer.level.copy() // 2
        if rest:
            costs = {0: 2 * levels[rest] + 1}
            costs |= {h: 2 * ((levels[h + rest] if h + rest < 32 else 0) - levels[h]) + (2 if h + rest < 32 else 1)
                      for h in range(1, 33 - rest) if levels[h] > 0}
            best = min(costs.values())
            before = packer.level.copy()
        packer.add(i, np.arange(size))
        if rest and packer.open and np.abs(packer.level - before)[:32].sum() <= 4:
            change = packer.level[:32] // 2 - before[:32] // 2
            grown = int(((before[:32] // 2 + change) ** 2).sum() - ((before[:32] // 2) ** 2).sum())
            assert grown == best
        assert packer.open <= 7
        fill = packer.level
    packer.finish()
    assert fill is not None and sum(r[2] for r in packer.done) == sum(r[4] for r in packer.done if r[1] == 0)


# 1: quality


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_classifier_on_held_out_labels(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    result = quality.classify(docs, labels)
    rows = result.join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert result.where("(score >= 0.3) != (predicted = 1) or score < 0 or score > 1").isEmpty()


def test_classifier_ignores_other_columns_and_labels(spark, odd, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.train(docs, labels)
    first = got(quality.score(odd, model), "doc_id", "__score")
    second = got(quality.score(odd.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string")}), model), "doc_id", "__score")
    assert first == second and len(first) == odd.count()


def test_classifier_without_labels(spark, odd, labels):
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels.limit(0)).columns == odd.columns


def test_exact_neighbours():
    held = [b"the quick brown fox jumps over the lazy dog again", b"THE!! BIG!! SALE!! NOW!!", b"a | b | c | d | e | f", b""]
    sample = quality.vectors(held * 5)
    model = quality.fit(sample, np.array([1.0, 0.0, 0.0, 1.0] * 5), latent=3)
    scores = model.scores(held, neighbours=5)
    cosines = model.latent(quality.vectors(held)) @ model.labelled.T
    for row, score in zip(cosines, scores, strict=True):
        near = np.sort(row)[-5:]
        assert near.min() >= np.delete(row, np.argsort(row)[-5:]).max() - 1e-6
        assert 0 <= score <= 1
    assert scores[0] > 0.5 > scores[1]


# all of them on an empty table


def test_empty_tables(spark, none, labels):
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = shared_folder(spark, "test-none")
    huffman.write_ids(none, folder, path, 0)
    for frame in (
        quality.classify(none, labels), substring.remove_repeats(none), repetition.repetition_rules(none),
        setsketch.near_groups(none), suffix.remove_repeats(none), mixing.mix(none), mixing.mixed_documents(none),
        huffman.read_ids(spark, folder), packing.pack_documents(none, path, 2), exact.exact_groups(none),
        chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert frame.isEmpty()


def test_odd_rows(odd, spark):
    n, path = odd.count(), public_tokenizers.path("byte_bpe_50k.json")
    folder = shared_folder(spark, "test-odd")
    huffman.write_ids(odd, folder, path, 0)
    for frame in (
        substring.remove_repeats(odd), repetition.repetition_rules(odd), setsketch.near_groups(odd),
        suffix.remove_repeats(odd), mixing.mix(odd), huffman.read_ids(spark, folder), exact.exact_groups(odd),
        packing.pack_documents(odd, path, 2).where("start = 0"),
    ):
        assert frame.count() == n


def test_word_hashes():
    held = ["", " ", "a b a", "é  a\tb\n", "x" * 1000]
    found = [(h.tolist(), [t.encode()[b:e].decode() for b, e in zip(begins, ends, strict=True)])
             for t, (h, begins, ends) in zip(held, words_of([t.encode() for t in held]), strict=True)]
    names = {}
    for text, (hashes, cut) in zip(held, found, strict=True):
        assert cut == brute.words(text)
        for w, h in zip(cut, hashes, strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
