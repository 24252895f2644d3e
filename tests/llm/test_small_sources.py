"""Mixing sources of a few words, partial copies as they stand, and rows that share or lack an id."""

import re
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from scarpline.llm import exact, mixing


def test_small_sources_meet_their_targets(spark):
    rows, doc_id = [], 0
    for size in [1, 2, 5, 10, 20, 64, 65, 130, 200, 300]:
        left = size
        while left:
            n = min(left, 1 + doc_id % 37)
            rows.append((doc_id, " ".join(f"w{doc_id}_{i}" for i in range(n)), f"s{size:03d}"))
            left, doc_id = left - n, doc_id + 1
    rows += [(10_000 + i, "big " * 500, "t") for i in range(60)] + [(20_000, "five words of no source", None)]
    rows += [(30_000 + i, "", "empty") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for more in ({}, {"shard_words": 90, "shard_rows": 7}):
        taken, targets = Counter(), {}
        for r in mixing.mix(frame, **more).collect():
            taken[r.source] += r.taken
            targets[r.source] = r.target
            assert r.taken <= 3 * r.size
        for source, target in targets.items():
            assert abs(taken[source] - target) <= 1, source
        assert taken["s010"] == 30 and taken[None] == 15


def test_a_source_of_many_empty_documents_is_many_shards(spark):
    frame = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "a word").otherwise("").alias("text"),
        F.lit("s").alias("source"))
    result = mixing.mix(frame, shard_rows=500)
    assert result.select("shard").distinct().count() > 5
    assert result.agg(F.sum("taken")).first()[0] == 100


def test_partial_copies_keep_their_white_space(spark):
    text = "\n".join(f"line {i}:\tsome words  here" for i in range(200))
    rows = [(i, text, "a") for i in range(3)] + [(10 + i, text, "b") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    decided = {r.doc_id: r for r in mixing.mix(frame).collect()}
    partial = 0
    for r in mixing.mixed_documents(frame).collect():
        if r.text == text:
            continue
        partial += 1
        n = len(brute.words(r.text))
        assert n == decided[r.doc_id].taken - decided[r.doc_id].rounds * decided[r.doc_id].size
        assert r.text == r.text.rstrip() and len(re.findall("\t", r.text)) > n // 7 and "  " in r.text
    assert partial


@pytest.mark.parametrize("share", [1, 2])
def test_exact_groups_without_ids(spark, share):
    """All or half of the rows lack an id; repeated rows come back one by one."""
    rows = [(None if i % share == 0 else i, f"text {i % 40}  of\tsome") for i in range(600)]
    rows += [(None, "the same row")] * 70_000
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    result = exact.exact_groups(frame).groupBy("text_sha256").agg(
        F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept"), F.max("group_size").alias("size")).collect()
    sizes = Counter(re.sub(r"\s+", " ", t) for _, t in rows)
    assert {r["text_sha256"]: r["n"] for r in result} == {brute.sha(t): n for t, n in sizes.items()}
    assert all(r["kept"] == 1 and r["size"] == r["n"] for r in result)
