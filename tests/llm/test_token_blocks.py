"""Blocks of a long text among many short ones, and the order of rows that repeat their id."""

import tracemalloc

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from scarpline.llm import huffman
from scarpline.llm.common import shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_a_long_document_among_short_ones_takes_little_memory():
    generator = np.random.default_rng(8)
    counts = np.bincount(generator.zipf(1.3, 500_000) % 50_000, minlength=50_257)
    lengths = huffman.code_lengths(counts)
    codes, used = huffman.canonical_codes(lengths), np.flatnonzero(lengths)
    documents = [(0, generator.choice(used, 400_000).astype(np.uint16))] + [
        (i, generator.choice(used, 20).astype(np.uint16)) for i in range(1, 5001)]
    tracemalloc.start()
    back = huffman.read_block(huffman.write_block(documents, codes, lengths), huffman.decode_table(lengths))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (back[3] == np.concatenate([d[1] for d in documents])).all()
    assert peak < 200 << 20


def test_starts_agree_over_reruns_with_repeated_and_null_ids(spark):
    rows = [(None if i % 3 == 0 else i % 5, f"text {i * i % 17} of {i % 4}" * (1 + i % 3)) for i in range(400)]
    rows.append((2, "one long text, again and again; " * 60_000))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for layout in (frame.repartition(7), frame.coalesce(1).orderBy("text")):
        folder = shared_folder(spark, "test-starts")
        huffman.write_ids(layout, folder, PATH, 0, block_tokens=3000)
        result = huffman.read_ids(spark, folder)
        found.append(sorted((tuple(r) for r in result.collect()), key=lambda r: r[1]))
    assert found[0] == found[1] and len(found[0]) == 401
    assert [r[0] is not None for r in found[0]] == sorted(r[0] is not None for r in found[0])


def test_a_repeated_row_is_dealt_over_ranges(spark):
    frame = spark.range(30_000, numPartitions=4).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    folder = shared_folder(spark, "test-same")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        huffman.write_ids(frame, folder, PATH, 0, block_tokens=2000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.select("part").distinct().count() > 1
    starts = huffman.read_ids(spark, folder).agg(F.count("*"), F.countDistinct("start"), F.max("start")).first()
    assert starts[0] == starts[1] == 30_000
