"""The pipeline against the brute-force statement of each stage, on what that stage was given."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from scarpline.llm import quality
from scarpline.llm.common import shared_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        folder = shared_folder(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(folder)
        out.append((docs, spark.read.parquet(folder)))
        docs = out[-1][1]
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out, strict=True))


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages(stages):
    names = list(stages)
    assert names == ["quality_classifier", "exact_dedup", "near_dedup", "source_mixing", "packing"]
    for name in names[:-1]:
        assert stages[name][1].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(spark, stages):
    given, kept = stages["quality_classifier"]
    result = quality.classify(given, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(kept) == ids(result.where("predicted = 1"))


def test_dedup_stages(stages):
    given, kept = stages["exact_dedup"]
    first = {}
    for r in given.orderBy("doc_id").collect():
        first.setdefault(" ".join(r.text.split()) if r.text.strip() == r.text else r.text, r.doc_id)
    assert ids(kept) == sorted(first.values())
    given, kept = stages["near_dedup"]
    found = brute.components([(r.doc_id, r.text) for r in given.collect()])
    assert ids(kept) == sorted(i for i, (_, top) in found.items() if top == i)


def test_mix_and_packing_stages(stages):
    given, mixed = stages["source_mixing"]
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    before, after = (f.select(F.sum(words)).first()[0] for f in (given, mixed))
    assert abs(before - after) < 0.05 * before
    assert mixed.groupBy("doc_id").count().where("count > 3").isEmpty()
    mixed, packed = stages["packing"]
    assert packed.where("start = 0").count() == mixed.count()
    tokens = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert tokens.where("n > 4096").isEmpty()


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages["packing"][1].count()
