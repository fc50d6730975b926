"""The pipeline, stage by stage, and its stages on awkward rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import TEXTS
from tests.llm.test_counts_packing import check_packed, ids_of
from tests.llm.test_dedup import brute_near
from tests.llm.test_models import brute_statistics

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "language", "exact_duplicates", "near_duplicates", "packing"]
    kept = stages["quality_rules"](spark, docs, sf).cache()
    assert kept.columns == COLUMNS
    ids = {r["doc_id"] for r in kept.collect()}
    for r in docs.collect():
        n, *_, repeat = brute_statistics(r["text"])
        if n < 20 or 100 * repeat > 30 * n:
            assert r["doc_id"] not in ids
        elif r["doc_id"] in labels:
            assert (r["doc_id"] in ids) == (labels[r["doc_id"]] == 1)
    told = stages["language"](spark, kept, sf).cache()
    assert told.count() == kept.count() and told.columns == COLUMNS
    one = stages["exact_duplicates"](spark, told, sf).cache()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in told.collect():
        first[norm(r["text"])] = min(r["doc_id"], first.get(norm(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(first.values())
    near = stages["near_duplicates"](spark, one, sf).cache()
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert {r["doc_id"] for r in near.collect()} == {c for _, _, c in brute_near(rows, 80)}
    pieces = stages["packing"](spark, near, sf).collect()
    check_packed(pieces, {r["doc_id"]: [ids_of(r["text"])] for r in near.collect()}, 4096)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:4])
def test_stages_on_edges(spark, sf, edge, none, name, stage):
    out = stage(spark, edge, sf)
    assert out.columns == edge.columns and out.count() <= len(TEXTS)
    assert stage(spark, none, sf).count() == 0
    if name == "language":
        assert {2, 3, 7} & {r["doc_id"] for r in out.collect()} == set()


def test_packing_stage_on_edges(spark, sf, edge, none):
    out = corpus_pipeline.packed(spark, edge, sf)
    assert out.agg(F.sum("length")).first()[0] == sum(len(ids_of(t)) for _, t in TEXTS)
    assert corpus_pipeline.packed(spark, none, sf).count() == 0


def test_language_stage_rejects_noise(spark):
    """Texts of alphabets that were not learned and random letters go; clean held-out documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    unlabelled = F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang")
    clean = docs.select("doc_id", "text", unlabelled, "source", "n_chars").where(F.size(F.split("text", " ")) >= 20)
    rng = random.Random(5)
    alphabets = ["".join(map(chr, range(*r))) for r in ((0x61, 0x7B), (0x430, 0x450), (0x3B1, 0x3CA), (0x4E00, 0x5E00))]
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    noise = [(-1 - k, " ".join(word(alphabets[k % 4]) for _ in range(300)), None, "s", 1) for k in range(200)]
    both = clean.unionByName(spark.createDataFrame(noise, clean.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, both, "").select("doc_id").collect()}
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} <= kept
    assert len([i for i in kept if i < 0]) <= 1


def test_language_stage_without_labels(spark, sf, edge):
    """No language can be learned: all rows with a letter stay."""
    out = corpus_pipeline.language(spark, edge.withColumn("lang", F.lit(None).cast("string")), sf)
    assert out.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(i) for i, t in TEXTS if any(c.isalpha() for c in t or ""))
