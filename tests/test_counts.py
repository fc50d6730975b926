"""Incremental completeness against the full recomputation after each batch."""

import random

import pytest

from trialforge.operators import progress
from trialforge.streaming import counts, microbatch

RUNS = "run_id long, variant_id string, task_id string, repetition long, status string"


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(6)
    runs = [(i, rng.choice(["v1", "v2", "v9"]), rng.choice(["t1", "t2"]), rng.randrange(3), rng.choice(["completed", "completed", "failed"])) for i in range(60)]
    matrix = progress.expected(spark, ["v1", "v2", "v3"], ["t1", "t2"], [0, 1, 2])
    facts = [(r[0], "completed", *r[1:4]) for r in runs if r[4] == "completed"] + [(i, k, None, None, None) for i in range(70) for k in ("scored", "checked") if rng.random() < 0.6]
    rng.shuffle(facts)
    facts += facts[:10]  # repeated in later batches
    return matrix, [facts[i::5] for i in range(5)]


def full(spark, matrix, facts):
    runs = spark.createDataFrame([(i, v, t, n, "completed") for i, k, v, t, n in set(facts) if k == "completed"], RUNS)
    of = lambda kind: spark.createDataFrame([(f[0],) for f in set(facts) if f[1] == kind], "design_id long")
    return progress.completeness(matrix, runs, runs.selectExpr("run_id", "run_id as design_id"), of("scored"), of("checked")).first().asDict()


def test_each_batch_equals_recomputation(spark, tmp_path, world):
    matrix, batches = world
    state, seen = counts.Completeness(spark, f"file://{tmp_path}/feed", matrix), []
    assert state.now().first()["actual_runs"] == 0
    for k, batch in enumerate(batches):
        df = spark.createDataFrame([*batch, batch[0], (None, "scored", None, None, None), (1, "other", None, None, None)], counts.FACT)
        seen += batch
        for _ in range(2 if k == 2 else 1):
            state.handle(df, k)
            assert state.now().first().asDict() == full(spark, matrix, seen)
    before = state.facts().count()
    state.handle(spark.createDataFrame([], counts.FACT), 5)
    assert state.now().first().asDict() == full(spark, matrix, seen) and state.facts().count() == before


def test_earlier_facts_are_exchanged_once(spark, tmp_path, world, monkeypatch):
    """A batch has one plan that reads the earlier facts, and triples that are there are not found in facts again."""
    matrix, batches = world
    state = counts.Completeness(spark, f"file://{tmp_path}/feed", matrix)
    read, count = state._read, []
    monkeypatch.setattr(state, "_read", lambda name, schema: count.append(name) or read(name, schema))
    for k, batch in enumerate(batches):
        state.handle(spark.createDataFrame(batch, counts.FACT), k)
    assert count.count("facts") == len(batches) and count.count("triples") == 2 * len(batches)
    assert state._read("triples", counts.TRIPLES).count() == state.now().first()["actual_runs"]


def test_stream(spark, tmp_path, world):
    matrix, batches = world
    source = f"{tmp_path}/in"
    state = counts.Completeness(spark, f"file://{tmp_path}/feed", matrix)
    seen = []
    for k, batch in enumerate(batches[:3]):
        spark.createDataFrame(batch, counts.FACT).coalesce(1).write.mode("append").parquet(source)
        seen += batch
        microbatch.run_available(spark.readStream.schema(counts.FACT).parquet(source), state.handle, f"{tmp_path}/checkpoint")
        assert state.now().first().asDict() == full(spark, matrix, seen)
    assert state.changes().count() == 3


def test_scoring_queue(spark):
    designs = spark.createDataFrame([(1, 2), (2, 2), (3, 0), (4, None)], "design_id long, pairs int")
    of = lambda *ids: spark.createDataFrame([(i,) for i in ids], "design_id long")
    args = (designs, of(1, 1, 1, 2, 9), of(1, 1, 2), of(1, 2, 3, 3))
    got = {r["design_id"]: (r["evals_left"], r["checks_left"], r["median_missing"]) for r in progress.scoring_queue(*args, wanted=3).collect()}
    assert got == {2: (2, 1, False), 3: (3, 0, False), 4: (3, 0, True)}
    assert progress.resumption(*args, wanted=3).first().asDict() == {"designs": 4, "evals_done": 4, "checks_done": 3, "medians_done": 3, "pending": 3, "calls_left": 9}
