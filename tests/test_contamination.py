"""Snippets found by rolling hashes, against a search of every text for every snippet."""

import random

import numpy as np
import pytest

from trialforge.operators import contamination, integrity

ALPHABET = "ab cdé中🙂\n"


def words(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def brute(prompts, snippets):
    return {(p, t) for p, own, text in prompts for t, s in snippets if text and s and t is not None and own is not None and t != own and s in text}


@pytest.mark.parametrize("width", [1, 2, 7, 64])
def test_hashes_roll(width):
    points = np.random.default_rng(1).integers(0, 3, 500).astype(np.uint32)
    whole = contamination.rolled(points, width)
    assert len(whole) == 501 - width
    for i in (0, 13, 500 - width):
        assert whole[i] == contamination.rolled(points[i : i + width], width)[0]
    assert len(np.unique(contamination.rolled(np.arange(500, dtype=np.uint32), width))) == 501 - width


def test_sliding_least():
    x = np.random.default_rng(2).integers(0, 99, 100).astype(np.uint64)
    for width in (1, 3, 10, 100):
        assert contamination.sliding_least(x, width).tolist() == [x[i : i + width].min() for i in range(101 - width)]


@pytest.mark.parametrize("lengths", [(20, 20), (3, 40)])
def test_equals_search(spark, lengths):
    rng = random.Random(5)
    snippets = [(f"t{rng.randrange(4)}", words(rng, rng.randint(*lengths))) for _ in range(60)] + [("t1", None), ("t2", ""), (None, words(rng, 20))]
    shared = words(rng, 20)
    snippets += [("t0", shared), ("t1", shared), ("t1", shared)]
    prompts = []
    for i in range(80):
        parts = [words(rng, rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice([s for _, s in snippets if s]), words(rng, rng.randrange(3))]
        prompts.append((i, f"t{rng.randrange(5)}", "".join(parts)))
    prompts += [(100, "t0", None), (101, "t0", ""), (102, None, shared), (103, "t9", shared), (103, "t9", shared), (104, "t1", shared[:-1])]
    rows = spark.createDataFrame(prompts, "prompt_id long, task_id string, text string").repartition(3)
    known = spark.createDataFrame(snippets, "task_id string, snippet string")
    assert {tuple(r) for r in contamination.contamination(rows, known).collect()} == brute(prompts, snippets)


def test_long_text_and_its_pieces(spark, monkeypatch):
    monkeypatch.setattr(contamination, "AT_ONCE", 4096)
    contamination.powers.cache_clear()
    rng = random.Random(7)
    snippets = [(f"t{i % 3}", words(rng, 200)) for i in range(40)]
    text = "".join(words(rng, 900) + s + words(rng, rng.randrange(1900)) for _, s in snippets)
    seen = []
    for owners, starts, laid in contamination.laid_out([text, None, "short", text[:5000]], 200, 200):
        seen += [(o, laid[a:b]) for o, a, b in zip(owners, starts, [*starts[1:], len(laid)], strict=True)]
    for owner, whole in ((0, text), (3, text[:5000])):
        windows = {p[i : i + 200] for o, p in seen if o == owner for i in range(len(p) - 199)}
        assert windows == {whole[i : i + 200] for i in range(len(whole) - 199)}
    contamination.powers.cache_clear()


def test_full_sieve_loses_nothing(spark, monkeypatch):
    rng = random.Random(11)
    snippets = [(f"t{i % 3}", words(rng, 30)) for i in range(50)]
    prompts = [(i, f"t{i % 4}", words(rng, 50) + (snippets[i][1] if i % 2 else "") + words(rng, 50)) for i in range(50)]
    rows, known = spark.createDataFrame(prompts, "prompt_id long, task_id string, text string"), spark.createDataFrame(snippets, "task_id string, snippet string")
    monkeypatch.setattr(contamination, "sieve_of", lambda known: np.full(contamination.BLOCK_BITS // 64, np.uint64(2**64 - 1)))
    assert {tuple(r) for r in contamination.contamination(rows, known).collect()} == brute(prompts, snippets)


def test_summary(spark):
    prompts = spark.createDataFrame([(1, "a", "xx needle xx"), (2, "b", "needle"), (3, "c", "hay"), (4, "a", None), (5, "z", "")], "prompt_id long, task_id string, text string")
    snippets = spark.createDataFrame([("b", "needle"), ("c", "thread"), ("c", "needle")], "task_id string, snippet string")
    row = integrity.summary("x", contamination.checked(prompts, snippets)).first()
    # a and z meet b and c; b meets c; c meets b.
    assert (row["passed"], row["total"], row["failures"]) == (False, 6, 3)
    row = integrity.summary("x", contamination.checked(prompts, snippets.limit(0))).first()
    assert (row["passed"], row["total"], row["failures"]) == (True, 0, 0)


def test_texts_are_read_once(spark, tmp_path):
    prompts = [(i, "a", "some text " * 30) for i in range(50)]
    spark.createDataFrame(prompts, "prompt_id long, task_id string, text string").write.parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    known = spark.createDataFrame([("b", "some text some text ")], "task_id string, snippet string")
    plan = contamination.contamination(rows, known)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
