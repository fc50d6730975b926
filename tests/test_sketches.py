"""Sketches against exact quantiles and counts."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from trialforge.operators import sketches


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(4)
    rows = [(f"v{rng.randrange(3)}", rng.choice("abc"), round(rng.gauss(3, 1), 3)) for _ in range(30_000)]
    rows += [("v0", None, 2.0), ("v9", "a", None), ("v8", "a", float("nan")), ("v7", "b", 1.5)]
    return spark.createDataFrame(rows, "variant string, level string, v double").repartition(5).cache()


def exact(scores, by):
    out = {}
    for r in scores.where("v is not null and not isnan(v)").collect():
        out.setdefault(tuple(r[c] for c in by), []).append(r["v"])
    return {k: sorted(v) for k, v in out.items()}


def off(values, x, share):
    """How far the ranks of x are from the share."""
    low, high = bisect.bisect_left(values, x) / len(values), bisect.bisect_right(values, x) / len(values)
    return max(0.0, low - share, share - high)


@pytest.mark.parametrize("k", [64, 200, 8192])
def test_quantiles_within_their_error(scores, k):
    own = sketches.quantile_sketches(scores, ["variant", "level"], "v", k)
    both = sketches.quantiles(sketches.rolled_up(own, [["variant"], ["variant", "level"]], k))
    direct = sketches.quantiles(sketches.quantile_sketches(scores, ["variant"], "v", k))
    fine, coarse = exact(scores, ["variant", "level"]), exact(scores, ["variant"])
    seen = 0
    for r in [*both.collect(), *direct.withColumn("grouping", F.lit(1)).withColumn("level", F.lit(None)).collect()]:
        values = coarse[(r["variant"],)] if r["grouping"] == 1 else fine[r["variant"], r["level"]]
        assert r["n"] == len(values) and r["low"] == values[0] and r["high"] == values[-1]
        assert all(off(values, r[c], q) <= (0 if len(values) <= k else 1.5 * sketches.rank_error(k)) for c, q in sketches.SHARES.items())
        seen += 1
    assert seen == len(fine) + 2 * len(coarse)


def test_roll_up_equals_direct_sketch_where_exact(scores):
    own = sketches.quantile_sketches(scores, ["variant", "level"], "v", 32768)
    rolled = sketches.quantiles(sketches.rolled_up(own, [["variant"]], 32768)).drop("grouping")
    direct = sketches.quantiles(sketches.quantile_sketches(scores, ["variant"], "v", 32768))
    assert sorted(map(tuple, rolled.collect())) == sorted(map(tuple, direct.collect()))
    assert sketches.quantiles(sketches.quantile_sketches(scores.limit(0), ["variant"], "v")).count() == 0


@pytest.mark.parametrize("k", [8, 200])
def test_exact_quantiles_beyond_the_sketch(scores, k):
    shares = {"low": 0.0, "tenth": 0.1, "third": 0.333, "median": 0.5, "dear": 0.9, "high": 1.0}
    got = sketches.exact_quantiles(scores, [["variant"], ["variant", "level"]], "v", shares, k).collect()
    fine, coarse = exact(scores, ["variant", "level"]), exact(scores, ["variant"])
    for r in got:
        values = coarse[(r["variant"],)] if r["grouping"] == 1 else fine[r["variant"], r["level"]]
        assert r["n"] == len(values)
        for name, share in shares.items():
            assert r[name] == values[max(1, -(-len(values) * round(1000 * share) // 1000)) - 1]
    assert len(got) == len(fine) + len(coarse)
    assert sketches.exact_quantiles(scores.limit(0), [["variant"]], "v").count() == 0


@pytest.mark.parametrize("tracked", [48, 4000])
def test_frequent_texts(spark, tracked):
    rng = random.Random(9)
    rows = [(rng.choice("xy"), rng.choice("ab"), f"b{int(rng.paretovariate(0.7))}"[:20]) for _ in range(20_000)] + [("x", "a", None), ("z", "a", "only")]
    df = spark.createDataFrame(rows, "g string, part string, text string").repartition(4)
    count = {}
    for g, _, t in rows:
        if t is not None:
            count.setdefault(g, {}).setdefault(t, 0)
            count[g][t] += 1
    got = sketches.frequent_texts(sketches.text_sketches(df, ["g", "part"], "text", tracked=tracked), ["g"], 5, tracked).collect()
    for g, own in count.items():
        n, found = sum(own.values()), {r["text"]: r for r in got if r["g"] == g}
        bound = sketches.count_error(n, tracked) if len(own) > 0.75 * tracked else 0
        for t, r in found.items():
            assert own.get(t, 0) <= r["n"] <= own.get(t, 0) + bound + 1e-9 and r["at_least"] <= own.get(t, 0)
        want = sorted(own, key=lambda t: (-own[t], t))[:5]
        if not bound:
            assert sorted(found, key=lambda t: found[t]["place"]) == want
        assert all(t in found for t in want if own[t] > own[want[-1]] + 2 * bound)
