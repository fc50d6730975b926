"""The sweep line against pairs of calls."""

import random

import pytest

from trialforge.operators import prefix, sweep, timeline

SCHEMA = "run_id long, trace_id long, started_us long, ended_us long"


def brute(calls):
    lasting = [c for c in calls if c[2] is not None and c[3] is not None and c[3] > c[2]]
    degree, groups, busy = {}, set(), {}
    for run in {c[0] for c in lasting}:
        own = [c for c in lasting if c[0] == run]
        for c in own:
            degree[run, c[1]] = sum(1 for d in own if d[1] != c[1] and d[2] < c[3] and c[2] < d[3])
        for at in {c[2] for c in own}:
            active = [c for c in own if c[2] <= at < c[3]]
            until = min(c[3] for c in active)
            if len(active) >= 2 and not any(at < c[2] < until for c in own):
                groups.add((run, at, until, len(active)))
        moments = sorted({t for c in own for t in c[2:]})
        steps = [(b - a, sum(1 for c in own if c[2] <= a < c[3])) for a, b in zip(moments, moments[1:])]
        busy[run] = (max(n for _, n in steps), sum(w for w, n in steps if n), sum(w for w, n in steps if n >= 2))
    return degree, groups, busy


@pytest.fixture(scope="module")
def calls():
    rng = random.Random(3)
    rows = []
    for i in range(600):
        start = rng.randrange(400)
        rows.append((rng.choice([1, 1, 1, 2, 3, None]), i, start, start + rng.choice([0, 1, 1, 3, 10, 60])))
    return [*rows, (1, 1000, None, 5), (1, 1001, 5, None), (1, 1002, 9, 4), (4, 1003, 0, 10), (4, 1004, 10, 20), (5, 1005, 0, 10), (5, 1006, 9, 20)]


@pytest.fixture(scope="module")
def traces(spark, calls):
    return spark.createDataFrame(calls, SCHEMA).repartition(3).cache()


def test_degrees(calls, traces):
    want, _, _ = brute(calls)
    assert {(r["run_id"], r["trace_id"]): r["degree"] for r in sweep.degrees(traces).collect()} == want
    assert want[4, 1003] == 0 and want[5, 1005] == 1  # touching calls do not overlap


def test_largest_groups(calls, traces):
    _, want, _ = brute(calls)
    got = [tuple(r) for r in sweep.largest_groups(traces).collect()]
    assert set(got) == want and len(got) == len(want)


def test_profile(calls, traces):
    _, _, want = brute(calls)
    assert {r["run_id"]: (r["peak"], r["busy_us"], r["parallel_us"]) for r in sweep.profile(traces).collect()} == want


def test_stretches_are_islands(traces):
    lasting = traces.where("ended_us > started_us")
    got = sorted(tuple(r) for r in sweep.stretches(traces).where("run_id is not null").collect())
    want = sorted((r["run_id"], r["started_us"], r["ended_us"], r["n_events"]) for r in timeline.islands(lasting).where("run_id is not null").collect())
    assert got == want


@pytest.mark.parametrize("least", [0, 50, 10_000])
def test_runs_cut_or_whole(calls, traces, monkeypatch, least):
    """Ranges of large runs alone, of all, and of none give the same; a profile makes one order of its events."""
    monkeypatch.setattr(prefix, "LEAST", least)
    degree, groups, busy = brute(calls)
    assert {(r["run_id"], r["trace_id"]): r["degree"] for r in sweep.degrees(traces).collect()} == degree
    assert {tuple(r) for r in sweep.largest_groups(traces).collect()} == groups
    assert {r["run_id"]: (r["peak"], r["busy_us"], r["parallel_us"]) for r in sweep.profile(traces).collect()} == busy
    plan = sweep.profile(traces)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2  # over the events, and over the sums of ranges


def test_empty(traces):
    none = traces.limit(0)
    assert [f(none).count() for f in (sweep.degrees, sweep.profile, sweep.largest_groups, sweep.stretches)] == [0, 0, 0, 0]


def test_large_run_without_pairs(spark):
    """100,000 calls of one run that all overlap 999 others at least: 10 ** 8 pairs, none of which is made."""
    n, width = 100_000, 1000
    rows = spark.range(n).selectExpr("1L as run_id", "id as trace_id", "id as started_us", f"id + {width} as ended_us")
    plan = sweep.degrees(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Range" in plan and "CartesianProduct" not in plan  # nested loops join the one row of edges alone
    got = sweep.degrees(rows).selectExpr("min(degree)", "max(degree)", "sum(degree)", "count(*)").first()
    inside = sum(min(i, width - 1) + min(n - 1 - i, width - 1) for i in range(n))
    assert tuple(got) == (width - 1, 2 * (width - 1), inside, n)
    groups = sweep.largest_groups(rows)
    assert groups.count() == n - width + 1 and groups.where(f"n <> {width}").isEmpty()
    assert tuple(sweep.profile(rows).select("peak", "busy_us").first()) == (width, n + width - 1)
