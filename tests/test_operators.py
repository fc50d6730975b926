"""Operators on small fixtures: properties, edge cases, hand-made values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trialforge.functions import parsing
from trialforge.operators import analysis, contamination, decisions, integrity, matching, prefix, progress, ranking, scoring, timeline

random.seed(42)
BASE = {"v1": 3.5, "v2": 4.0, "v3": 4.2, "v4": 3.8}


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(42)
    rows = [(v, f"t{t}", r, f"d_{v}_t{t}_{r}", f"r_{v}_t{t}_{r}", min(5.0, max(1.0, m + rng.gauss(0, 0.3))), ["simple", "medium", "complex"][t]) for v, m in BASE.items() for t in range(3) for r in range(3)]
    return spark.createDataFrame(rows, "variant_id string, task_id string, repetition int, design_id string, run_id string, overall_median double, complexity string").cache()


@pytest.fixture(scope="module")
def costs(spark):
    rng = random.Random(1)
    rows = [(v, f"r_{v}_t{t}_{r}", c + rng.gauss(0, 0.02), 1000, 500) for v, c in {"v1": 0.1, "v2": 0.15, "v3": 0.2, "v4": 0.12}.items() for t in range(3) for r in range(3)]
    return spark.createDataFrame(rows, "variant_id string, run_id string, total_cost_usd double, total_input_tokens long, total_output_tokens long").cache()


def test_friedman_and_ranks(scores):
    row = ranking.with_friedman_p(ranking.friedman(scores)).first()
    assert row["k"] == 4 and row["n_blocks"] == 9 and row["q"] > 0 and 0 <= row["p_value"] <= 1
    ranks = ranking.mean_ranks(scores).collect()
    assert len(ranks) == 4 and sum(r["mean_rank"] for r in ranks) == pytest.approx(10)


def test_friedman_needs_three(scores):
    assert ranking.friedman(scores.where("variant_id in ('v1', 'v2')")).count() == 0
    assert ranking.friedman(scores.limit(0)).count() == 0


def test_incomplete_blocks_are_left_out(scores):
    holes = scores.where("not (variant_id = 'v1' and task_id = 't0' and repetition = 0)")
    assert ranking.friedman(holes).first()["n_blocks"] == 8
    assert ranking.wilcoxon(holes, complete_only=False, pairs=[("v2", "v3")], family=None).first()["n"] == 9


def test_comparisons(scores):
    base = ranking.wilcoxon(scores, baseline="v1").collect()
    assert len(base) == 3 and all(r["variant_a"] == "v1" and 0 <= r["p_adjusted"] <= 1 for r in base)
    assert ranking.wilcoxon(scores).count() == 6
    assert ranking.wilcoxon(scores.limit(0)).count() == 0


def test_effects_without_a_difference(spark):
    rows = [(v, "t", r, f"{v}{r}", 2.0) for v in "ab" for r in range(4)]
    df = spark.createDataFrame(rows, "variant_id string, task_id string, repetition int, design_id string, overall_median double")
    r = ranking.wilcoxon(df).first()
    assert (r["p_value"], r["effect_compat"], r["effect"], r["zeros"]) == (1.0, 1.0, 0.0, 4)
    assert ranking.cohens_d(df).first()["cohens_d"] == 0


def test_axis_and_parents(spark, scores):
    got = {r["axis"]: r for r in ranking.with_mann_whitney_p(ranking.axis_effects(scores)).collect()}
    assert set(got) == set(ranking.AXES) and got["dynamics"]["n_first"] == 9
    names = spark.createDataFrame([("v2a_same",), ("v10",), ("x",), (None,)], "v string").select(ranking.parent_variant(F.col("v"))).collect()
    assert [r[0] for r in names] == ["v2", "v10", None, None]


PARETO = [
    ([("v1", 3.0, 0.10), ("v2", 4.0, 0.20), ("v3", 3.5, 0.15), ("v4", 4.5, 0.30)], {"v1", "v2", "v3", "v4"}),
    ([("v1", 4.0, 0.10)], {"v1"}),
    ([], set()),
    ([("v1", 4.0, 0.10), ("v2", 4.0, 0.20), ("v3", 4.0, 0.30)], {"v1"}),
    ([("v1", 4.0, 0.10), ("v2", 3.0, 0.20)], {"v1"}),
    ([("v1", 3.0, 0.10), ("v2", 4.0, 0.10)], {"v2"}),
    ([("v1", None, 0.10), ("v2", float("nan"), 0.05), ("v3", 1.0, 0.2)], {"v3"}),
]


@pytest.mark.parametrize("rows,want", PARETO)
def test_pareto(spark, rows, want):
    df = spark.createDataFrame(rows, "variant_id string, mean_score double, mean_cost double")
    assert {r["variant_id"] for r in analysis.pareto(df).where("on_frontier").collect()} == want


def test_variance_and_reports(scores, costs):
    one = analysis.variance(scores.where("design_id = 'd_v1_t0_0'")).first()
    assert (one["std_score"], one["cv"]) == (0, 0)
    assert analysis.descriptive(scores, costs).count() == 4 * 4
    assert analysis.token_efficiency(scores, costs).count() == 4
    assert analysis.budget_simulation(scores, costs, [0.01, 100.0]).count() == 4
    assert {r["label"] for r in analysis.case_studies(scores, 2).collect()} >= {"top", "bottom"}
    assert 0 < analysis.eta_squared(scores).first()["eta_squared"] < 1


def test_framework(scores, costs):
    out = decisions.framework(scores, costs).collect()
    assert {r["complexity"] for r in out} == {"simple", "medium", "complex"}
    assert all(r["budget"] in ("low", "moderate", "any") and r["confidence"] in ("high", "medium", "low") for r in out)
    rates = scores.select("variant_id", "design_id", F.lit(0.7).alias("coherence_rate"))
    assert decisions.framework(scores, costs, rates).where("not coherence_warning").count() == 0
    told = decisions.predictions(scores, scores.limit(0).select("variant_id", F.lit("x").alias("dimension"), F.col("overall_median").alias("score")), rates).collect()
    assert [r["prediction"] for r in sorted(told, key=lambda r: r["prediction"])] == [f"P{i}" for i in range(1, 9)]


def test_alpha(spark):
    def alpha(rows):
        return scoring.ordinal_alpha(spark.createDataFrame(rows, "design_id string, dimension string, score double")).first()["alpha"]

    agreed = [("d", f"u{u}", float(u)) for u in range(4) for _ in range(3)]
    assert alpha(agreed) == pytest.approx(1)
    assert alpha([("d", "u", 1.0), ("d", "u", 1.0)]) is None
    # Two raters, values 1 2 / 1 2 / 2 1: observed and expected by hand.
    rows = [("d", u, v) for u, v in [("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", 1.0), ("c", 2.0)]]
    assert alpha(rows) == pytest.approx(1 - (6 - 1) * 1 / (3 * 3))


def test_alpha_proxy_and_medians(spark):
    df = spark.createDataFrame([("d", "a", 1.0), ("d", "a", 1.0), ("d", "b", 1.0), ("d", "b", 1.0), ("e", "a", 1.0)], "design_id string, dimension string, score double")
    got = {r["design_id"]: r["alpha"] for r in scoring.alpha_proxy(df).collect()}
    assert got == {"d": 1.0}
    assert scoring.overall_medians(spark.createDataFrame([("d", None), ("d", 4.0)], "design_id string, overall_score double")).first()[1] == 2.0


def test_json_scores(spark):
    rows = [("a", json.dumps([{"dimension": "q", "score": 4, "blockers": ["x"]}, {"score": 3}])), ("b", json.dumps({"q": {"score": 2}})), ("c", json.dumps({"q": 1.5})), ("d", "{broken"), ("e", None)]
    got = {(r["design_id"], r["dimension"]): r["score"] for r in scoring.scores_from_json(spark.createDataFrame(rows, "design_id string, j string"), "j", ["design_id"]).collect()}
    assert got == {("a", "q"): 4.0, ("a", ""): 3.0, ("b", "q"): 2.0, ("c", "q"): 1.5}


def test_overlap(spark):
    schema = "trace_id string, run_id string, started_us long, ended_us long"
    cross = spark.createDataFrame([("a", "r", 0, 2), ("b", "r", 1, 3), ("c", "s", 0, 9), ("z", "r", None, 5)], schema)
    assert [(r["anchor"], r["other"]) for r in timeline.overlap_pairs(cross, 2).collect()] == [("a", "b")]
    touching = spark.createDataFrame([("a", "r", 0, 1), ("b", "r", 1, 2)], schema)
    assert timeline.parallel_groups(touching).count() == 0
    assert timeline.islands(cross.where("started_us is not null")).count() == 2


def test_pending(spark):
    matrix = progress.expected(spark, ["v1"], ["t1"], [0, 1, 2])
    runs = spark.createDataFrame([("a", "v1", "t1", 0, "completed"), ("b", "v1", "t1", 1, "completed"), ("c", "v1", "t1", 2, "failed")], "run_id string, variant_id string, task_id string, repetition long, status string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "run_id string")
    got = {r["repetition"]: (r["generate"], r["evaluate"], r["coherence"]) for r in progress.pending(matrix, runs, ids("a"), ids("a", "b")).collect()}
    assert got == {0: (False, False, False), 1: (False, True, False), 2: (True, True, True)}
    assert progress.pending(matrix, runs, ids("a"), ids("a"), force=True).where("generate and evaluate and coherence").count() == 3
    got = {r["repetition"]: r["decision"] for r in progress.admission(matrix, runs).collect()}
    assert got == {0: "reject_completed", 1: "reject_completed", 2: "reject_existing"}
    assert progress.admission(matrix, runs, force=True).where("decision = 'rerun'").count() == 3


def test_sampling_is_stable(scores):
    one = progress.stratified_sample(scores, "variant_id", "design_id", 0.3).select("design_id").collect()
    two = progress.stratified_sample(scores.repartition(7), "variant_id", "design_id", 0.3).select("design_id").collect()
    assert sorted(one) == sorted(two) and len(one) == 4 * 2


def test_parsing(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert one(parsing.verdict(F.lit("so: verdict: Accept."))) == "accept" and one(parsing.verdict(F.lit("none"))) == "reject"
    for text, want in [('{"a": 1}', '{"a": 1}'), ('x\n```json\n{"a": 1}\n```', '{"a": 1}'), ('x {"a": 1} y', '{"a": 1}'), ('{"a": ', None), ("", None)]:
        assert one(parsing.json_text(F.lit(text))) == want
    score, found = parsing.quick_score(F.lit("final rating: 12"))
    assert (one(score), one(found)) == (10.0, True)
    score, found = parsing.quick_score(F.lit("no number"))
    assert (one(score), one(found)) == (5.0, False)
    assert one(parsing.iso_micros(F.lit("2025-01-01T00:00:00.5+00:00"))) == 1735689600500000 and one(parsing.iso_micros(F.lit("bad"))) is None
    assert one(parsing.left_variables(F.lit("{{ review }} {{x}} {{round}}"))) == ["review", "round"]
    assert one(parsing.normal_pair(F.lit("a <-> b"))) == "a|b"


def test_call_seed(spark):
    import hashlib

    want = int(hashlib.md5(b"v1_t1_0_a_2").hexdigest(), 16) % 2**31
    assert spark.range(1).select(progress.call_seed(*[F.lit(x) for x in ("v1", "t1", 0, "a", 2)])).first()[0] == want


def test_contamination(spark):
    s = "x" * 10 + "a snippet of forty characters or so, long enough" + "y" * 5
    prompts = spark.createDataFrame([(1, "a", "pre " + s + " post"), (2, "b", s), (3, "a", "clean"), (4, "a", None)], "prompt_id long, task_id string, text string")
    snippets = spark.createDataFrame([("b", s), ("c", "clean"), ("d", None)], "task_id string, snippet string")
    assert {tuple(r) for r in contamination.contamination(prompts, snippets).collect()} == {(1, "b"), (3, "c")}


def test_fingerprints_first_come(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "é")], "request_id long, text string")
    b = spark.createDataFrame([(9, "x"), (8, "x"), (7, "")], "reply_id long, text string")
    assert {tuple(r) for r in matching.by_fingerprint(a, b).collect()} == {(1, 8), (2, 9), (3, None), (4, 7)}


def test_novelty(spark):
    df = spark.createDataFrame([("g", [1.0, 0.0]), ("g", [0.0, 2.0]), ("g", [1.0, 1.0]), ("h", [1.0, 1.0]), ("z", [0.0, 0.0]), ("z", [1.0, 0.0])], "k string, embedding array<float>")
    got = {r["k"]: r["mean_similarity"] for r in analysis.novelty(df, ["k"]).collect()}
    assert got["g"] == pytest.approx(2 * 0.7071 / 3, abs=1e-3) and got["z"] == 0 and "h" not in got


def test_staged_run(spark):
    """Stages work on what is pending, the analysis waits for all, and a cost cap stops generation only."""
    matrix = progress.expected(spark, ["v1"], ["t1"], [0, 1, 2])
    schema = "run_id string, variant_id string, task_id string, repetition long, status string, total_cost_usd double"
    runs, scored, checked, log = [("a", "v1", "t1", 0, "completed", 2.0)], [], ["a"], []
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "run_id string")
    state = lambda: (spark.createDataFrame(runs, schema), ids(scored), ids(checked))
    name = lambda r: {(x[1], x[2], x[3]): x[0] for x in runs}[r["variant_id"], r["task_id"], r["repetition"]]

    def generate(work):
        for r in work.collect():
            log.append(("generate", r["repetition"]))
            runs.append((f"n{r['repetition']}", *r, "completed" if r["repetition"] == 1 else "failed", 2.0))

    def evaluate(work):
        scored.extend(name(r) for r in work.collect())

    def coherence(work):
        checked.extend(name(r) for r in work.collect())

    go = lambda **more: progress.staged_run(matrix, state, generate, evaluate, coherence, lambda: spark.range(1), **more)
    assert go(limit=2.0) is None and log == [] and scored == ["a"] and checked == ["a"]
    assert go(limit=100.0) is None and sorted(log) == [("generate", 1), ("generate", 2)] and sorted(scored) == sorted(checked) == ["a", "n1"]
    runs[:] = [r if r[0] != "n2" else (*r[:4], "completed", 2.0) for r in runs]
    assert go().count() == 1 and "n2" in scored


def test_running_sums(spark):
    """Sums over ranges are those of one window, over ties and lanes."""
    rng = random.Random(4)
    rows = [(k % 3 if k % 50 else None, float(rng.randrange(40)), k, rng.randrange(9)) for k in range(900)]
    df = spark.createDataFrame(rows, "lane int, x double, id long, v long").repartition(5)
    for lanes in (None, ["lane"]):
        got = {r["id"]: r["s"] for r in prefix.sums_before(df, ["x", "id"], F.col("v"), "s", lanes).collect()}
        seen = {}
        for lane, x, i, v in sorted(rows, key=lambda r: r[1:3]):
            key = lane if lanes else 0
            assert got[i] == seen.get(key, 0)
            seen[key] = seen.get(key, 0) + v
    assert prefix.sums_before(df.limit(0), ["x"], F.col("v"), "s").count() == 0


def test_ordinal_alpha_by_pairs(spark):
    """Against the definition over all pairs of values."""
    rng = random.Random(8)
    rows = [(f"d{d}", f"u{u}", float(rng.randrange(1, 6))) for d in range(6) for u in range(8) for _ in range(rng.randrange(0, 5))] + [("same", u, 2.0) for u in "aabb"]
    got = {r["design_id"]: r["alpha"] for r in scoring.ordinal_alpha(spark.createDataFrame(rows, "design_id string, dimension string, score double")).collect()}
    for d in {r[0] for r in rows}:
        units = {}
        for _, u, s in (r for r in rows if r[0] == d):
            units.setdefault(u, []).append(s)
        units = [v for v in units.values() if len(v) >= 2]
        values = [s for v in units for s in v]
        n = {c: values.count(c) for c in values}
        distance = lambda c, k: (sum(n[g] for g in n if min(c, k) <= g <= max(c, k)) - (n[c] + n[k]) / 2) ** 2  # noqa: B023, E731
        observed = sum(distance(a, b) / (len(v) - 1) for v in units for i, a in enumerate(v) for j, b in enumerate(v) if i != j) / max(1, len(values))
        total = sum(distance(a, b) for i, a in enumerate(values) for j, b in enumerate(values) if i != j)
        want = None if not total else 1 - observed / (total / (len(values) * (len(values) - 1)))
        assert got[d] is None if want is None else got[d] == pytest.approx(want, abs=1e-9)


def test_ordinal_alpha_deals_rows_once_to_enough_tasks(spark, monkeypatch):
    monkeypatch.setattr(scoring, "ROWS_IN_TASK", 100)
    rows = spark.range(1000).selectExpr("id div 20 as design_id", "concat('u', id % 4) as dimension", "cast(id % 7 as double) as score")
    out = scoring.ordinal_alpha(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and ", 10)" in plan.split("Exchange")[1]
    assert out.where("alpha is not null").count() == 50


def test_targeted_pairs_by_complexity(spark):
    """All eight pairs, overall and in each complexity, equal the tests of the stratum alone."""
    from trialforge.plans.statistics import TARGETED

    rng = random.Random(21)
    variants = sorted({v for a, b, _ in TARGETED.values() for v in (a, b)})
    levels = {"t1": "simple", "t2": "simple", "t3": "medium", "t4": "complex", "t5": None}
    rows = [(v, t, r, f"d{v}{t}{r}", round(3 + 0.1 * i + rng.gauss(0, 0.4), 2), c) for i, v in enumerate(variants) for t, c in levels.items() for r in range(2 if t == "t4" else 5)]
    rows = [r for r in rows if (r[0], r[1], r[2]) != ("v8", "t1", 0)]  # an incomplete block
    df = spark.createDataFrame(rows, "variant_id string, task_id string, repetition int, design_id string, overall_median double, complexity string")
    pairs = [v[:2] for v in TARGETED.values()]
    got = {(r["stratum"], r["variant_a"], r["variant_b"]): r for r in ranking.targeted(df, pairs).collect()}
    assert {k[0] for k in got} == {"all", "simple", "medium"}  # complex has two blocks
    for stratum in ("all", "simple", "medium"):
        own = df if stratum == "all" else df.where(f"complexity = '{stratum}'")
        want = ranking.wilcoxon(own, pairs=pairs, family=8 if stratum == "all" else None).collect()
        assert len(want) == 8
        for w in want:
            g = got[stratum, w["variant_a"], w["variant_b"]]
            assert all(abs(g[c] - w[c]) < 1e-12 for c in ("n", "w_plus", "w_minus", "p_value", "p_adjusted", "mean_diff"))
    a, b = ([r[4] for r in rows if r[0] == v and r[5] == "medium"] for v in ("v1", "v2a"))
    mean = lambda x: sum(x) / len(x)
    s2 = [sum((y - mean(x)) ** 2 for y in x) / (len(x) - 1) for x in (a, b)]
    assert abs(got["medium", "v1", "v2a"]["cohens_d"] - (mean(a) - mean(b)) / (sum(s2) / 2) ** 0.5) < 1e-9


def test_numbers_over_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(50), rng.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x long, g string").repartition(5)
    for order, lanes in ((["x", "id"], ["g"]), (["id"], None)):
        groups = {}
        for i, x, g in sorted(rows, key=lambda r: (r[1], r[0]) if order[0] == "x" else r[0]):
            groups.setdefault(g if lanes else None, []).append(i)
        want = {i: k + 1 for ids in groups.values() for k, i in enumerate(ids)}
        assert {r["id"]: r["n"] for r in prefix.numbered(df, order, "n", lanes).collect()} == want
        after = {i: (ids[k + 1] if k + 1 < len(ids) else None) for ids in groups.values() for k, i in enumerate(ids)}
        assert {r["id"]: r["next_id"] for r in prefix.followed(df, order, ["id"], lanes).collect()} == after
    text = df.withColumn("name", F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 4, "0")))
    assert {r["id"]: r["n"] for r in prefix.numbered(text, ["name"], "n").collect()} == {i: i + 1 for i in range(500)}


@pytest.mark.parametrize("n", [0, 10, 20])
def test_details_by_table_function(spark, sf, n):
    """The table function, called from SQL, gives what the DataFrame gives, for all checks."""
    from trialforge.plans import checks, reports

    told = reports.failures(spark, sf).cache()
    assert {r[0] for r in told.select("check_name").distinct().collect()} <= set(checks.CHECKS) == set(reports._TOLD)
    integrity.register_details(spark, told, "all_failures", "details_of")
    got = spark.sql(f"SELECT * FROM details_of(TABLE(all_failures) PARTITION BY (check_name) ORDER BY (detail), {n})")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, integrity.first_details(told, n).collect()))
    counts = {r["check_name"]: r["failures"] for r in checks.check_all(spark, sf).collect()}
    assert {r["check_name"]: r["count"] for r in told.groupBy("check_name").count().collect()} == {k: v for k, v in counts.items() if v}
    told.unpersist()
