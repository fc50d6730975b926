"""Queries with an order, details of checks, retries, providers, stages.

An ordered result has the rank of each row in `place`, so that its order is part of its rows; ranks are over rows of
variants, or of a top-k report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialforge.functions import parsing
from trialforge.operators import analysis, decisions, integrity, progress, scoring, timeline
from trialforge.plans import checks
from trialforge.plans.progress import _PENDING, _STATE, _checked, _scored, matrix
from trialforge.plans.registry import query, rounded, sql
from trialforge.plans.scores import BUDGETS, blocker_union, longs
from trialforge.plans.statistics import _FRAMEWORK, _P, _coherent
from trialforge.plans.traces import _BATCHED, _LOG, MINUTE, requests
from trialforge.sources import adapter as A
from trialforge.sources import store
from trialforge.streaming import microbatch


def placed(df: DataFrame, *order) -> DataFrame:
    """df in order, with `place` from 1. df has a row for each variant, or few."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).orderBy("place")


@query(sql("SELECT variant_id, task_id, repetition, design_id, row_number() OVER (ORDER BY variant_id, task_id, repetition, design_id) AS place FROM (SELECT * FROM scores ORDER BY variant_id, task_id, repetition, design_id LIMIT 200)", "scores"))
def score_view_head(spark, sf):
    """The first 200 rows of the score view, in the loaders' order."""
    order = ["variant_id", "task_id", "repetition", "design_id"]
    return placed(A.score_view(spark, sf).select(*order).orderBy(*order).limit(200), *order)


@query(sql("SELECT variant_id, round(cv, 6) AS cv, row_number() OVER (ORDER BY round(cv, 9), variant_id) AS place FROM (SELECT variant_id, stddev_samp(overall_median) / avg(overall_median) AS cv FROM scores GROUP BY 1)", "scores"))
def variance_order(spark, sf):
    """Variants from the steadiest to the least steady."""
    out = analysis.variance(A.score_view(spark, sf)).select("variant_id", "cv")
    return rounded(placed(out, F.round("cv", 9), "variant_id"))


@query(sql("SELECT variant_id, round(q / c, 6) AS quality_per_dollar, row_number() OVER (ORDER BY round(q / c, 12) DESC, variant_id) AS place FROM (SELECT variant_id, avg(overall_median) AS q, avg(total_cost_usd) AS c FROM scores JOIN (SELECT run_id, total_cost_usd FROM costs) USING (run_id) GROUP BY 1)", "scores", "costs"))
def efficiency_order(spark, sf):
    """Variants by quality for a dollar, best first."""
    out = analysis.token_efficiency(A.score_view(spark, sf), A.cost_view(spark, sf)).select("variant_id", "quality_per_dollar")
    return rounded(placed(out, F.round("quality_per_dollar", 12).desc(), "variant_id"))


@query(sql("SELECT dimension, round(delta, 6) AS delta, row_number() OVER (ORDER BY round(abs(delta), 9) DESC, dimension) AS place FROM (SELECT dimension, avg(score) FILTER (variant_id = 'v5') - avg(score) FILTER (variant_id = 'v1') AS delta FROM longs JOIN (SELECT design_id, variant_id FROM scores) USING (design_id) GROUP BY 1)", "scores", "longs"))
def delta_order(spark, sf):
    """Dimensions by how much two variants differ in them."""
    rows = longs(spark, sf).join(A.score_view(spark, sf).select("design_id", "variant_id"), "design_id")
    side = lambda v: F.avg(F.when(F.col("variant_id") == v, F.col("score")))
    return rounded(placed(rows.groupBy("dimension").agg((side("v5") - side("v1")).alias("delta")), F.round(F.abs("delta"), 9).desc(), "dimension"))


@query(
    sql(
        "SELECT budget, variant_id, n_runs, round(q, 6) AS mean_score, row_number() OVER (ORDER BY budget, round(q, 9) DESC, variant_id) AS place FROM (SELECT budget, variant_id, CAST(floor(budget / c) AS BIGINT) AS n_runs, q FROM (SELECT variant_id, avg(overall_median) AS q, avg(total_cost_usd) AS c FROM scores JOIN (SELECT run_id, total_cost_usd FROM costs) USING (run_id) GROUP BY 1), (VALUES (100000.0::DOUBLE), (500000.0::DOUBLE), (2000000.0::DOUBLE)) v(budget) WHERE budget >= c)",
        "scores",
        "costs",
    )
)
def budget_order(spark, sf):
    """What each budget buys, the smallest budget first and in it the best quality."""
    out = analysis.budget_simulation(A.score_view(spark, sf), A.cost_view(spark, sf), BUDGETS).select("budget", "variant_id", "n_runs", "mean_score")
    return rounded(placed(out, "budget", F.round("mean_score", 9).desc(), "variant_id"))


@query(
    sql(
        "SELECT variant_id, n, round(mean_blockers, 6) AS mean_blockers, total_blockers, row_number() OVER (ORDER BY round(mean_blockers, 9), variant_id) AS place FROM (SELECT variant_id, count(*) AS n, avg(coalesce(c, 0)) AS mean_blockers, CAST(sum(coalesce(c, 0)) AS BIGINT) AS total_blockers FROM scores LEFT JOIN (SELECT l_orderkey AS design_id, count(*) AS c FROM lineitem WHERE l_discount > 0.07 GROUP BY 1) USING (design_id) GROUP BY 1)",
        "scores",
    )
)
def blockers_order(spark, sf):
    """Variants from the fewest to the most blockers of a design."""
    return rounded(placed(scoring.blocker_means(A.score_view(spark, sf), blocker_union(spark, sf)), F.round("mean_blockers", 9), "variant_id"))


_BUDGETS = "CASE budget WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END"


@query(sql(f"SELECT complexity, budget, variant_id, row_number() OVER (ORDER BY complexity, {_BUDGETS}, variant_id) AS place FROM ({_FRAMEWORK})", "scores", "costs", "coherence", p=_P))
def framework_order(spark, sf):
    """Recommendations by complexity and budget, as the report lists them."""
    out = decisions.framework(A.score_view(spark, sf), A.cost_view(spark, sf), _coherent(spark, sf), confidence=False).select("complexity", "budget", "variant_id")
    return placed(out, "complexity", F.expr(_BUDGETS), "variant_id")


@query(sql("SELECT run_id, cost, row_number() OVER (ORDER BY cost DESC, run_id) AS place FROM (SELECT run_id, round(sum(cost_usd), 6) AS cost FROM traces GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)", "traces"))
def timeline_by_cost(spark, sf):
    """The twenty dearest runs."""
    out = timeline.run_totals(A.traces(spark, sf)).select("run_id", F.round("total_cost", 6).alias("cost"))
    return placed(out.orderBy(F.col("cost").desc(), "run_id").limit(20), F.col("cost").desc(), "run_id")


@query(sql("SELECT run_id, tokens, row_number() OVER (ORDER BY tokens DESC, run_id) AS place FROM (SELECT run_id, total_input_tokens + total_output_tokens AS tokens FROM runs ORDER BY 2 DESC, 1 LIMIT 20)", "runs"))
def timeline_by_tokens(spark, sf):
    """The twenty runs with the most tokens."""
    out = A.runs(spark, sf).select("run_id", (F.col("total_input_tokens") + F.col("total_output_tokens")).alias("tokens"))
    return placed(out.orderBy(F.col("tokens").desc(), "run_id").limit(20), F.col("tokens").desc(), "run_id")


_DETAILED = {
    "empty_prompts": ("run_id", "SELECT run_id FROM messages WHERE agent_role = 'user' AND (text IS NULL OR trim(text) = '')"),
    "prompt_growth": ("run_id", "SELECT run_id FROM (SELECT *, lag(size) OVER (PARTITION BY run_id ORDER BY round) AS before FROM (SELECT run_id, round, max(length(text)) AS size FROM messages GROUP BY ALL)) WHERE size < 0.5 * before"),
    "evaluation_coverage": ("design_id", "SELECT run_id FROM runs LEFT JOIN evaluations e ON e.design_id = run_id WHERE status = 'completed' GROUP BY run_id HAVING count(e.design_id) < 3"),
    "coherence_fields": ("design_id", "SELECT design_id FROM checks WHERE section_pair IS NULL OR trim(section_pair) = '' UNION ALL SELECT design_id FROM checks WHERE explanation IS NULL OR trim(explanation) = ''"),
}


@query(sql(" UNION ALL ".join(f"(SELECT '{name}' AS check_name, '{c} ' || x AS detail FROM (SELECT CAST({'design_id' if 'FROM checks' in q else 'run_id'} AS VARCHAR) AS x FROM ({q})) ORDER BY detail LIMIT 10)" for name, (c, q) in _DETAILED.items()), "messages", "runs", "evaluations", "checks"))
def check_details(spark, sf):
    """The first ten failures of each of some checks."""
    one = lambda name, c: integrity.details(checks.CHECKS[name][0](spark, sf), F.concat(F.lit(f"{c} "), F.col(c).cast("string"))).select(F.lit(name).alias("check_name"), "detail")
    return reduce(DataFrame.unionAll, [one(name, c) for name, (c, _) in _DETAILED.items()])


#: The columns that tell a failure of each check, and the failures as SQL, by the same columns.
_LEFT_OPEN = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || ' {{ review }}' WHEN doc_id % 9 = 1 THEN text || ' {{order_id}}' ELSE text END AS p FROM documents"
_TOLD = {
    "template_variables": (["doc_id"], f"SELECT doc_id FROM ({_LEFT_OPEN}) WHERE regexp_matches(p, '{checks._VARIABLE}')"),
    "empty_prompts": (["run_id", "round"], "SELECT run_id, round FROM messages WHERE agent_role = 'user' AND (text IS NULL OR trim(text) = '')"),
    "empty_responses": (["run_id", "round"], "SELECT run_id, round FROM messages WHERE agent_role = 'assistant' AND (text IS NULL OR trim(text) = '')"),
    "system_name": (["run_id", "round", "agent_role"], "SELECT run_id, round, agent_role FROM messages WHERE round = 0 AND text IS NOT NULL AND NOT contains(lower(text), CASE run_id % 2 WHEN 0 THEN 'the' ELSE 'die' END)"),
    "perspective_injection": (["doc_id"], f"SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND text IS NOT NULL AND {checks._words('text', parsing.PERSPECTIVE_WORDS)} = 0"),
    "review_has_prior_design": (["run_id", "round"], f"SELECT m.run_id, m.round FROM messages m JOIN ({checks._TEXTS.format(700)}) d ON d.run_id = m.run_id AND d.round + 1 = m.round WHERE m.agent_role = 'user' AND NOT contains(m.text, substr(d.text, 501, 200))"),
    "revision_has_review": (["run_id", "round"], f"WITH d AS ({checks._TEXTS.format(300)}) SELECT m.run_id, m.round FROM messages m LEFT JOIN d a ON a.run_id = m.run_id AND a.round = m.round LEFT JOIN d b ON b.run_id = m.run_id AND b.round + 1 = m.round WHERE NOT contains(m.text, substr(coalesce(a.text, b.text), 101, 200))"),
    "prompt_growth": (["run_id", "round"], "SELECT run_id, round FROM (SELECT *, lag(size) OVER (PARTITION BY run_id ORDER BY round) AS before FROM (SELECT run_id, round, max(length(text)) AS size FROM messages GROUP BY ALL)) WHERE size < 0.5 * before"),
    "design_words": (["doc_id"], f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND {checks._words('text', parsing.DESIGN_WORDS)} < 2"),
    "review_has_generation": (["run_id", "round"], f"SELECT m.run_id, m.round FROM messages m JOIN ({checks._TEXTS.format(300)}) d ON d.run_id = m.run_id AND d.round = m.round WHERE NOT contains(m.text, substr(d.text, 101, 200))"),
    "parallel_agents_differ": (["run_id", "step"], "SELECT run_id, step FROM traces GROUP BY run_id, step HAVING count(*) >= 2 AND count(DISTINCT props) = 1"),
    "evaluation_values": (["event_id"], "SELECT event_id FROM events WHERE value > 10 OR event_id % 7 = 0"),
    "evaluation_coverage": (["design_id"], "SELECT run_id AS design_id FROM runs LEFT JOIN evaluations e ON e.design_id = run_id WHERE status = 'completed' GROUP BY run_id HAVING count(e.design_id) < 3"),
    "coherence_fields": (["design_id", "field"], "SELECT design_id, 'section_pair' AS field FROM checks WHERE section_pair IS NULL OR trim(section_pair) = '' UNION ALL SELECT design_id, 'explanation' FROM checks WHERE explanation IS NULL OR trim(explanation) = ''"),
    "context_chain": (["run_id", "round"], "SELECT l.run_id, l.round FROM (SELECT run_id, round, arg_max(text, (agent_role, round)) AS text FROM messages WHERE text IS NOT NULL GROUP BY ALL) l JOIN (SELECT run_id, round, lead(round) OVER (PARTITION BY run_id ORDER BY round) AS next FROM (SELECT DISTINCT run_id, round FROM messages)) n USING (run_id, round) LEFT JOIN messages q ON q.run_id = l.run_id AND q.round = n.next WHERE n.next IS NOT NULL AND length(l.text) >= 200 GROUP BY l.run_id, l.round HAVING NOT coalesce(bool_or(contains(q.text, substr(l.text, 1, 200))), false)"),
    "cross_task_contamination": (["prompt_id", "task_id"], f"WITH s AS ({checks._SNIPPETS}), d AS ({checks._PROMPTS}) SELECT doc_id AS prompt_id, task_id FROM ({checks._MET})"),
}


def _detail_sql(columns: list[str]) -> str:
    return " || ' ' || ".join(f"'{c} ' || {c}" for c in columns)


def failures(spark, sf):
    """check_name, detail of every failure of every check."""

    def one(name: str, columns: list[str]) -> DataFrame:
        failed = checks.check_contamination(spark, sf) if name == "cross_task_contamination" else checks.CHECKS[name][0](spark, sf).where("failed")
        return failed.select(F.lit(name).alias("check_name"), F.concat_ws(" ", *[F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in columns]).alias("detail"))

    return reduce(DataFrame.unionAll, [one(name, columns) for name, (columns, _) in _TOLD.items()])


_FAILURES = " UNION ALL ".join(f"SELECT '{name}' AS check_name, {_detail_sql(columns)} AS detail FROM ({q})" for name, (columns, q) in _TOLD.items())


@query(sql("SELECT check_name, detail, place FROM (SELECT *, row_number() OVER (PARTITION BY check_name ORDER BY detail) AS place FROM f) WHERE place <= 20", "messages", "runs", "evaluations", "checks", "traces", f=_FAILURES))
def check_details_of_all(spark, sf):
    """The first twenty failures of every check, by the table function from SQL."""
    told = failures(spark, sf)
    integrity.register_details(spark, integrity.first_details(told, 20).drop("place"))
    return spark.sql("SELECT * FROM check_details(TABLE(SELECT * FROM check_failures) PARTITION BY (check_name) ORDER BY (detail), 20)")


@query(sql("SELECT key, CAST(sum(least(f, 3)) AS BIGINT) AS retries, count(*) FILTER (f > 3) AS exhausted, round(sum(0.5 * (pow(2.0, least(f, 3)) - 1)), 6) AS longest_wait FROM (SELECT *, (size * 7 + batch * 3 + slot) % 6 AS f FROM l) GROUP BY key", "traces", b=_BATCHED, l=_LOG))
def retry_stats(spark, sf):
    """Retries of batches that fail a given number of times: doubling delays from half a second, three retries at most."""
    log = microbatch.flush_log(microbatch.flushes(requests(spark, sf), "key", 15 * MINUTE, 2), "key")
    failures = (F.col("size") * 7 + F.col("batch") * 3 + F.col("slot")) % 6
    return rounded(microbatch.retry_stats(microbatch.retry_log(log, failures, 3, 0.5), "key"))


@query(sql("SELECT agent_role AS provider, step AS model, count(*) AS requests, CAST(sum(k) AS BIGINT) AS tokens, round(sum(cost_usd), 6) AS cost, arg_min(CASE WHEN k % 3 = 0 THEN k * 10 END, trace_id) FILTER (k % 3 = 0) AS limit_rpm, arg_max(agent_id, trace_id) AS state FROM traces GROUP BY ALL", "traces"))
def provider_registry(spark, sf):
    """Providers by role and step: totals, the first limit told, the agent that came last."""
    told = F.when(F.col("k") % 3 == 0, F.col("k") * 10)
    rows = A.traces(spark, sf).select(F.col("agent_role").alias("provider"), F.col("step").alias("model"), F.col("k").alias("tokens"), F.col("cost_usd").alias("cost"), told.alias("told_limit"), F.col("agent_id").alias("state"), "trace_id")
    return rounded(microbatch.providers(rows, "trace_id"))


@query(sql("SELECT agent_role AS provider, chunk, count(*) AS n, min(trace_id) AS first, max(trace_id) AS last FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY agent_role ORDER BY trace_id) - 1) / 50) AS BIGINT) AS chunk FROM traces) GROUP BY ALL", "traces"))
def provider_chunks(spark, sf):
    """Collected requests as calls of one provider each."""
    return microbatch.by_provider(A.traces(spark, sf).select(F.col("agent_role").alias("provider"), "trace_id"), "provider", ["trace_id"], 50)


@query(sql("SELECT variant_id, task_id, repetition, CASE WHEN generate THEN 'generate' ELSE concat_ws('+', CASE WHEN evaluate THEN 'evaluate' END, CASE WHEN coherence THEN 'coherence' END) END AS ready FROM w", "runs", "evaluations", "checks", **_STATE, w=_PENDING))
def next_stages(spark, sf):
    """The stages of each triple that can start now."""
    return progress.next_stages(progress.pending(matrix(spark), A.runs(spark, sf), _scored(spark, sf), _checked(spark, sf)))


@query(sql("SELECT count(*) AS triples, count(*) FILTER (generate OR evaluate OR coherence) AS open, count(*) FILTER (generate OR evaluate OR coherence) = 0 AS analyse FROM w", "runs", "evaluations", "checks", **_STATE, w=_PENDING))
def stage_barrier(spark, sf):
    """Whether all is done that the analysis waits for."""
    return progress.barrier(progress.pending(matrix(spark), A.runs(spark, sf), _scored(spark, sf), _checked(spark, sf)))


@query(sql("SELECT 'evaluations' AS table_name, count(*) AS rows FROM evaluations WHERE design_id NOT IN (SELECT design_id FROM medians WHERE overall_median < 2) UNION ALL SELECT 'runs', count(*) FROM runs", "evaluations", "medians", "runs"))
def forget_results(spark, sf):
    """The evaluations of low designs deleted, to be made again; runs stay."""
    doomed = A.medians(spark, sf).where("overall_median < 2").select("design_id")
    left = store.without_results({"evaluations": A.evaluations(spark, sf), "runs": A.runs(spark, sf)}, doomed)
    return store.row_counts(left)


@query("SELECT event_id, epoch_us(ts) AS started_us, round((epoch_us(ts + to_microseconds(CAST(round(value * 1000) AS BIGINT))) - epoch_us(ts)) / 1000.0::DOUBLE, 3) AS duration_ms, event_id % 5 = 0 AS broken FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL, NULL, true FROM events WHERE event_id % 5 = 0")
def iso_times(spark, sf):
    """ISO time stamps as text, every fifth broken, as microseconds and durations."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    text = lambda t: F.date_format(F.timestamp_micros(t), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    rows = A.table(spark, sf, "events").select("event_id", us.alias("a"), (us + F.round(F.col("value") * 1000).cast("long")).alias("b"))
    broken = F.col("event_id") % 5 == 0
    rows = rows.select("event_id", F.when(broken, "not a time").otherwise(text(F.col("a"))).alias("start"), text(F.col("b")).alias("stop"), broken.alias("broken"))
    began = parsing.iso_micros(F.col("start"))
    return rows.select("event_id", began.alias("started_us"), F.round((parsing.iso_micros(F.col("stop")) - began) / 1000, 3).alias("duration_ms"), "broken")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'a+b' WHEN 1 THEN 'x+y;y+z' WHEN 2 THEN 'x+y;y+z' ELSE '' END AS pairs FROM part")
def section_pairs(spark, sf):
    """Pairs of sections to check: the evaluator's, else the rubric's, else none; a single section is no pair."""
    array = lambda *pairs: F.array(*[F.array(*map(F.lit, p)) for p in pairs])
    n = F.col("p_size") % 4
    none = F.lit(None).cast("array<array<string>>")
    own = F.when(n == 0, array(("a", "b"), ("c",))).when(n == 1, F.array().cast("array<array<string>>")).otherwise(none)
    rubric = F.when(n.isin(1, 2), array(("x", "y"), ("z",), ("y", "z"))).otherwise(none)
    pairs = parsing.section_pairs(own, rubric)
    return A.table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(pairs, lambda p: F.array_join(p, "+")), ";").alias("pairs"))
