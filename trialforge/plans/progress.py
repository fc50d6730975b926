"""Queries on stores, completeness, pending work, sampling and seeds."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialforge.operators import progress
from trialforge.plans.registry import ORACLE_SQL, query, rounded, sql
from trialforge.sources import adapter as A
from trialforge.sources import store
from trialforge.sources.scratch import scratch_dir, stored
from trialforge.streaming import counts

VARIANTS, TASKS, REPETITIONS = ["v1", "v2a", "v3b", "v4", "v5", "v6"], ["t0", "t1", "t2", "t3", "t4"], list(range(1995, 2003))
_MATRIX = "SELECT variant_id, task_id, repetition FROM (VALUES ('v1'), ('v2a'), ('v3b'), ('v4'), ('v5'), ('v6')) a(variant_id), (VALUES ('t0'), ('t1'), ('t2'), ('t3'), ('t4')) b(task_id), (SELECT unnest(range(1995, 2003)) AS repetition)"


def matrix(spark):
    return progress.expected(spark, VARIANTS, TASKS, REPETITIONS)


def _scored(spark, sf):
    """Runs whose designs are scored: those with two raters or more."""
    many = A.evaluations(spark, sf).groupBy("design_id").agg(F.count("*").alias("n")).where("n >= 2")
    return many.select(F.col("design_id").alias("run_id"), "design_id")


def _checked(spark, sf):
    """Runs whose designs are checked: those with three pairs or more."""
    many = A.coherence_checks(spark, sf).groupBy("design_id").agg(F.count("*").alias("n")).where("n >= 3")
    return many.select(F.col("design_id").alias("run_id"), "design_id")


_STATE = {"scored": "SELECT design_id AS run_id, design_id FROM evaluations GROUP BY design_id HAVING count(*) >= 2", "checked": "SELECT design_id AS run_id, design_id FROM checks GROUP BY design_id HAVING count(*) >= 3", "matrix": _MATRIX}


@query("SELECT 'customer' AS table_name, count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(spark, sf):
    return store.row_counts({t: A.table(spark, sf, t) for t in ("customer", "orders", "lineitem", "events")})


@query("SELECT max(o_orderkey) AS version FROM orders")
def schema_version(spark, sf):
    return A.table(spark, sf, "orders").agg(F.max("o_orderkey").alias("version"))


@query(
    """SELECT o_custkey AS key, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1"""
)
def upsert_latest(spark, sf):
    """Last write wins: the newest row of each key."""
    rows = A.table(spark, sf, "orders")
    return store.newest(rows, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select(F.col("o_custkey").alias("key"), "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def upsert_replace(spark, sf):
    """All orders, with those in one state written anew."""
    rows = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return store.upserted(rows, rows.where("status = 'P'").withColumn("status", F.lit("new")), ["key"])


@query("SELECT o_orderkey AS key, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderstatus ELSE 'new' END AS status FROM orders")
def insert_or_ignore(spark, sf):
    """All orders inserted into a table that has the urgent ones already."""
    rows = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), "o_orderpriority")
    return store.inserted(rows.where("o_orderpriority in ('1-URGENT', '2-HIGH')").select("key", "status"), rows.select("key", F.lit("new").alias("status")), ["key"])


@query("SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS priority, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS customer FROM orders")
def merge_import(spark, sf):
    """Exports of two nodes with different columns as one table; the first node, which has the finished orders, wins where keys meet."""
    rows = A.table(spark, sf, "orders")
    first = rows.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"))
    second = rows.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("customer"))
    return store.merged([first, second], ["key"])


@query(sql("SELECT 'runs' AS table_name, count(*) AS rows FROM runs WHERE status <> 'failed' UNION ALL SELECT 'evaluations', count(*) FROM evaluations WHERE design_id NOT IN (SELECT run_id FROM runs WHERE status = 'failed')", "runs", "evaluations"))
def cascade_delete(spark, sf):
    runs, evaluations = A.runs(spark, sf).select("run_id", "status"), A.evaluations(spark, sf)
    doomed = runs.where("status = 'failed'")
    left = store.without_runs({"runs": runs, "designs": runs.select("run_id", F.col("run_id").alias("design_id")), "evaluations": evaluations}, doomed)
    return store.row_counts({t: left[t] for t in ("runs", "evaluations")})


@query(sql("SELECT variant_id, task_id, repetition FROM (SELECT DISTINCT variant_id FROM runs), (SELECT DISTINCT task_id FROM runs), (SELECT DISTINCT repetition FROM runs)", "runs"))
def expected_matrix(spark, sf):
    """The matrix of what occurs in the runs."""
    return progress.expected_of(A.runs(spark, sf))


@query(sql("SELECT * FROM matrix EXCEPT SELECT variant_id, task_id, repetition FROM runs WHERE status = 'completed'", "runs", matrix=_MATRIX))
def missing_runs(spark, sf):
    return progress.missing_runs(matrix(spark), A.runs(spark, sf))


_PENDING = """SELECT m.variant_id, m.task_id, m.repetition, d.run_id IS NULL AS generate, d.run_id IS NULL OR d.run_id NOT IN (SELECT run_id FROM scored) AS evaluate, d.run_id IS NULL OR d.run_id NOT IN (SELECT run_id FROM checked) AS coherence
    FROM matrix m LEFT JOIN (SELECT variant_id, task_id, repetition, max(run_id) AS run_id FROM runs WHERE status = 'completed' GROUP BY ALL) d USING (variant_id, task_id, repetition)"""


@query(sql(_PENDING, "runs", "evaluations", "checks", **_STATE))
def pending_work(spark, sf):
    return progress.pending(matrix(spark), A.runs(spark, sf), _scored(spark, sf), _checked(spark, sf))


@query(sql("SELECT stage, CAST(sum(CAST(p AS INT)) AS BIGINT) AS pending, CAST(sum(CAST(NOT p AS INT)) AS BIGINT) AS done FROM (SELECT 'generate' AS stage, generate AS p FROM w UNION ALL SELECT 'evaluate', evaluate FROM w UNION ALL SELECT 'coherence', coherence FROM w) GROUP BY stage", "runs", "evaluations", "checks", **_STATE, w=_PENDING))
def stage_counts(spark, sf):
    return progress.stage_counts(pending_work(spark, sf))


@query(
    sql(
        """SELECT *, actual_runs / expected_runs AS run_coverage, round((final_designs - unevaluated) / final_designs, 6) AS evaluation_coverage, round((final_designs - unchecked) / final_designs, 6) AS coherence_coverage FROM (SELECT (SELECT count(*) FROM matrix) AS expected_runs, (SELECT count(*) FROM (SELECT DISTINCT variant_id, task_id, repetition FROM runs WHERE status = 'completed')) AS actual_runs,
        (SELECT count(*) FROM (SELECT * FROM matrix EXCEPT SELECT variant_id, task_id, repetition FROM runs WHERE status = 'completed')) AS missing_runs, (SELECT count(*) FROM runs WHERE status = 'completed') AS final_designs,
        (SELECT count(*) FROM runs WHERE status = 'completed' AND run_id NOT IN (SELECT design_id FROM scored)) AS unevaluated, (SELECT count(*) FROM runs WHERE status = 'completed' AND run_id NOT IN (SELECT design_id FROM checked)) AS unchecked)""",
        "runs",
        "evaluations",
        "checks",
        **_STATE,
    ).replace("actual_runs / expected_runs", "round(actual_runs / expected_runs, 6)")
)
def completeness(spark, sf):
    runs = A.runs(spark, sf)
    return rounded(progress.completeness(matrix(spark), runs, runs.select("run_id", F.col("run_id").alias("design_id")), _scored(spark, sf), _checked(spark, sf)))


@query(sql("SELECT run_id AS design_id FROM runs WHERE status = 'completed' AND run_id NOT IN (SELECT design_id FROM medians)", "runs", "medians"))
def unevaluated_designs(spark, sf):
    return A.runs(spark, sf).where("status = 'completed'").select(F.col("run_id").alias("design_id")).join(A.medians(spark, sf).select("design_id"), "design_id", "left_anti")


@query(sql("SELECT run_id AS design_id FROM runs WHERE status = 'completed' AND run_id NOT IN (SELECT design_id FROM checks)", "runs", "checks"))
def unchecked_designs(spark, sf):
    return A.runs(spark, sf).where("status = 'completed'").select(F.col("run_id").alias("design_id")).join(A.coherence_checks(spark, sf).select("design_id"), "design_id", "left_anti")


@query(sql("SELECT run_id AS design_id, variant_id FROM runs WHERE status = 'completed' AND EXISTS (SELECT 1 FROM evaluations e WHERE e.design_id = run_id)", "runs", "evaluations"))
def evaluated_designs(spark, sf):
    return A.runs(spark, sf).where("status = 'completed'").select(F.col("run_id").alias("design_id"), "variant_id").join(A.evaluations(spark, sf).select("design_id"), "design_id", "left_semi")


@query(sql("SELECT run_id AS design_id, count(e.design_id) AS n, count(e.design_id) < 3 AS failed FROM runs LEFT JOIN evaluations e ON e.design_id = run_id WHERE status = 'completed' GROUP BY run_id", "runs", "evaluations"))
def eval_coverage(spark, sf):
    from trialforge.operators import integrity

    return integrity.evaluation_coverage(A.runs(spark, sf).where("status = 'completed'").select(F.col("run_id").alias("design_id")), A.evaluations(spark, sf))


@query(sql("SELECT m.variant_id, m.task_id, m.repetition, CASE WHEN status IS NULL THEN 'run' WHEN status = 'completed' THEN 'reject_completed' ELSE 'rerun' END AS decision FROM matrix m LEFT JOIN (SELECT variant_id, task_id, repetition, arg_max(status, run_id) AS status FROM runs GROUP BY ALL) USING (variant_id, task_id, repetition)", "runs", matrix=_MATRIX))
def run_admission(spark, sf):
    return progress.admission(matrix(spark), A.runs(spark, sf), resume=True)


@query(sql("SELECT status, count(*) AS n, round(coalesce(sum(total_cost_usd), 0), 2) AS cost, count(DISTINCT variant_id) AS variants FROM runs GROUP BY status", "runs"))
def status_counts(spark, sf):
    return A.runs(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("total_cost_usd"), F.lit(0.0)), 2).alias("cost"), F.countDistinct("variant_id").alias("variants"))


@query(sql("SELECT variant_id, run_id, round(before, 2) AS spent_before FROM (SELECT *, coalesce(sum(total_cost_usd) OVER (PARTITION BY variant_id ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM runs) WHERE before <= 5000000", "runs"))
def within_budget(spark, sf):
    out = progress.within_budget(A.runs(spark, sf), 5_000_000.0, ["run_id"], lane="variant_id")
    return out.select("variant_id", "run_id", F.round("spent_before", 2).alias("spent_before"))


@query(sql("SELECT e.design_id, evaluator_run, round(total_cost_usd, 2) AS run_cost FROM evaluations e JOIN runs ON run_id = e.design_id WHERE status = 'completed'", "runs", "evaluations"))
def run_cost_by_design(spark, sf):
    costs = A.runs(spark, sf).where("status = 'completed'").select(F.col("run_id").alias("design_id"), F.round("total_cost_usd", 2).alias("run_cost"))
    return A.evaluations(spark, sf).select("design_id", "evaluator_run").join(costs, "design_id")


@query("SELECT o_custkey AS run_id, o_orderkey AS design_id, round FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS BIGINT) AS round, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_design(spark, sf):
    w = Window.partitionBy("o_custkey")
    rows = A.table(spark, sf, "orders").withColumn("round", F.dense_rank().over(w.orderBy("o_orderdate")).cast("long")).withColumn("n", F.row_number().over(w.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())))
    return rows.where("n = 1").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("design_id"), "round")


@query(sql("SELECT a.variant_id AS variant_a, b.variant_id AS variant_b FROM (SELECT DISTINCT variant_id FROM runs) a JOIN (SELECT DISTINCT variant_id FROM runs) b ON a.variant_id < b.variant_id", "runs"))
def variant_pairs(spark, sf):
    own = A.runs(spark, sf).select("variant_id").distinct()
    return own.select(F.col("variant_id").alias("variant_a")).join(own.select(F.col("variant_id").alias("variant_b")), F.col("variant_a") < F.col("variant_b"))


@query(sql("SELECT run_id FROM runs WHERE status = 'completed' EXCEPT SELECT design_id FROM medians", "runs", "medians"))
def ok_minus_fail(spark, sf):
    done = A.runs(spark, sf).where("status = 'completed'").select("run_id")
    return done.exceptAll(A.medians(spark, sf).select(F.col("design_id").alias("run_id")))


@query(sql("SELECT run_id, array_to_string(list_sort(list(DISTINCT evaluator_model)), ',') AS models FROM evaluations JOIN runs ON run_id = design_id GROUP BY run_id", "runs", "evaluations"))
def models_used(spark, sf):
    used = A.evaluations(spark, sf).groupBy(F.col("design_id").alias("run_id")).agg(F.array_join(F.array_sort(F.collect_set("evaluator_model")), ",").alias("models"))
    return used.join(A.runs(spark, sf).select("run_id"), "run_id")


@query(sql("SELECT design_id, max(overall_score) - min(overall_score) < 0.3 AS converged, arg_min(evaluator_run, (-overall_score, evaluator_run, rater_key)) AS winner FROM evaluations GROUP BY design_id", "evaluations"))
def consensus(spark, sf):
    """Whether the raters' scores lie within 0.3, and the rater of the best one (first on ties)."""
    e = A.evaluations(spark, sf)
    return e.groupBy("design_id").agg((F.max("overall_score") - F.min("overall_score") < 0.3).alias("converged"), F.min_by("evaluator_run", F.struct(-F.col("overall_score"), "evaluator_run", "rater_key")).alias("winner"))


@query(sql("SELECT variant_id, design_id FROM (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY md5(design_id::VARCHAR || '_42'), design_id) AS i, count(*) OVER (PARTITION BY variant_id) AS n FROM scores) WHERE i <= greatest(1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT))", "scores"))
def stratified_sample(spark, sf):
    return progress.stratified_sample(A.score_view(spark, sf), "variant_id", "design_id", 0.1).select("variant_id", "design_id")


@query(sql("SELECT variant_id, task_id, repetition, run_id, md5(concat_ws('_', variant_id, task_id, repetition, run_id, '42')) AS place FROM runs WHERE status = 'running'", "runs"))
def shuffled_runs(spark, sf):
    """What is left to run, in an order that is random but the same at every run: `place` is its sort key."""
    runs, by = A.runs(spark, sf).where("status = 'running'"), ["variant_id", "task_id", "repetition", "run_id"]
    return runs.orderBy(*progress.hash_order(*by)).select(*by, progress.hash_text(*by).alias("place"))


@query(
    "SELECT event_id, CAST(('0x' || substr(md5(concat_ws('_', event_type, CAST(user_id AS VARCHAR), CAST(event_id % 3 AS VARCHAR))), 25, 8))::BIGINT & 2147483647 AS BIGINT) AS seed FROM events"
)
def call_seed(spark, sf):
    return A.table(spark, sf, "events").select("event_id", progress.call_seed(F.col("event_type"), F.col("user_id"), F.col("event_id") % 3).alias("seed"))


_QUEUE = """SELECT run_id AS design_id, greatest(0, 4 - coalesce(e, 0)) AS evals_left, greatest(0, p - coalesce(c, 0)) AS checks_left, m.design_id IS NULL AS median_missing FROM (SELECT run_id, CASE task_id WHEN 't0' THEN 2 WHEN 't1' THEN 3 ELSE 5 END AS p FROM runs WHERE status = 'completed')
    LEFT JOIN (SELECT design_id, count(*) AS e FROM evaluations GROUP BY 1) e ON e.design_id = run_id LEFT JOIN (SELECT design_id, count(*) AS c FROM checks GROUP BY 1) c ON c.design_id = run_id LEFT JOIN (SELECT design_id FROM medians WHERE n_raters >= 2) m ON m.design_id = run_id
    WHERE greatest(0, 4 - coalesce(e, 0)) > 0 OR greatest(0, p - coalesce(c, 0)) > 0 OR m.design_id IS NULL"""


def _to_score(spark, sf):
    """Final designs with the checks that their task asks for, and what is there of them."""
    pairs = F.when(F.col("task_id") == "t0", 2).when(F.col("task_id") == "t1", 3).otherwise(5)
    designs = A.runs(spark, sf).where("status = 'completed'").select(F.col("run_id").alias("design_id"), pairs.alias("pairs"))
    return designs, A.evaluations(spark, sf).select("design_id"), A.coherence_checks(spark, sf).select("design_id"), A.medians(spark, sf).where("n_raters >= 2").select("design_id")


@query(sql(_QUEUE, "runs", "evaluations", "checks", "medians"))
def scoring_queue(spark, sf):
    """Designs that still need evaluations, checks or their median."""
    return progress.scoring_queue(*_to_score(spark, sf), wanted=4)


@query(
    sql(
        """SELECT (SELECT count(*) FROM d) AS designs, (SELECT count(*) FROM evaluations WHERE design_id IN (SELECT run_id FROM d)) AS evals_done, (SELECT count(*) FROM checks WHERE design_id IN (SELECT run_id FROM d)) AS checks_done,
        (SELECT count(*) FROM medians WHERE n_raters >= 2 AND design_id IN (SELECT run_id FROM d)) AS medians_done, (SELECT count(*) FROM q) AS pending, (SELECT CAST(coalesce(sum(evals_left + checks_left), 0) AS BIGINT) FROM q) AS calls_left""",
        "runs",
        "evaluations",
        "checks",
        "medians",
        d="SELECT run_id FROM runs WHERE status = 'completed'",
        q=_QUEUE,
    )
)
def scoring_resumption(spark, sf):
    """What a scoring queue finds done when it is started again, and what is left."""
    return progress.resumption(*_to_score(spark, sf), wanted=4)


@query(ORACLE_SQL["completeness"])
def incremental_completeness(spark, sf):
    """Completeness from the counts of six batches of facts, dealt by run, the second one delivered twice."""
    feed = counts.facts_of(A.runs(spark, sf), _scored(spark, sf), _checked(spark, sf))
    # Completions of a run and its results come in different batches; each batch has a folder of its own.
    feed = stored(feed.withColumn("slot", F.pmod(F.xxhash64("run_id", "kind"), F.lit(6))), "facts", ["slot"])
    state = counts.Completeness(spark, f"{scratch_dir(spark)}/trialforge/feeds/{uuid.uuid4().hex}", matrix(spark))
    for k in (0, 1, 1, 2, 3, 4, 5):
        state.handle(feed.where(F.col("slot") == k), k)
    return rounded(state.now())
