"""Queries over calls: timelines, steps, overlaps, micro-batches, rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialforge.functions import parsing
from trialforge.operators import integrity, matching, sweep, timeline
from trialforge.plans.registry import query, rounded, sql
from trialforge.sources import adapter as A
from trialforge.streaming import microbatch

MINUTE = 60_000_000


def requests(spark, sf):
    return A.traces(spark, sf).select(F.col("step").alias("key"), F.col("trace_id").alias("request_id"), F.col("started_us").alias("ts_us"), "k")


@query(sql("SELECT run_id, count(*) AS n_calls, round(sum(cost_usd), 6) AS total_cost, round((max(ended_us) - min(started_us)) / 1000.0::DOUBLE, 3) AS wall_ms FROM traces GROUP BY run_id", "traces"))
def run_totals(spark, sf):
    return timeline.run_totals(A.traces(spark, sf)).select("run_id", "n_calls", F.round("total_cost", 6).alias("total_cost"), F.round("wall_ms", 3).alias("wall_ms"))


@query(sql("SELECT run_id, agent_id, arg_min(agent_role, (started_us, trace_id)) AS agent_role, count(*) AS n_events, string_agg(CAST(trace_id AS VARCHAR), ',' ORDER BY started_us, trace_id) AS trace_ids FROM traces GROUP BY ALL", "traces"))
def swim_lanes(spark, sf):
    return timeline.swim_lanes(A.traces(spark, sf)).withColumn("trace_ids", F.array_join("trace_ids", ","))


_PAIRS = "SELECT a.run_id, a.trace_id AS anchor, b.trace_id AS other FROM traces a JOIN traces b ON a.run_id = b.run_id AND (a.started_us < b.started_us OR a.started_us = b.started_us AND a.trace_id < b.trace_id) AND b.started_us < a.ended_us AND a.ended_us > a.started_us AND b.ended_us > b.started_us"


@query(sql(_PAIRS, "traces"))
def overlap_pairs(spark, sf):
    return timeline.overlap_pairs(A.traces(spark, sf))


@query(sql("SELECT DISTINCT run_id, members FROM (SELECT run_id, anchor, array_to_string(list_sort(list_append(list(other), anchor)), ',') AS members FROM p GROUP BY run_id, anchor)", "traces", p=_PAIRS))
def overlap_groups(spark, sf):
    return timeline.parallel_groups(A.traces(spark, sf)).withColumn("members", F.array_join("members", ","))


@query(
    sql(
        "SELECT run_id, island, count(*) AS n_events, min(started_us) AS started_us, max(ended_us) AS ended_us FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY run_id ORDER BY started_us, trace_id) AS BIGINT) AS island FROM (SELECT *, CASE WHEN coalesce(started_us >= max(ended_us) OVER (PARTITION BY run_id ORDER BY started_us, trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS fresh FROM traces)) GROUP BY ALL",
        "traces",
    )
)
def overlap_islands(spark, sf):
    return timeline.islands(A.traces(spark, sf))


_LASTING = "SELECT * FROM traces WHERE ended_us > started_us"


@query(sql("SELECT a.run_id, a.trace_id, count(b.trace_id) AS degree FROM c a LEFT JOIN c b ON a.run_id = b.run_id AND a.trace_id <> b.trace_id AND a.started_us < b.ended_us AND b.started_us < a.ended_us GROUP BY ALL", "traces", c=_LASTING))
def overlap_degree(spark, sf):
    """How many calls of its run each call overlaps, without a pair of calls."""
    return sweep.degrees(A.traces(spark, sf))


# Active calls between neighbouring moments, by a sum of +1 and -1 over the moments.
_STEPS = "SELECT run_id, moment, sum(sum(d)) OVER (PARTITION BY run_id ORDER BY moment) AS active, lead(moment) OVER (PARTITION BY run_id ORDER BY moment) - moment AS lasts FROM (SELECT run_id, started_us AS moment, 1 AS d FROM c UNION ALL SELECT run_id, ended_us, -1 FROM c) GROUP BY run_id, moment"


@query(
    sql(
        "SELECT run_id, CAST(max(active) AS BIGINT) AS peak, CAST(coalesce(sum(lasts) FILTER (active >= 1), 0) AS BIGINT) AS busy_us, CAST(coalesce(sum(lasts) FILTER (active >= 2), 0) AS BIGINT) AS parallel_us, round(sum(active * coalesce(lasts, 0)) / sum(lasts) FILTER (active >= 1), 6) AS mean_active FROM s GROUP BY run_id",
        "traces",
        c=_LASTING,
        s=_STEPS,
    )
)
def run_profile(spark, sf):
    """The most calls at once of each run, and how long it was busy and parallel."""
    return rounded(sweep.profile(A.traces(spark, sf)))


# A largest group is what runs at the start of one of its calls, if no call starts between then and the group's first end.
@query(
    sql(
        "SELECT run_id, from_us, until_us, n FROM (SELECT a.run_id, a.started_us AS from_us, min(b.ended_us) AS until_us, count(*) AS n FROM (SELECT DISTINCT run_id, started_us FROM c) a JOIN c b ON b.run_id = a.run_id AND b.started_us <= a.started_us AND b.ended_us > a.started_us GROUP BY a.run_id, a.started_us) g WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM c x WHERE x.run_id = g.run_id AND x.started_us > g.from_us AND x.started_us < g.until_us)",
        "traces",
        c=_LASTING,
    )
)
def largest_groups(spark, sf):
    """The largest sets of calls that run at once."""
    return sweep.largest_groups(A.traces(spark, sf))


@query(
    sql(
        "SELECT run_id, min(started_us) AS started_us, max(ended_us) AS ended_us, count(*) AS n_events FROM (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY started_us, trace_id) AS island FROM (SELECT *, CASE WHEN coalesce(started_us >= max(ended_us) OVER (PARTITION BY run_id ORDER BY started_us, trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS fresh FROM c)) GROUP BY run_id, island",
        "traces",
        c=_LASTING,
    )
)
def busy_stretches(spark, sf):
    """Connected stretches of each run, from the sweep."""
    return sweep.stretches(A.traces(spark, sf))


@query(sql("SELECT variant_id, count(*) AS run_count, round(avg(duration_seconds), 6) AS mean_duration, round(avg(total_cost_usd), 6) AS mean_cost, CAST(floor(avg(total_input_tokens + total_output_tokens)) AS BIGINT) AS mean_tokens FROM runs GROUP BY variant_id", "runs"))
def variant_summary(spark, sf):
    return rounded(timeline.variant_summary(A.runs(spark, sf)))


@query(sql("SELECT v.variant_id, coalesce(run_count, 0) AS run_count, mean_cost FROM (VALUES ('v1'), ('v4'), ('v9')) v(variant_id) LEFT JOIN (SELECT variant_id, count(*) AS run_count, round(avg(total_cost_usd), 6) AS mean_cost FROM runs WHERE task_id = 't1' GROUP BY 1) USING (variant_id)", "runs"))
def variant_comparison(spark, sf):
    """Requested variants on one task, those without runs too."""
    wanted = spark.createDataFrame([("v1",), ("v4",), ("v9",)], "variant_id string")
    own = timeline.variant_summary(A.runs(spark, sf).where("task_id = 't1'")).select("variant_id", "run_count", F.round("mean_cost", 6).alias("mean_cost"))
    return wanted.join(own, "variant_id", "left").withColumn("run_count", F.coalesce("run_count", F.lit(0)))


@query(sql("SELECT variant_id, step, round(sum(cost_usd) / max(n), 6) AS cost_per_run, round(count(*) / max(n), 6) AS calls_per_run FROM traces JOIN (SELECT variant_id, count(DISTINCT run_id) AS n FROM traces GROUP BY 1) USING (variant_id) GROUP BY ALL", "traces"))
def step_breakdown(spark, sf):
    return rounded(timeline.step_breakdown(A.traces(spark, sf)))


@query(sql("SELECT step AS name, 'X' AS ph, started_us AS ts, ended_us - started_us AS dur, run_id AS pid, dense_rank() OVER (PARTITION BY run_id ORDER BY agent_id) AS tid, trace_id FROM traces", "traces"))
def chrome_trace(spark, sf):
    return timeline.chrome_trace(A.traces(spark, sf))


_BATCHED = f"SELECT step AS key, trace_id AS request_id, started_us // {15 * MINUTE} AS slot, CAST(floor((row_number() OVER (PARTITION BY step, started_us // {15 * MINUTE} ORDER BY started_us, trace_id) - 1) / 2) AS BIGINT) AS batch FROM traces"
_LOG = "SELECT key, slot, batch, count(*) AS size FROM b GROUP BY ALL"


@query(sql("SELECT key, request_id, slot, batch FROM b", "traces", b=_BATCHED))
def microbatch_flush(spark, sf):
    return microbatch.flushes(requests(spark, sf), "key", 15 * MINUTE, 2).select("key", "request_id", "slot", "batch")


@query(sql("SELECT key, count(*) AS flushes, CAST(sum(size) AS BIGINT) AS requests, round(avg(size), 6) AS mean_size, min(size) AS min_size, max(size) AS max_size, round(100 * sum(CASE WHEN size > 1 THEN size ELSE 0 END) / sum(size), 6) AS batched_pct FROM l GROUP BY key", "traces", b=_BATCHED, l=_LOG))
def flush_stats(spark, sf):
    return rounded(microbatch.flush_stats(microbatch.flush_log(microbatch.flushes(requests(spark, sf), "key", 15 * MINUTE, 2), "key"), "key"))


@query(sql(f"SELECT trace_id, {MINUTE} - started_us % {MINUTE} AS left_us FROM traces", "traces"))
def flush_countdown(spark, sf):
    return A.traces(spark, sf).select("trace_id", microbatch.countdown(F.col("started_us"), MINUTE).alias("left_us"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, sf):
    rows = A.table(spark, sf, "events").withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")))
    return rounded(microbatch.windowed_counts(rows, "event_type", "1 hour", "1 day"))


# One step of the recursion is one request of each key: tokens and requests left refill with time, and a request waits for both.
_LIMITED = """WITH RECURSIVE q AS (SELECT step AS key, trace_id AS request_id, started_us / 1e6 AS "at", least(CAST(k AS DOUBLE), 100) AS tokens, row_number() OVER (PARTITION BY step ORDER BY started_us, trace_id) AS i FROM traces),
    f AS (SELECT key, i, request_id, "at", r - 1 AS r, t - tokens AS t, granted_at FROM (SELECT key, i, request_id, "at", tokens, least(2.0::DOUBLE, 2 + wait * 2 / 60) AS r, least(100.0::DOUBLE, 100 + wait * 100 / 60) AS t, "at" + wait AS granted_at FROM (SELECT *, greatest(0.0::DOUBLE, (tokens - 100) * 60 / 100) AS wait FROM q WHERE i = 1))
    UNION ALL SELECT key, i, request_id, "at", least(2.0::DOUBLE, r + wait * 2 / 60) - 1, least(100.0::DOUBLE, t + wait * 100 / 60) - tokens, began + wait FROM (SELECT *, greatest(0.0::DOUBLE, (1 - r) * 60 / 2, (tokens - t) * 60 / 100) AS wait FROM
    (SELECT q.key, q.i, q.request_id, q."at", q.tokens, greatest(q."at", f.granted_at) AS began, least(2.0::DOUBLE, f.r + (greatest(q."at", f.granted_at) - f.granted_at) * 2 / 60) AS r, least(100.0::DOUBLE, f.t + (greatest(q."at", f.granted_at) - f.granted_at) * 100 / 60) AS t FROM f JOIN q ON q.key = f.key AND q.i = f.i + 1)))
    SELECT key, request_id, round("at", 3) AS "at", round(granted_at, 3) AS granted_at, round(granted_at - "at", 3) AS waited FROM f"""


@query(sql(f"SELECT * FROM ({_LIMITED})", "traces"))
def rate_limit_fold(spark, sf):
    rows = requests(spark, sf).select("key", "request_id", (F.col("ts_us") / 1e6).alias("at"), F.col("k").cast("double").alias("tokens"))
    return rounded(microbatch.rate_limited(rows, microbatch.Limits(rpm=2, tpm=100)), 3)


@query(
    sql(
        "SELECT trace_id, round((greatest(inp - cached, 0) * 3 + cached * 0.3 + outp * 15) / 1000000 * CASE WHEN batch THEN 0.5 ELSE 1 END, 9) AS cost FROM (SELECT trace_id, (k * 100)::DOUBLE AS inp, (k * 7 % 90 * 100)::DOUBLE AS cached, (k * 20)::DOUBLE AS outp, step = 'view' AS batch FROM traces)",
        "traces",
    )
)
def call_cost(spark, sf):
    k = F.col("k")
    cost = parsing.call_cost((k * 100).cast("double"), (k * 7 % 90 * 100).cast("double"), (k * 20).cast("double"), F.lit(3.0), F.lit(0.3), F.lit(15.0), F.col("step") == "view", F.lit(0.5), clamp=True)
    return A.traces(spark, sf).select("trace_id", F.round(cost, 9).alias("cost"))


@query(sql("SELECT run_id, CASE WHEN t > 5000 THEN 'exceeded_tokens' WHEN c > 4000 THEN 'exceeded_cost' WHEN t >= 4000 OR c >= 3200 THEN 'near' ELSE 'ok' END AS message FROM (SELECT run_id, sum(k) AS t, sum(cost_usd) AS c FROM traces GROUP BY 1)", "traces"))
def limit_messages(spark, sf):
    own = A.traces(spark, sf).groupBy("run_id").agg(F.sum("k").alias("t"), F.sum("cost_usd").alias("c"))
    return own.select("run_id", parsing.limit_message(F.col("t"), F.col("c"), 5000, 4000).alias("message"))


@query(sql("SELECT variant_id, count(*) AS calls, round(sum(cost_usd), 6) AS cost, round(count(*) / ((max(ended_us) - min(started_us)) / 60000000.0::DOUBLE), 6) AS calls_per_minute FROM traces GROUP BY variant_id", "traces"))
def evaluator_progress(spark, sf):
    t = A.traces(spark, sf)
    return rounded(t.groupBy("variant_id").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost"), (F.count("*") / ((F.max("ended_us") - F.min("started_us")) / F.lit(60_000_000.0))).alias("calls_per_minute")))


@query(sql("SELECT trace_id, CAST(floor((row_number() OVER (PARTITION BY step ORDER BY trace_id) - 1) / 20) AS BIGINT) AS chunk FROM traces", "traces"))
def chunked_requests(spark, sf):
    return matching.chunked(A.traces(spark, sf), ["trace_id"], 20, ["step"]).select("trace_id", "chunk")


@query(sql("SELECT run_id AS design_id, count(*) FILTER (WHERE k > 20) AS got, CASE WHEN count(*) FILTER (WHERE k > 20) >= 50 THEN 'evaluated' ELSE 'failed' END AS outcome FROM traces GROUP BY run_id", "traces"))
def chunk_outcomes(spark, sf):
    rows = A.traces(spark, sf).select(F.col("run_id").alias("design_id"), (F.col("k") > 20).alias("parsed"))
    return matching.chunk_outcomes(rows, rows, 50)


@query(sql("SELECT run_id, step, count(*) AS n, count(DISTINCT props) AS different, count(DISTINCT props) = 1 AS failed FROM traces GROUP BY ALL HAVING count(*) >= 2", "traces"))
def check_parallel_differ(spark, sf):
    rows = A.traces(spark, sf).select("run_id", F.lit(0).alias("round"), "step", F.col("props").alias("prompt_text"))
    return integrity.parallel_differ(rows).select("run_id", "step", "n", "different", "failed")


@query(sql("SELECT trace_id, trace_id % 7 <> 0 AS matched FROM traces", "traces"))
def custom_id_match(spark, sf):
    rows = A.traces(spark, sf).select("trace_id")
    return matching.by_custom_id(rows, rows.where("trace_id % 7 <> 0"), "trace_id")
