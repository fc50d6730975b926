"""Timelines of calls: lanes, overlaps, totals, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_totals(traces: DataFrame) -> DataFrame:
    """Per run: calls, cost, wall span in ms (null times are left out)."""
    return traces.groupBy("run_id").agg(F.count("*").alias("n_calls"), F.sum("cost_usd").alias("total_cost"), ((F.max("ended_us") - F.min("started_us")) / 1000.0).alias("wall_ms"))


def swim_lanes(traces: DataFrame) -> DataFrame:
    """Per run and agent: role first seen, number of events, ids in order of their start."""
    own = F.array_sort(F.collect_list(F.struct("started_us", "trace_id")))
    return traces.groupBy("run_id", "agent_id").agg(F.min_by("agent_role", F.struct("started_us", "trace_id")).alias("agent_role"), F.count("*").alias("n_events"), F.transform(own, lambda e: e["trace_id"]).alias("trace_ids"))


def overlap_pairs(traces: DataFrame, width_us: int = 600_000_000) -> DataFrame:
    """anchor, other: later events of the run that strictly overlap the anchor.

    Events are laid into slots of the given width and joined by run and slot, so that a run with many events is not
    compared with itself as a whole; a pair counts in the slot where its later event begins.
    """
    spans = traces.where("started_us is not null and ended_us is not null and ended_us > started_us")
    slots = F.explode(F.sequence(F.expr(f"started_us div {width_us}"), F.expr(f"(ended_us - 1) div {width_us}"))).alias("slot")
    a = spans.select("run_id", F.col("trace_id").alias("anchor"), F.col("started_us").alias("s1"), F.col("ended_us").alias("e1"), slots)
    b = spans.select("run_id", F.col("trace_id").alias("other"), F.col("started_us").alias("s2"), F.col("ended_us").alias("e2"), F.expr(f"started_us div {width_us}").alias("slot"))
    return a.join(b, ["run_id", "slot"]).where("(s1 < s2 or s1 = s2 and anchor < other) and s2 < e1").select("run_id", "anchor", "other")


def parallel_groups(traces: DataFrame) -> DataFrame:
    """run_id, members: each anchor with the later events that overlap it; one of equal sets."""
    groups = overlap_pairs(traces).groupBy("run_id", "anchor").agg(F.collect_list("other").alias("others"))
    return groups.select("run_id", F.array_sort(F.concat(F.array("anchor"), "others")).alias("members")).dropDuplicates(["run_id", "members"])


def islands(traces: DataFrame) -> DataFrame:
    """run_id, island, n_events, started_us, ended_us of connected stretches of time."""
    order = Window.partitionBy("run_id").orderBy("started_us", "trace_id")
    reach = F.max("ended_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = traces.withColumn("new", F.when(reach.isNull() | (F.col("started_us") >= reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(order))
    return rows.groupBy("run_id", "island").agg(F.count("*").alias("n_events"), F.min("started_us").alias("started_us"), F.max("ended_us").alias("ended_us"))


def variant_summary(runs: DataFrame) -> DataFrame:
    """Per variant: runs and mean duration, cost and tokens, null counting as 0."""
    mean = lambda c: F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return runs.groupBy("variant_id").agg(F.count("*").alias("run_count"), mean("duration_seconds").alias("mean_duration"), mean("total_cost_usd").alias("mean_cost"), F.floor(F.avg(F.coalesce(F.col("total_input_tokens") + F.col("total_output_tokens"), F.lit(0)))).cast("long").alias("mean_tokens"))


def step_breakdown(traces: DataFrame) -> DataFrame:
    """Per variant and step: cost and calls divided by the variant's number of runs."""
    n = traces.groupBy("variant_id").agg(F.countDistinct("run_id").alias("n_runs"))
    own = traces.groupBy("variant_id", "step").agg(F.sum("cost_usd").alias("cost"), F.count("*").alias("calls"))
    return own.join(F.broadcast(n), "variant_id").select("variant_id", "step", (F.col("cost") / F.col("n_runs")).alias("cost_per_run"), (F.col("calls") / F.col("n_runs")).alias("calls_per_run"))


def chrome_trace(traces: DataFrame) -> DataFrame:
    """Events of the Chrome trace format: name, ph, ts and dur in microseconds, pid, tid."""
    lanes = traces.select("run_id", "agent_id").distinct().withColumn("tid", F.row_number().over(Window.partitionBy("run_id").orderBy("agent_id")).cast("long"))
    rows = traces.join(lanes, ["run_id", "agent_id"])
    return rows.select(F.col("step").alias("name"), F.lit("X").alias("ph"), F.col("started_us").alias("ts"), (F.col("ended_us") - F.col("started_us")).alias("dur"), F.col("run_id").alias("pid"), "tid", F.col("trace_id"))


def convergence(points: DataFrame, key: list[str], order: list[str], value: str, share: float = 0.05) -> DataFrame:
    """key, n_points, plateau: index of the first step that changes by less than `share` of the range, 0 for a flat series, else the last index; two points at least."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = points.withColumn("i", F.row_number().over(w) - 1).withColumn("step", F.abs(F.col(value) - F.lag(value).over(w)))
    whole = rows.withColumn("reach", F.max(value).over(Window.partitionBy(*key)) - F.min(value).over(Window.partitionBy(*key)))
    out = whole.groupBy(*key).agg(F.count("*").alias("n_points"), F.max("reach").alias("reach"), F.min(F.when((F.col("i") > 0) & (F.col("step") < share * F.col("reach")), F.col("i"))).alias("hit"))
    return out.where("n_points >= 2").select(*key, "n_points", F.when(F.col("reach") == 0, 0).otherwise(F.coalesce("hit", F.col("n_points") - 1)).cast("long").alias("plateau"))


def size_drops(rounds: DataFrame, share: float = 0.5) -> DataFrame:
    """run_id, round, size, before of rounds smaller than `share` of the round before. rounds: run_id, round, size."""
    w = Window.partitionBy("run_id").orderBy("round")
    return rounds.withColumn("before", F.lag("size").over(w)).where(F.col("size") < share * F.col("before"))
