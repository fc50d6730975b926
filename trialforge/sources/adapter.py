"""Views of the experiment model over the star-schema tables, so that every operator can run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIANTS = {"1-URGENT": "v1", "2-HIGH": "v2a", "3-MEDIUM": "v3b", "4-NOT SPECIFIED": "v4", "5-LOW": "v5"}
COMPLEXITY = {"t0": "simple", "t1": "simple", "t2": "medium", "t3": "complex"}
STATUS = {"F": "completed", "P": "failed", "O": "running"}
#: Share of each evaluator in the ensemble score.
WEIGHTS = {"m0": 2.0, "m1": 2.0, "m2": 1.0}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _choose(column, mapping: dict):
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def runs(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")  # 25 rows at any scale
    rows = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("o_orderkey").alias("run_id"), _choose(F.col("o_orderpriority"), VARIANTS).alias("variant_id"), F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("task_id"),
        F.year("o_orderdate").cast("long").alias("repetition"), _choose(F.col("o_orderstatus"), STATUS).alias("status"), F.col("o_totalprice").alias("total_cost_usd"),
        F.floor("o_totalprice").cast("long").alias("total_input_tokens"), F.floor(F.col("o_totalprice") / 2).cast("long").alias("total_output_tokens"), (F.col("o_custkey") % 997).cast("double").alias("duration_seconds"), F.col("o_orderdate").alias("started_at"),
    )


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COMPLEXITY.items()), "task_id string, complexity string")


def evaluations(spark: SparkSession, sf: str) -> DataFrame:
    """One row per rater of a design, with a score overall and in three dimensions."""
    rows = table(spark, sf, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("design_id"), F.col("l_linenumber").cast("long").alias("evaluator_run"), F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("evaluator_model"), F.col("l_partkey").alias("rater_key"),
        F.round(1 + F.col("l_quantity") * 0.08, 4).alias("overall_score"), F.round(F.col("l_quantity") / 10, 4).alias("quality"), F.round(5 - F.col("l_discount") * 20, 4).alias("security"), F.round(1 + F.col("l_tax") * 40, 4).alias("performance"),
    )


def medians(spark: SparkSession, sf: str) -> DataFrame:
    return evaluations(spark, sf).groupBy("design_id").agg(F.median("overall_score").alias("overall_median"), F.count("*").alias("n_raters"))


def score_view(spark: SparkSession, sf: str) -> DataFrame:
    """variant_id, task_id, repetition, design_id, run_id, overall_median, complexity of scored designs of completed runs."""
    done = runs(spark, sf).where("status = 'completed'").select("run_id", "variant_id", "task_id", "repetition")
    scored = medians(spark, sf).select(F.col("design_id").alias("run_id"), "overall_median")
    return done.join(scored, "run_id").join(F.broadcast(tasks(spark)), "task_id", "left").select("variant_id", "task_id", "repetition", F.col("run_id").alias("design_id"), "run_id", "overall_median", "complexity")


def cost_view(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).where("status = 'completed'").select("variant_id", "task_id", "repetition", "run_id", "total_cost_usd", "total_input_tokens", "total_output_tokens", "duration_seconds")


def coherence_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Checks on designs: one per line item with a part, contradicting where the discount is over 0.08."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("design_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string"), F.lit("|s"), (F.col("l_linenumber") + 1).cast("string")).alias("section_pair"), (F.col("l_discount") > 0.08).alias("contradicts"), F.col("l_returnflag").alias("explanation"))


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """Calls with a start and an end: value is their length in tens of seconds."""
    rows = table(spark, sf, "events")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")  # in any session time zone
    return rows.select(
        F.col("event_id").alias("trace_id"), F.col("user_id").alias("run_id"), F.concat(F.lit("v"), (F.col("user_id") % 5 + 1).cast("string")).alias("variant_id"), F.concat(F.lit("agent_"), (F.col("event_id") % 4).cast("string")).alias("agent_id"), F.when(F.col("event_id") % 4 == 0, "leader").otherwise("reviewer").alias("agent_role"), F.col("event_type").alias("step"),
        micros.alias("started_us"), (micros + F.round(F.col("value") * 10_000_000).cast("long")).alias("ended_us"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("value").alias("cost_usd"), F.col("props"),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as rounds of runs."""
    rows = table(spark, sf, "conversations")
    return rows.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("round"), F.col("role").alias("agent_role"), F.col("text"), F.concat(F.lit("t"), (F.col("conv_id") % 5).cast("string")).alias("task_id"), F.concat(F.lit("v"), (F.col("conv_id") % 4 + 1).cast("string")).alias("variant_id"))
