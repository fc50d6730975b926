"""Tables of the experiment model with explicit schemas, keys and references; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 3


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _table(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (column.split() for column in text.split(","))])


SCHEMAS = {
    "runs": _table("run_id string, variant_id string, sub_variant string, task_id string, repetition int, status string, variant_config string, task_config string, model_configs string, total_input_tokens long, total_output_tokens long, total_cost_usd double, started_at string, ended_at string, duration_seconds double, checkpoint_step string, checkpoint_data string, created_at string, seed long"),
    "designs": _table("design_id string, run_id string, round int, agent_role string, agent_id string, full_text string, token_count long, is_final boolean, created_at string"),
    "reviews": _table("review_id string, run_id string, design_id string, round int, agent_role string, agent_id string, review_text string, verdict string, created_at string"),
    "evaluations": _table("evaluation_id string, design_id string, evaluator_run int, evaluator_model string, dimension_scores string, overall_score double, qualitative_summary string, input_tokens long, output_tokens long, cost_usd double, batch_id string, created_at string"),
    "scores_median": _table("design_id string, run_id string, dimension_medians string, overall_median double, disagreement_flags string, krippendorff_alpha double, created_at string, blocker_count int, blockers_json string"),
    "coherence_checks": _table("check_id string, design_id string, section_pair string, contradicts boolean, explanation string, created_at string"),
    "traces": _table("trace_id string, run_id string, variant_id string, task_id string, repetition int, agent_role string, agent_id string, step string, round int, model_config_id string, api_model string, provider string, system_prompt_hash string, prompt_template string, prompt_text string, response_text string, input_tokens long, output_tokens long, cached_input_tokens long, cost_usd double, latency_ms double, started_at string, ended_at string, batch_id string, status string, error string, retry_count int, created_at string, seed long"),
    "batches": _table("batch_id string, provider string, purpose string, status string, request_count int, completed_count int, failed_count int, submitted_at string, completed_at string, request_file string, response_file string, created_at string"),
    "schema_version": _table("version int, applied_at string"),
}
KEYS = {"runs": ["run_id"], "designs": ["design_id"], "reviews": ["review_id"], "evaluations": ["evaluation_id"], "scores_median": ["design_id"], "coherence_checks": ["check_id"], "traces": ["trace_id"], "batches": ["batch_id"], "schema_version": ["version"]}
#: Table, column, and the table whose key it refers to. Parents come before children in SCHEMAS.
REFERENCES = [("designs", "run_id", "runs"), ("reviews", "run_id", "runs"), ("reviews", "design_id", "designs"), ("evaluations", "design_id", "designs"), ("scores_median", "design_id", "designs"), ("scores_median", "run_id", "runs"), ("coherence_checks", "design_id", "designs"), ("traces", "run_id", "runs")]
#: Columns that a schema version added: rows of an older store have null in them.
ADDED = {2: {"traces": ["prompt_text", "response_text"]}, 3: {"scores_median": ["blocker_count", "blockers_json"], "runs": ["seed"], "traces": ["seed"]}}


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order: missing ones null, others dropped, types cast (what can't be cast is null)."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in SCHEMAS[table]])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def key_violations(df: DataFrame, table: str, unique: list[str] | None = None) -> DataFrame:
    """Keys that occur more than once, with n."""
    return df.groupBy(*(unique or KEYS[table])).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no parent."""
    keys = parent.select(F.col(key).alias(column)).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti")
