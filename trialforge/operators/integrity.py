"""Data-integrity checks. Each gives one row: check_name, passed, total, failures (and, by details(), up to ten failures).

rows are traces: run_id, round, step, agent_role, prompt_text, response_text, task_id, in the columns each check names.
A check is a frame of checked items with a boolean `failed`, or of sums of items with `items` and a number `failed`;
summary() adds it up. Snippets are found by equality of keys first and contains() on what is left; those of other tasks
are in contamination.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.udtf import SkipRestOfInputTableException

from trialforge.functions import parsing

ROUND = ["run_id", "round"]


def summary(name: str, checked: DataFrame) -> DataFrame:
    bad = F.coalesce(F.sum(F.coalesce(F.col("failed").cast("long"), F.lit(0))), F.lit(0))
    total = F.coalesce(F.sum("items"), F.lit(0)) if "items" in checked.columns else F.count("*")
    return checked.agg(total.alias("total"), bad.alias("failures")).select(F.lit(name).alias("check_name"), (F.col("failures") == 0).alias("passed"), "total", "failures")


def details(checked: DataFrame, text, n: int = 10) -> DataFrame:
    return checked.where("failed").select(text.alias("detail")).orderBy("detail").limit(n)


def first_details(failures: DataFrame, n: int = 10) -> DataFrame:
    """check_name, detail, place of the first n failures of each check, by their text; the limit works before the shuffle."""
    place = F.row_number().over(Window.partitionBy("check_name").orderBy("detail"))
    return failures.select("check_name", "detail", place.alias("place")).where(F.col("place") <= n)


@F.udtf(returnType="check_name string, detail string, place int")
class CheckDetails:
    """Table function check_details(TABLE(failures) PARTITION BY (check_name) ORDER BY (detail), n): the first n failures of each check."""

    def __init__(self):
        self.place = 0

    def eval(self, row, most: int):
        if self.place >= most:
            raise SkipRestOfInputTableException("the first ones are told")
        self.place += 1
        yield row["check_name"], row["detail"], self.place


def register_details(spark: SparkSession, failures: DataFrame, view: str = "check_failures", name: str = "check_details") -> None:
    """Makes the failures a view and the table function known to SQL, for `spark` as long as it lives."""
    failures.createOrReplaceTempView(view)
    spark.udtf.register(name, CheckDetails)


def template_variables(rows: DataFrame) -> DataFrame:
    return rows.where("prompt_text is not null").withColumn("failed", F.size(parsing.left_variables(F.col("prompt_text"))) > 0)


def blank_text(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("failed", F.col(column).isNull() | (F.trim(column) == ""))


def system_name(rows: DataFrame) -> DataFrame:
    """First-round generation prompts name the system. rows: prompt_text, task_config (JSON, the name at the top or under variables)."""
    name = F.coalesce(F.get_json_object("task_config", "$.variables.system_name"), F.get_json_object("task_config", "$.system_name"))
    own = rows.where("step = 'generation' and round = 0 and prompt_text is not null").withColumn("name", name).where("name is not null")
    return own.withColumn("failed", ~F.lower("prompt_text").contains(F.lower("name")))


def perspective(rows: DataFrame) -> DataFrame:
    own = rows.where("prompt_text is not null").where(F.lower("agent_role").rlike("reviewer|specialist|adversarial"))
    return own.withColumn("failed", ~F.lower("prompt_text").rlike("|".join(parsing.PERSPECTIVE_WORDS)))


def design_words(rows: DataFrame, least: int = 2) -> DataFrame:
    low = F.lower("prompt_text")
    return rows.where("prompt_text is not null").withColumn("failed", sum(low.contains(w).cast("int") for w in parsing.DESIGN_WORDS) < least)


def contains_snippet(rows: DataFrame, texts: DataFrame, start: int, stop: int, offsets: list[int]) -> DataFrame:
    """Whether the prompts of rows contain the snippet of the text of the round `offset` before, the first offset that has one. rows: run_id, round, prompt_text; texts: run_id, round, text. Rows without a text are not checked; of several texts of a round the largest counts."""
    cut = texts.where(F.char_length("text") >= stop).groupBy(*ROUND).agg(F.max("text").alias("text")).select(*ROUND, parsing.snippet(F.col("text"), start, stop).alias("snippet"))
    out, found = rows, []
    for i, offset in enumerate(offsets):
        out = out.join(cut.select("run_id", (F.col("round") + offset).alias("round"), F.col("snippet").alias(f"s{i}")), ROUND, "left")
        found.append(F.col(f"s{i}"))
    return out.withColumn("snippet", F.coalesce(*found)).where("snippet is not null").withColumn("failed", ~F.col("prompt_text").contains(F.col("snippet")))


def prompt_growth(rows: DataFrame) -> DataFrame:
    """Rounds whose longest prompt is under half the one of the round before."""
    own = rows.groupBy(*ROUND).agg(F.max(F.char_length("prompt_text")).alias("size"))
    before = F.lag("size").over(Window.partitionBy("run_id").orderBy("round"))
    return own.withColumn("before", before).where("before is not null").withColumn("failed", F.col("size") < 0.5 * F.col("before"))


def parallel_differ(rows: DataFrame) -> DataFrame:
    """Rounds in which two or more agents do the same step: not all with the same prompt."""
    own = rows.groupBy(*ROUND, "step").agg(F.count("*").alias("n"), F.countDistinct("prompt_text").alias("different"))
    return own.where("n >= 2").withColumn("failed", F.col("different") == 1)


def evaluation_values(rows: DataFrame, low: float = 0, high: float = 10) -> DataFrame:
    """Scores in range, and JSON that is an object or a list of objects. rows: overall_score, dimension_scores."""
    v = F.try_parse_json("dimension_scores")
    kind = F.schema_of_variant(v)
    shaped = kind.startswith("OBJECT<") | kind.startswith("ARRAY<OBJECT<") | (kind == "OBJECT<>")
    return rows.withColumn("failed", F.col("overall_score").isNull() | ~F.col("overall_score").between(low, high) | v.isNull() | ~F.coalesce(shaped, F.lit(False)))


def evaluation_coverage(designs: DataFrame, evaluations: DataFrame, least: int = 3) -> DataFrame:
    n = evaluations.groupBy("design_id").agg(F.count("*").alias("n"))
    return designs.join(n, "design_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("failed", F.col("n") < least)


def coherence_fields(checks: DataFrame) -> DataFrame:
    """One item for each of the two fields of each check."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("section_pair", "explanation")])).alias("x")
    return checks.select("design_id", fields).select("design_id", "x.field", (F.col("x.value").isNull() | (F.trim("x.value") == "")).alias("failed"))


def context_chain(rows: DataFrame, width: int = 200) -> DataFrame:
    """For neighbouring present rounds: the start of the earlier round's last response (by step, then id) stands in a prompt of the later one. rows: run_id, round, step, trace_id, prompt_text, response_text; shorter responses are not checked."""
    last = rows.where("response_text is not null").groupBy(*ROUND).agg(F.max_by("response_text", F.struct("step", "trace_id")).alias("text"))
    present = rows.select(*ROUND).distinct().withColumn("next", F.lead("round").over(Window.partitionBy("run_id").orderBy("round")))
    pairs = last.join(present, ROUND).where(F.col("next").isNotNull() & (F.char_length("text") >= width)).select("run_id", "round", F.col("next"), F.substring("text", 1, width).alias("snippet"))
    prompts = rows.select("run_id", F.col("round").alias("next"), "prompt_text")
    hits = pairs.join(prompts, ["run_id", "next"], "left").groupBy("run_id", "round", "next").agg(F.bool_or(F.coalesce(F.col("prompt_text").contains(F.col("snippet")), F.lit(False))).alias("found"))
    return hits.withColumn("failed", ~F.col("found"))


def prefix_references(names: DataFrame, known: DataFrame) -> DataFrame:
    """Names that are no prefix of any known id, or the other way round, fail. known is a configuration table."""
    hits = names.join(F.broadcast(known), F.col("known").startswith(F.col("name")) | F.col("name").startswith(F.col("known")), "left")
    return hits.groupBy("name").agg(F.count("known").alias("n")).withColumn("failed", F.col("n") == 0)
