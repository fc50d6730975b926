"""Raters' JSON taken in by one parse, with a reject table: nothing is lost without a reason.

A text is parsed once, to a variant. Two shapes hold scores: a list of records (dimension, score, justification,
blockers), and a map from dimension to a record or to a bare number. What cannot be taken is kept with the reason:

* of a whole text: "missing" (null or blank), "malformed" (no JSON), "no list or map", "empty";
* of an element: "no record" (neither a record nor, in a map, a number), "no dimension" (absent, null or blank), "no score"
  (absent, or no number).

So elements and texts that count as one add up: taken rows and rejects. Repeated dimensions are rows each; a field of
another type than it should have is null; columns besides the keys and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = "^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL)"


def _field(name: str, kind: str) -> Column:
    """A field of an element that is a record, null if it cannot be had."""
    return F.when(F.col("shape").startswith("OBJECT"), F.try_variant_get("value", f"$.{name}", kind))


def elements(evaluations: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys, place (null for a whole text), reason (null for what is taken), dimension, score, justification, blockers, raw (what was given)."""
    parsed = evaluations.select(*keys, F.col(column).alias("text"), F.try_parse_json(column).alias("v"))
    shape = F.coalesce(F.schema_of_variant("v"), F.lit(""))
    listed, mapped = shape.startswith("ARRAY"), shape.startswith("OBJECT")
    whole = F.when(F.col("text").isNull() | (F.trim("text") == ""), "missing").when(F.col("v").isNull(), "malformed").when(~(listed | mapped), "no list or map").when((shape == "ARRAY<VOID>") & (F.to_json("v") == "[]") | (shape == "OBJECT<>"), "empty")
    parsed = parsed.select(*keys, "text", whole.alias("whole"), mapped.alias("mapped"), F.when(whole.isNull(), F.col("v")).alias("v"))
    each = parsed.lateralJoin(evaluations.sparkSession.tvf.variant_explode_outer(F.col("v").outer())).drop("v")
    each = each.withColumn("shape", F.coalesce(F.schema_of_variant("value"), F.lit("")))
    bare = F.col("mapped") & F.col("shape").rlike(NUMBERS)
    told = F.schema_of_variant(F.when(F.col("shape").startswith("OBJECT"), F.try_variant_get("value", "$.score", "variant")))
    dimension = F.when(F.col("mapped"), F.col("key")).otherwise(_field("dimension", "string"))
    score = F.when(bare, F.try_variant_get("value", "$", "double")).when(F.coalesce(told, F.lit("")).rlike(NUMBERS), _field("score", "double"))
    part = F.when(~bare & ~F.col("shape").startswith("OBJECT"), "no record").when(dimension.isNull() | (F.trim(dimension) == ""), "no dimension").when(score.isNull(), "no score")
    return each.select(
        *keys, F.col("pos").alias("place"), F.coalesce("whole", F.when(F.col("whole").isNull(), part)).alias("reason"), dimension.alias("dimension"), score.alias("score"), _field("justification", "string").alias("justification"), _field("blockers", "array<string>").alias("blockers"),
        F.when(F.col("whole").isNotNull(), F.col("text")).otherwise(F.to_json("value")).alias("raw"),
    )


def taken(told: DataFrame) -> DataFrame:
    """keys, place, dimension, score, justification, blockers (none: an empty list)."""
    return told.where("reason is null").withColumn("blockers", F.coalesce("blockers", F.array().cast("array<string>"))).drop("reason", "raw")


def rejects(told: DataFrame) -> DataFrame:
    """keys, place, reason, raw."""
    return told.where("reason is not null").drop("dimension", "score", "justification", "blockers")


def account(told: DataFrame) -> DataFrame:
    """outcome ("taken", or a reason), n, texts: what became of all that was given."""
    return told.groupBy(F.coalesce("reason", F.lit("taken")).alias("outcome")).agg(F.count("*").alias("n"), F.count_if(F.col("place").isNull()).alias("texts"))
