"""Queries of the ingest of raters' JSON: what is taken, what is rejected and why, and the account of both."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialforge.operators import ingest
from trialforge.plans.registry import query, sql
from trialforge.sources import adapter as A

#: A text in one of eight shapes for each call, with its number in it.
SHAPES = ['[{"dimension":"a","score":%,"blockers":["x","%"]},{"dimension":"b"}]', '{"a": %, "b": {"score": %.5, "justification": "j%"}}', "not json %", "%", "[]", None, '[{"score": %}, 7, {"dimension": "c", "score": 0.25}]', '{"a": "x", "b": {"score": "%"}, "": 3}']
_R = {
    0: "(0, NULL, 'a', k::DOUBLE, NULL, 'x,' || k), (1, 'no score', 'b', NULL, NULL, NULL)",
    1: "(0, NULL, 'a', k::DOUBLE, NULL, ''), (1, NULL, 'b', k + 0.5::DOUBLE, 'j' || k, '')",
    2: "(NULL, 'malformed', NULL, NULL, NULL, NULL)",
    3: "(NULL, 'no list or map', NULL, NULL, NULL, NULL)",
    4: "(NULL, 'empty', NULL, NULL, NULL, NULL)",
    5: "(NULL, 'missing', NULL, NULL, NULL, NULL)",
    6: "(0, 'no dimension', NULL, NULL, NULL, NULL), (1, 'no record', NULL, NULL, NULL, NULL), (2, NULL, 'c', 0.25::DOUBLE, NULL, '')",
    7: "(0, 'no dimension', '', 3, NULL, NULL), (1, 'no record', NULL, NULL, NULL, NULL), (2, 'no score', NULL, NULL, NULL, NULL)",
}
_TOLD = " UNION ALL ".join(f"SELECT trace_id, p.* FROM traces, LATERAL (SELECT * FROM (VALUES {rows}) v(place, reason, dimension, score, justification, blockers)) p WHERE trace_id % 8 = {i}" for i, rows in _R.items())


def told(spark, sf):
    rows = A.traces(spark, sf)
    text = F.lit(None).cast("string")
    for i, shape in enumerate(SHAPES):
        text = F.when(F.col("trace_id") % 8 == i, F.lit(None).cast("string") if shape is None else F.replace(F.lit(shape), F.lit("%"), F.col("k").cast("string"))).otherwise(text)
    return ingest.elements(rows.select("trace_id", text.alias("answer")), "answer", ["trace_id"])


@query(sql(f"SELECT trace_id, place, dimension, score, justification, blockers FROM ({_TOLD}) WHERE reason IS NULL", "traces"))
def ingest_taken(spark, sf):
    """Scores taken from raters' texts in either shape."""
    return ingest.taken(told(spark, sf)).withColumn("blockers", F.array_join("blockers", ","))


@query(sql(f"SELECT trace_id, place, reason FROM ({_TOLD}) WHERE reason IS NOT NULL", "traces"))
def ingest_rejects(spark, sf):
    """What was not taken, and why."""
    return ingest.rejects(told(spark, sf)).drop("raw")


@query(sql(f"SELECT coalesce(reason, 'taken') AS outcome, count(*) AS n, count(*) FILTER (place IS NULL) AS texts FROM ({_TOLD}) GROUP BY ALL", "traces"))
def ingest_account(spark, sf):
    """All texts and elements by what became of them."""
    return ingest.account(told(spark, sf))
