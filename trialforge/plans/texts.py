"""Queries over texts: parsing, fingerprints, convergence, snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialforge.functions import parsing
from trialforge.operators import matching, ranking, timeline
from trialforge.plans.registry import query, sql
from trialforge.sources import adapter as A

#: Replies in the shapes that models give, by event.
_REPLY = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN 'Here: ```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'so ' || props || ' end' WHEN 3 THEN '{"k": ' WHEN 4 THEN 'no object' END"""


def replies(spark, sf):
    e, n = A.table(spark, sf, "events"), F.col("event_id") % 6
    text = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("Here: ```json\n"), "props", F.lit("\n```"))).when(n == 2, F.concat(F.lit("so "), "props", F.lit(" end"))).when(n == 3, '{"k": ').when(n == 4, "no object")
    return e.select("event_id", text.alias("reply"), "value", "event_type")


@query("SELECT event_id, CASE WHEN event_id % 6 < 3 THEN CAST(props ->> '$.k' AS BIGINT) END AS k FROM events")
def json_extract(spark, sf):
    return replies(spark, sf).select("event_id", F.get_json_object(parsing.json_text(F.col("reply")), "$.k").cast("long").alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'accept' ELSE 'reject' END AS verdict, CASE WHEN event_id % 2 = 0 THEN 'CONVERGED' WHEN event_id % 5 = 0 THEN 'NOT_CONVERGED' END AS status, event_type AS rest FROM events")
def verdict_parse(spark, sf):
    e, n = A.table(spark, sf, "events"), F.col("event_id")
    text = F.when(n % 3 == 0, "fine.\nVerdict:  accept now").when(n % 3 == 1, "VERDICT: REJECT").otherwise("none")
    status = F.concat("event_type", F.when(n % 2 == 0, "\nstatus: converged").when(n % 5 == 0, "\nSTATUS: NOT_CONVERGED").otherwise(""))
    return e.select("event_id", parsing.verdict(text).alias("verdict"), parsing.convergence_status(status).alias("status"), parsing.without_status(status).alias("rest"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN round(value, 2) WHEN 1 THEN least(10.0, round(value, 1)) WHEN 2 THEN least(10.0, floor(value)) ELSE 5.0 END AS score, event_id % 4 < 3 AS found FROM events"""
)
def quick_scores(spark, sf):
    e, n = A.table(spark, sf, "events"), F.col("event_id") % 4
    number = lambda c: c.cast("string")
    text = F.when(n == 0, F.concat(F.lit('ok {"overall_score": '), number(F.round("value", 2)), F.lit("} done"))).when(n == 1, F.concat(F.lit("Overall score: "), number(F.round("value", 1)), F.lit(" / 10"))).when(n == 2, F.concat(F.lit("score "), number(F.floor("value")))).otherwise("nothing")
    score, found = parsing.quick_score(text)
    return e.select("event_id", score.alias("score"), found.alias("found"))


@query("SELECT event_id, event_id % 3 = 0 OR event_id % 3 = 2 AS contradicts FROM events")
def coherence_parse(spark, sf):
    e, n = A.table(spark, sf, "events"), F.col("event_id") % 3
    text = F.when(n == 0, 'x {"contradicts": true} y').when(n == 1, '{"contradicts": false, "explanation": "contradicts nothing"}').otherwise("It CONTRADICTS the other")
    return e.select("event_id", parsing.contradiction(text).alias("contradicts"))


@query("SELECT doc_id, substr(text, 501, 200) AS middle, substr(text, 1, 100) AS head, length(text) > 700 AS long_text FROM documents")
def snippets(spark, sf):
    d, t = A.table(spark, sf, "documents"), F.col("text")
    return d.select("doc_id", parsing.snippet(t, 500, 700).alias("middle"), parsing.snippet(t, 0, 100).alias("head"), (F.char_length(t) > 700).alias("long_text"))


_PRINT = "substr(sha256(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')), 1, 20)"


@query(f"SELECT doc_id, {_PRINT} AS fingerprint, substr(sha256(text), 1, 16) AS prompt_hash FROM documents")
def fingerprints(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", parsing.fingerprint(F.col("text")).alias("fingerprint"), parsing.prompt_hash(F.col("text")).alias("prompt_hash"))


@query(
    f"""WITH d AS (SELECT doc_id, {_PRINT} AS f FROM documents), a AS (SELECT doc_id AS request_id, f, row_number() OVER (PARTITION BY f ORDER BY doc_id) AS n FROM d), b AS (SELECT doc_id AS reply_id, f, row_number() OVER (PARTITION BY f ORDER BY doc_id) AS n FROM d WHERE doc_id % 5 <> 0)
    SELECT request_id, reply_id FROM a LEFT JOIN b USING (f, n)"""
)
def fingerprint_match(spark, sf):
    d = A.table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"), "text")
    return matching.by_fingerprint(d, d.where("request_id % 5 <> 0").withColumnRenamed("request_id", "reply_id"))


@query("SELECT DISTINCT p_type, split_part(p_type, '_', 1) AS short, nullif(regexp_extract('v' || CAST(p_size AS VARCHAR) || 'a_x', '^(v[0-9]+)', 1), '') AS parent FROM part")
def variant_ids(spark, sf):
    p = A.table(spark, sf, "part")
    return p.select("p_type", parsing.short_id(F.col("p_type")).alias("short"), ranking.parent_variant(F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("a_x"))).alias("parent")).distinct()


@query(
    sql(
        "SELECT run_id, count(*) AS n_points, CAST(CASE WHEN max(reach) = 0 THEN 0 ELSE coalesce(min(CASE WHEN i > 0 AND step < 0.05 * reach THEN i END), count(*) - 1) END AS BIGINT) AS plateau FROM (SELECT run_id, row_number() OVER w - 1 AS i, abs(length(text) - lag(length(text)) OVER w) AS step, max(length(text)) OVER (PARTITION BY run_id) - min(length(text)) OVER (PARTITION BY run_id) AS reach FROM messages WINDOW w AS (PARTITION BY run_id ORDER BY round, length(text))) GROUP BY run_id HAVING count(*) >= 2",
        "messages",
    )
)
def convergence_plateau(spark, sf):
    points = A.messages(spark, sf).withColumn("size", F.char_length("text"))
    return timeline.convergence(points, ["run_id"], ["round", "size"], "size")


@query(
    sql(
        "SELECT run_id, round, size, before FROM (SELECT *, lag(size) OVER (PARTITION BY run_id ORDER BY round) AS before FROM (SELECT run_id, round, max(length(text)) AS size FROM messages GROUP BY ALL)) WHERE size < 0.5 * before",
        "messages",
    )
)
def size_drops(spark, sf):
    rounds = A.messages(spark, sf).groupBy("run_id", "round").agg(F.max(F.char_length("text")).cast("long").alias("size"))
    return timeline.size_drops(rounds)


@query(sql("SELECT run_id, string_agg('- ' || agent_role, chr(10) ORDER BY round) AS bullets FROM messages GROUP BY run_id", "messages"))
def bullet_lists(spark, sf):
    own = A.messages(spark, sf).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("round", "agent_role"))).alias("m"))
    return own.select("run_id", parsing.bullets(F.transform("m", lambda x: x["agent_role"])).alias("bullets"))
