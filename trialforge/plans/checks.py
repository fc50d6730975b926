"""The data-integrity checks over conversations, documents, benchmark passages and raters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.functions import parsing
from trialforge.operators import contamination, integrity
from trialforge.plans.registry import query, sql
from trialforge.sources import adapter as A


def _summary_sql(name: str, checked: str) -> str:
    return f"SELECT '{name}' AS check_name, coalesce(sum(CAST(failed AS INT)), 0) = 0 AS passed, count(*) AS total, CAST(coalesce(sum(CAST(failed AS INT)), 0) AS BIGINT) AS failures FROM ({checked})"


def prompts(spark, sf):
    """Turns of conversations: what a user says is a prompt and what an assistant says a response."""
    m = A.messages(spark, sf)
    return m.select("run_id", "round", F.col("agent_role").alias("step"), "agent_role", "task_id", F.col("text").alias("prompt_text"), F.col("text").alias("response_text"), F.col("round").alias("trace_id"))


def _words(column: str, words: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower({column}), '{w}') AS INT)" for w in words)


CHECKS: dict[str, tuple] = {}


def check(name: str, checked_sql: str, *views: str, **more: str):
    """Registers check_<name>: the summary of the frame f(spark, sf), with the summary of the SQL."""

    def keep(f):
        def run(spark, sf) -> DataFrame:
            return integrity.summary(name, f(spark, sf))

        CHECKS[name] = (f, sql(_summary_sql(name, checked_sql), *views, **more))
        query(CHECKS[name][1], f"check_{name}")(run)
        return f

    return keep


_VARIABLE = r"\{\{\s*(" + "|".join(parsing.TEMPLATE_VARIABLES) + r")\s*\}\}"


@check("template_variables", f"SELECT regexp_matches(p, '{_VARIABLE}') AS failed FROM p", p="SELECT CASE WHEN doc_id % 9 = 0 THEN text || ' {{ review }}' WHEN doc_id % 9 = 1 THEN text || ' {{order_id}}' ELSE text END AS p FROM documents")
def template_variables(spark, sf):
    n = F.col("doc_id") % 9
    rows = A.table(spark, sf, "documents").select("doc_id", F.when(n == 0, F.concat("text", F.lit(" {{ review }}"))).when(n == 1, F.concat("text", F.lit(" {{order_id}}"))).otherwise(F.col("text")).alias("prompt_text"))
    return integrity.template_variables(rows)


@check("empty_prompts", "SELECT text IS NULL OR trim(text) = '' AS failed FROM messages WHERE agent_role = 'user'", "messages")
def empty_prompts(spark, sf):
    return integrity.blank_text(prompts(spark, sf).where("step = 'user'"), "prompt_text")


@check("empty_responses", "SELECT text IS NULL OR trim(text) = '' AS failed FROM messages WHERE agent_role = 'assistant'", "messages")
def empty_responses(spark, sf):
    return integrity.blank_text(prompts(spark, sf).where("step = 'assistant'"), "response_text")


@check("system_name", "SELECT NOT contains(lower(text), CASE run_id % 2 WHEN 0 THEN 'the' ELSE 'die' END) AS failed FROM messages WHERE round = 0 AND text IS NOT NULL", "messages")
def system_name(spark, sf):
    rows = prompts(spark, sf).withColumn("step", F.lit("generation")).withColumn("task_config", F.when(F.col("run_id") % 2 == 0, '{"variables": {"system_name": "The"}}').otherwise('{"system_name": "DIE"}'))
    return integrity.system_name(rows)


@check("perspective_injection", f"SELECT {_words('text', parsing.PERSPECTIVE_WORDS)} = 0 AS failed FROM documents WHERE source IN ('src1', 'src2') AND text IS NOT NULL")
def perspective(spark, sf):
    s = F.col("source")
    rows = A.table(spark, sf, "documents").select("doc_id", F.when(s == "src1", "Reviewer").when(s == "src2", "the_specialist").otherwise("leader").alias("agent_role"), F.col("text").alias("prompt_text"))
    return integrity.perspective(rows)


@check("design_words", f"SELECT {_words('text', parsing.DESIGN_WORDS)} < 2 AS failed FROM documents WHERE text IS NOT NULL")
def design_words(spark, sf):
    return integrity.design_words(A.table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt_text")))


_TEXTS = "SELECT run_id, round, max(text) AS text FROM messages WHERE agent_role = 'assistant' AND length(text) >= {} GROUP BY ALL"


@check("review_has_prior_design", "SELECT NOT contains(m.text, substr(d.text, 501, 200)) AS failed FROM messages m JOIN d ON d.run_id = m.run_id AND d.round + 1 = m.round WHERE m.agent_role = 'user'", "messages", d=_TEXTS.format(700))
def review_has_prior_design(spark, sf):
    m = prompts(spark, sf)
    return integrity.contains_snippet(m.where("step = 'user'"), m.where("step = 'assistant'").select("run_id", "round", F.col("response_text").alias("text")), 500, 700, [1])


@check(
    "revision_has_review",
    "SELECT NOT contains(m.text, substr(coalesce(a.text, b.text), 101, 200)) AS failed FROM messages m LEFT JOIN d a ON a.run_id = m.run_id AND a.round = m.round LEFT JOIN d b ON b.run_id = m.run_id AND b.round + 1 = m.round WHERE coalesce(a.text, b.text) IS NOT NULL",
    "messages",
    d=_TEXTS.format(300),
)
def revision_has_review(spark, sf):
    m = prompts(spark, sf)
    return integrity.contains_snippet(m, m.where("step = 'assistant'").select("run_id", "round", F.col("response_text").alias("text")), 100, 300, [0, 1])


@check("review_has_generation", "SELECT NOT contains(m.text, substr(d.text, 101, 200)) AS failed FROM messages m JOIN d ON d.run_id = m.run_id AND d.round = m.round", "messages", d=_TEXTS.format(300))
def review_has_generation(spark, sf):
    m = prompts(spark, sf)
    return integrity.contains_snippet(m, m.where("step = 'assistant'").select("run_id", "round", F.col("response_text").alias("text")), 100, 300, [0])


@check("prompt_growth", "SELECT size < 0.5 * before AS failed FROM (SELECT *, lag(size) OVER (PARTITION BY run_id ORDER BY round) AS before FROM (SELECT run_id, round, max(length(text)) AS size FROM messages GROUP BY ALL)) WHERE before IS NOT NULL", "messages")
def prompt_growth(spark, sf):
    return integrity.prompt_growth(prompts(spark, sf))


@check("parallel_agents_differ", "SELECT count(DISTINCT props) = 1 AS failed FROM traces GROUP BY run_id, step HAVING count(*) >= 2", "traces")
def parallel_agents_differ(spark, sf):
    return integrity.parallel_differ(A.traces(spark, sf).select("run_id", F.lit(0).alias("round"), "step", F.col("props").alias("prompt_text")))


@check("evaluation_values", "SELECT value > 10 OR event_id % 7 = 0 AS failed FROM events")
def evaluation_values(spark, sf):
    n = F.col("event_id") % 7
    text = F.when(n == 0, "[1, 2]").when(n == 1, '[{"dimension": "a", "score": 1}]').otherwise(F.col("props"))
    return integrity.evaluation_values(A.table(spark, sf, "events").select("event_id", F.col("value").alias("overall_score"), text.alias("dimension_scores")))


@check("evaluation_coverage", "SELECT count(e.design_id) < 3 AS failed FROM runs LEFT JOIN evaluations e ON e.design_id = run_id WHERE status = 'completed' GROUP BY run_id", "runs", "evaluations")
def evaluation_coverage(spark, sf):
    designs = A.runs(spark, sf).where("status = 'completed'").select(F.col("run_id").alias("design_id"))
    return integrity.evaluation_coverage(designs, A.evaluations(spark, sf))


@check("coherence_fields", "SELECT section_pair IS NULL OR trim(section_pair) = '' AS failed FROM checks UNION ALL SELECT explanation IS NULL OR trim(explanation) = '' FROM checks", "checks")
def coherence_fields(spark, sf):
    return integrity.coherence_fields(A.coherence_checks(spark, sf))


@check(
    "context_chain",
    "SELECT NOT coalesce(bool_or(contains(q.text, substr(l.text, 1, 200))), false) AS failed FROM l JOIN n USING (run_id, round) LEFT JOIN messages q ON q.run_id = l.run_id AND q.round = n.next WHERE n.next IS NOT NULL AND length(l.text) >= 200 GROUP BY l.run_id, l.round",
    "messages",
    l="SELECT run_id, round, arg_max(text, (agent_role, round)) AS text FROM messages WHERE text IS NOT NULL GROUP BY ALL",
    n="SELECT run_id, round, lead(round) OVER (PARTITION BY run_id ORDER BY round) AS next FROM (SELECT DISTINCT run_id, round FROM messages)",
)
def context_chain(spark, sf):
    return integrity.context_chain(prompts(spark, sf))


_SNIPPETS = "SELECT 't' || CAST(item_id % 5 AS VARCHAR) AS task_id, substr(text, 21, 60) AS snippet FROM benchmark WHERE length(text) >= 80"
_PROMPTS = "SELECT doc_id, 't' || CAST(doc_id % 5 AS VARCHAR) AS own, text FROM documents WHERE text IS NOT NULL"
_MET = "SELECT DISTINCT doc_id, s.task_id FROM d JOIN s ON s.task_id <> d.own AND contains(d.text, s.snippet)"


def _contaminated(spark, sf):
    """Documents as prompts, and snippets of the benchmark's passages, by task."""
    snippets = A.table(spark, sf, "benchmark").where(F.char_length("text") >= 80).select(F.concat(F.lit("t"), (F.col("item_id") % 5).cast("string")).alias("task_id"), parsing.snippet(F.col("text"), 20, 80).alias("snippet"))
    docs = A.table(spark, sf, "documents").select(F.col("doc_id").alias("prompt_id"), F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string")).alias("task_id"), "text")
    return docs, snippets


@check(
    "cross_task_contamination",
    "SELECT doc_id, t.task_id, m.doc_id IS NOT NULL AS failed FROM d JOIN (SELECT DISTINCT task_id FROM s) t ON t.task_id <> d.own LEFT JOIN m USING (doc_id, task_id)",
    s=_SNIPPETS,
    d=_PROMPTS,
    m=_MET,
)
def cross_task_contamination(spark, sf):
    return contamination.checked(*_contaminated(spark, sf))


@query(f"WITH s AS ({_SNIPPETS}), d AS ({_PROMPTS}) SELECT doc_id AS prompt_id, task_id FROM ({_MET})")
def check_contamination(spark, sf):
    """Benchmark passages of other tasks in documents."""
    return contamination.contamination(*_contaminated(spark, sf))


@query("SELECT n_name AS name, CAST(count(r_name) AS BIGINT) AS n, count(r_name) = 0 AS failed FROM nation LEFT JOIN region ON starts_with(r_name, n_name) OR starts_with(n_name, r_name) GROUP BY n_name")
def check_references(spark, sf):
    names = A.table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    return integrity.prefix_references(names, A.table(spark, sf, "region").select(F.col("r_name").alias("known")))


@query(" UNION ALL ".join(f"SELECT * FROM ({c[1]})" for c in CHECKS.values()))
def check_all(spark, sf):
    """All checks with a summary, one row each."""
    return reduce(DataFrame.unionByName, [integrity.summary(name, f(spark, sf)) for name, (f, _) in CHECKS.items()])
