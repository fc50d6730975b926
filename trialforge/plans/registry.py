"""Registration of queries with their SQL, and the SQL of the adapter's views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

VIEWS = {
    "tasks": "SELECT * FROM (VALUES ('t0', 'simple'), ('t1', 'simple'), ('t2', 'medium'), ('t3', 'complex')) v(task_id, complexity)",
    "runs": """SELECT o_orderkey AS run_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'v1' WHEN '2-HIGH' THEN 'v2a' WHEN '3-MEDIUM' THEN 'v3b' WHEN '4-NOT SPECIFIED' THEN 'v4' WHEN '5-LOW' THEN 'v5' END AS variant_id,
        't' || CAST(n_regionkey AS VARCHAR) AS task_id, CAST(year(o_orderdate) AS BIGINT) AS repetition, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' WHEN 'O' THEN 'running' END AS status, o_totalprice AS total_cost_usd,
        CAST(floor(o_totalprice) AS BIGINT) AS total_input_tokens, CAST(floor(o_totalprice / 2) AS BIGINT) AS total_output_tokens, CAST(o_custkey % 997 AS DOUBLE) AS duration_seconds, o_orderdate AS started_at
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "evaluations": """SELECT l_orderkey AS design_id, CAST(l_linenumber AS BIGINT) AS evaluator_run, 'm' || CAST(l_suppkey % 3 AS VARCHAR) AS evaluator_model, l_partkey AS rater_key,
        round(1 + l_quantity * 0.08::DOUBLE, 4) AS overall_score, round(l_quantity / 10, 4) AS quality, round(5 - l_discount * 20, 4) AS security, round(1 + l_tax * 40, 4) AS performance FROM lineitem""",
    "medians": "SELECT design_id, median(overall_score) AS overall_median, count(*) AS n_raters FROM evaluations GROUP BY design_id",
    "scores": """SELECT variant_id, r.task_id, repetition, run_id AS design_id, run_id, overall_median, complexity FROM runs r JOIN medians m ON m.design_id = r.run_id LEFT JOIN tasks t ON t.task_id = r.task_id WHERE status = 'completed'""",
    "costs": "SELECT variant_id, task_id, repetition, run_id, total_cost_usd, total_input_tokens, total_output_tokens, duration_seconds FROM runs WHERE status = 'completed'",
    "longs": """SELECT design_id, evaluator_run, dimension, score FROM (SELECT design_id, evaluator_run, 'quality' AS dimension, quality AS score FROM evaluations UNION ALL SELECT design_id, evaluator_run, 'security', security FROM evaluations UNION ALL SELECT design_id, evaluator_run, 'performance', performance FROM evaluations)""",
    "checks": "SELECT l_orderkey AS design_id, 's' || l_linenumber || '|s' || (l_linenumber + 1) AS section_pair, l_discount > 0.08 AS contradicts, l_returnflag AS explanation FROM lineitem",
    "coherence": "SELECT design_id, count(*) AS pairs_checked, CAST(sum(CASE WHEN contradicts THEN 1 ELSE 0 END) AS BIGINT) AS contradictions, 1 - sum(CASE WHEN contradicts THEN 1 ELSE 0 END) / count(*) AS coherence_rate FROM checks GROUP BY design_id",
    "traces": """SELECT event_id AS trace_id, user_id AS run_id, 'v' || CAST(user_id % 5 + 1 AS VARCHAR) AS variant_id, 'agent_' || CAST(event_id % 4 AS VARCHAR) AS agent_id, CASE WHEN event_id % 4 = 0 THEN 'leader' ELSE 'reviewer' END AS agent_role, event_type AS step,
        epoch_us(ts) AS started_us, epoch_us(ts) + CAST(round(value * 10000000) AS BIGINT) AS ended_us, CAST(props ->> '$.k' AS BIGINT) AS k, value AS cost_usd, props FROM events""",
    "messages": "SELECT conv_id AS run_id, turn AS round, role AS agent_role, text, 't' || CAST(conv_id % 5 AS VARCHAR) AS task_id, 'v' || CAST(conv_id % 4 + 1 AS VARCHAR) AS variant_id FROM conversations",
    "cells": "SELECT variant_id, task_id, repetition, arg_min(overall_median, design_id) AS v FROM scores GROUP BY ALL",
    "whole": "SELECT c.* FROM cells c JOIN (SELECT task_id, repetition FROM cells GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT variant_id) FROM cells)) b USING (task_id, repetition)",
    "ranked": "SELECT *, rank() OVER (PARTITION BY task_id, repetition ORDER BY v DESC) + (count(*) OVER (PARTITION BY task_id, repetition, v) - 1) / 2.0::DOUBLE AS r FROM whole",
}
NEEDS = {"medians": ["evaluations"], "scores": ["runs", "medians", "tasks"], "costs": ["runs"], "longs": ["evaluations"], "coherence": ["checks"], "cells": ["scores"], "whole": ["cells"], "ranked": ["whole"]}


def sql(body: str, *views: str, **more: str) -> str:
    """body under the views it needs, in order, and further ones."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for v in views:
        need(v)
    parts = [f"{v} AS ({VIEWS[v]})" for v in order] + [f"{k} AS ({v})" for k, v in more.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def query(oracle: str | None = None, name: str | None = None):
    """Registers a query (spark, sf_dir) under its function's name, with its SQL."""

    def keep(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLE_SQL[name or f.__name__] = oracle
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
