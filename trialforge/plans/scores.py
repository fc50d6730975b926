"""Queries over scores and costs: loaders, raters, descriptive analytics, pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialforge.operators import analysis, scoring
from trialforge.plans.registry import query, rounded, sql
from trialforge.sources import adapter as A

DIMENSIONS = ["quality", "security", "performance"]
VARIANTS = ["v1", "v2a", "v3b", "v4", "v5"]
BUDGETS = [100_000.0, 500_000.0, 2_000_000.0]


def longs(spark, sf):
    return scoring.long_scores(A.evaluations(spark, sf), DIMENSIONS, ["design_id", "evaluator_run"])


def coherence(spark, sf):
    return analysis.coherence_per_design(A.coherence_checks(spark, sf))


@query(sql("SELECT * FROM scores", "scores"))
def score_view(spark, sf):
    return A.score_view(spark, sf)


@query(sql("SELECT * FROM costs", "costs"))
def cost_view(spark, sf):
    return A.cost_view(spark, sf)


@query(sql("SELECT * FROM scores WHERE variant_id IN ('v1', 'v4')", "scores"))
def score_view_of_variants(spark, sf):
    return A.score_view(spark, sf).where(F.col("variant_id").isin("v1", "v4"))


@query(sql("SELECT DISTINCT variant_id FROM runs WHERE status = 'completed'", "runs"))
def completed_variants(spark, sf):
    return A.runs(spark, sf).where("status = 'completed'").select("variant_id").distinct()


@query(sql("SELECT design_id, dimension, round(median(score), 6) AS median_score, count(*) AS n, round(max(score) - min(score), 6) AS score_range, count(*) >= 2 AND round(max(score) - min(score), 6) > 1.5 AS flagged FROM longs GROUP BY ALL", "longs"))
def design_medians(spark, sf):
    out = scoring.dimension_medians(longs(spark, sf)).withColumn("score_range", F.round("score_range", 6))
    return rounded(out.withColumn("flagged", (F.col("n") >= 2) & (F.col("score_range") > 1.5)))


@query(sql("SELECT design_id, dimension, round(max(score) - min(score), 6) AS score_range, array_to_string(list_transform(list_sort(list(score)), lambda x: printf('%.4f', x)), ',') AS scores FROM longs GROUP BY ALL HAVING count(*) >= 2 AND round(max(score) - min(score), 6) > 1.5", "longs"))
def disagreement_flags(spark, sf):
    out = scoring.disagreement_flags(longs(spark, sf))
    return out.withColumn("scores", F.array_join(F.transform("scores", lambda x: F.format_string("%.4f", x)), ","))


@query(sql("SELECT design_id, round(overall_median, 6) AS overall_median FROM medians", "medians"))
def overall_median(spark, sf):
    return rounded(scoring.overall_medians(A.evaluations(spark, sf)))


@query(
    """WITH b AS (SELECT l_orderkey AS design_id, l_returnflag || l_linestatus AS t FROM lineitem WHERE l_discount > 0.07)
    SELECT design_id, count(*) AS blocker_count, '["' || string_agg(t, '","' ORDER BY t) || '"]' AS blockers_json FROM b GROUP BY design_id"""
)
def blocker_union(spark, sf):
    rows = A.table(spark, sf, "lineitem").where("l_discount > 0.07").select(F.col("l_orderkey").alias("design_id"), F.array(F.concat("l_returnflag", "l_linestatus")).alias("nested"), F.array().cast("array<string>").alias("top"))
    return scoring.blocker_union(rows, "design_id", ["nested", "top"])


@query(sql("SELECT variant_id, substr(props, 1, 100) AS blocker, count(*) AS n FROM traces GROUP BY ALL", "traces"))
def blocker_histogram(spark, sf):
    return scoring.blocker_histogram(A.traces(spark, sf), "variant_id", "props")


@query(
    sql(
        """SELECT design_id, round(CASE WHEN n < 3 THEN NULL WHEN (q - s * s / n) / (n - 1) <= 1e-9 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - within_v / ((q - s * s / n) / (n - 1)))) END, 6) AS alpha FROM o""",
        "longs",
        p="SELECT design_id, dimension, count(*) AS n, var_samp(score) AS v, sum(score) AS s, sum(score * score) AS q FROM longs GROUP BY ALL",
        o="SELECT design_id, avg(v) AS within_v, sum(n)::DOUBLE AS n, sum(s) AS s, sum(q) AS q FROM p WHERE n >= 2 GROUP BY design_id",
    )
)
def alpha_proxy(spark, sf):
    return rounded(scoring.alpha_proxy(longs(spark, sf)))


@query(
    sql(
        """SELECT t.design_id, round(CASE WHEN expected > 0 THEN 1 - (total - 1) * observed / expected END, 6) AS alpha FROM t LEFT JOIN g USING (design_id)""",
        "longs",
        c0="SELECT design_id, dimension, score AS c, count(*) AS n FROM longs GROUP BY ALL",
        m0="SELECT design_id, dimension, sum(n) AS m FROM c0 GROUP BY ALL HAVING sum(n) >= 2",
        c1="SELECT c0.*, m FROM c0 JOIN m0 USING (design_id, dimension)",
        p="SELECT a.design_id, a.c, b.c AS k, sum(a.n * (b.n - CASE WHEN a.c = b.c THEN 1 ELSE 0 END) / (a.m - 1)) AS o FROM c1 a JOIN c1 b ON a.design_id = b.design_id AND a.dimension = b.dimension GROUP BY ALL",
        mg="SELECT design_id, c, sum(n)::DOUBLE AS n FROM c1 GROUP BY ALL",
        mu="SELECT *, sum(n) OVER (PARTITION BY design_id ORDER BY c) AS upto FROM mg",
        gr="SELECT a.design_id, a.c, b.c AS k, a.n AS n1, b.n AS n2, pow(b.upto - a.upto + a.n - (a.n + b.n) / 2, 2) AS d FROM mu a JOIN mu b ON a.design_id = b.design_id AND a.c < b.c",
        g="SELECT gr.design_id, sum(coalesce(o, 0) * d) AS observed, sum(n1 * n2 * d) AS expected FROM gr LEFT JOIN p ON p.design_id = gr.design_id AND p.c = gr.c AND p.k = gr.k GROUP BY ALL",
        t="SELECT design_id, sum(n) AS total FROM mg GROUP BY ALL",
    )
)
def krippendorff_ordinal(spark, sf):
    return rounded(scoring.ordinal_alpha(longs(spark, sf)))


@query(
    sql(
        "SELECT design_id, round(sum(s * w) / nullif(sum(w), 0), 6) AS ensemble_score, count(*) AS n_models FROM p GROUP BY design_id",
        "evaluations",
        p="SELECT design_id, evaluator_model, avg(overall_score) AS s, CASE evaluator_model WHEN 'm0' THEN 2.0::DOUBLE WHEN 'm1' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM evaluations GROUP BY ALL",
    )
)
def ensemble_score(spark, sf):
    return rounded(scoring.ensemble(A.evaluations(spark, sf), A.WEIGHTS))


@query(sql("SELECT design_id, round(sum(score * w) / sum(w), 6) AS weighted_overall FROM (SELECT *, CASE dimension WHEN 'quality' THEN 3.0::DOUBLE WHEN 'security' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM longs) GROUP BY design_id", "longs"))
def weighted_overall(spark, sf):
    return rounded(scoring.weighted_overall(longs(spark, sf), {"quality": 3.0, "security": 2.0, "performance": 1.0}))


@query(
    sql(
        """SELECT count(*) AS n_designs, round(avg(alpha), 6) AS mean_alpha, round(median(alpha), 6) AS median_alpha, round(avg(CASE WHEN alpha IS NOT NULL THEN CAST(alpha > 0.7 AS INT) END), 6) AS share_reliable, round(avg(CAST(flagged AS INT)), 6) AS disagreement_rate,
        (SELECT round(avg(sd), 6) FROM (SELECT stddev_pop(overall_score) AS sd FROM evaluations GROUP BY design_id HAVING count(*) >= 2)) AS mean_intra_std FROM d""",
        "evaluations",
        d="SELECT design_id, round(1 - (max(overall_score) - min(overall_score)) / 4, 6) AS alpha, max(overall_score) - min(overall_score) > 2 AS flagged FROM evaluations GROUP BY design_id",
    )
)
def evaluator_reliability(spark, sf):
    e = A.evaluations(spark, sf)
    spread = F.max("overall_score") - F.min("overall_score")
    return rounded(scoring.reliability(e.groupBy("design_id").agg(F.round(1 - spread / 4, 6).alias("alpha"), (spread > 2).alias("flagged")), e))


@query(sql("SELECT design_id, pairs_checked, contradictions, round(coherence_rate, 6) AS coherence_rate FROM coherence", "coherence"))
def coherence_rate(spark, sf):
    return rounded(coherence(spark, sf))


@query(sql("SELECT complexity, round(avg(coherence_rate), 6) AS mean_coherence, count(*) AS n FROM coherence JOIN scores USING (design_id) WHERE complexity IS NOT NULL GROUP BY complexity", "coherence", "scores"))
def coherence_by_complexity(spark, sf):
    rows = A.score_view(spark, sf).join(coherence(spark, sf), "design_id").where("complexity is not null")
    return rounded(rows.groupBy("complexity").agg(F.avg("coherence_rate").alias("mean_coherence"), F.count("*").alias("n")))


@query(sql("SELECT variant_id, count(*) AS n, CAST(sum(pairs_checked) AS BIGINT) AS pairs_checked, CAST(sum(contradictions) AS BIGINT) AS contradictions, round(avg(coherence_rate), 6) AS mean_rate, avg(coherence_rate) < 0.8 AS warning FROM coherence JOIN scores USING (design_id) GROUP BY variant_id", "coherence", "scores"))
def coherence_summary(spark, sf):
    rows = A.score_view(spark, sf).join(coherence(spark, sf), "design_id")
    return rounded(rows.groupBy("variant_id").agg(F.count("*").alias("n"), F.sum("pairs_checked").alias("pairs_checked"), F.sum("contradictions").alias("contradictions"), F.avg("coherence_rate").alias("mean_rate"), (F.avg("coherence_rate") < 0.8).alias("warning")))


@query(sql("SELECT count(*) AS contradiction_count FROM checks WHERE contradicts", "checks"))
def contradiction_count(spark, sf):
    return A.coherence_checks(spark, sf).where("contradicts").agg(F.count("*").alias("contradiction_count"))


@query(sql("SELECT variant_id, count(*) AS n, round(avg(overall_median), 6) AS mean_score, round(coalesce(stddev_samp(overall_median), 0), 6) AS std_score, round(coalesce(stddev_samp(overall_median), 0) / avg(overall_median), 6) AS cv FROM scores GROUP BY variant_id", "scores"))
def variance_by_variant(spark, sf):
    return rounded(analysis.variance(A.score_view(spark, sf)))


@query(
    sql(
        """SELECT variant_id, round(avg(overall_median), 6) AS mean_score, round(avg(total_cost_usd), 6) AS mean_cost, CAST(floor(avg(total_input_tokens + total_output_tokens)) AS BIGINT) AS mean_tokens,
        round(avg(overall_median) / avg(total_cost_usd), 9) AS quality_per_dollar, round(avg(overall_median) / (avg(total_input_tokens + total_output_tokens) / 1000), 6) AS quality_per_1k_tokens FROM scores JOIN (SELECT run_id, total_cost_usd, total_input_tokens, total_output_tokens FROM costs) USING (run_id) GROUP BY variant_id""",
        "scores",
        "costs",
    )
)
def token_efficiency(spark, sf):
    out = analysis.token_efficiency(A.score_view(spark, sf), A.cost_view(spark, sf))
    return out.select("variant_id", F.round("mean_score", 6).alias("mean_score"), F.round("mean_cost", 6).alias("mean_cost"), "mean_tokens", F.round("quality_per_dollar", 9).alias("quality_per_dollar"), F.round("quality_per_1k_tokens", 6).alias("quality_per_1k_tokens"))


_STATS = """count(overall_median) AS n, round(avg(overall_median), 6) AS mean_score, round(coalesce(stddev_samp(overall_median), 0), 6) AS std_score, round(quantile_cont(overall_median, 0.5), 6) AS median_score, min(overall_median) AS min_score, max(overall_median) AS max_score,
    round(quantile_cont(overall_median, 0.25), 6) AS q25, round(quantile_cont(overall_median, 0.75), 6) AS q75, round(avg(total_cost_usd), 6) AS mean_cost, CAST(floor(avg(tokens)) AS BIGINT) AS mean_tokens"""


@query(
    sql(
        f"SELECT variant_id, 'all' AS complexity, {_STATS} FROM b GROUP BY variant_id UNION ALL SELECT variant_id, complexity, {_STATS} FROM b WHERE complexity IS NOT NULL GROUP BY ALL",
        "scores",
        "costs",
        b="SELECT s.*, c.total_cost_usd, c.total_input_tokens + c.total_output_tokens AS tokens FROM scores s LEFT JOIN costs c USING (run_id)",
    ).replace("min(overall_median) AS", "round(min(overall_median), 6) AS").replace("max(overall_median) AS", "round(max(overall_median), 6) AS")
)
def descriptive_stats(spark, sf):
    return rounded(analysis.descriptive(A.score_view(spark, sf), A.cost_view(spark, sf)))


_PROFILE = """SELECT complexity, variant_id, count(*) AS n, avg(overall_median) AS mean_score, avg(total_cost_usd) AS mean_cost, quantile_cont(overall_median, 0.25) AS score_q25, quantile_cont(overall_median, 0.75) AS score_q75, quantile_cont(total_cost_usd, 0.25) AS cost_q25, quantile_cont(total_cost_usd, 0.75) AS cost_q75,
    coalesce(stddev_samp(overall_median), 0) / avg(overall_median) AS cv FROM scores JOIN (SELECT run_id, total_cost_usd FROM costs) USING (run_id) WHERE complexity IS NOT NULL GROUP BY ALL"""


@query(sql("SELECT complexity, variant_id, n, round(mean_score, 6) AS mean_score, round(mean_cost, 6) AS mean_cost, round(score_q25, 6) AS score_q25, round(score_q75, 6) AS score_q75, round(cost_q25, 6) AS cost_q25, round(cost_q75, 6) AS cost_q75, round(cv, 6) AS cv FROM p", "scores", "costs", p=_PROFILE))
def framework_stats(spark, sf):
    return rounded(analysis.variant_profile(A.score_view(spark, sf).where("complexity is not null"), A.cost_view(spark, sf), ["complexity"]))


@query(
    sql(
        "SELECT complexity, variant_id, round(mean_cost, 6) AS mean_cost, round(mean_score, 6) AS mean_score, coalesce(mean_score > max(mean_score) OVER (PARTITION BY complexity ORDER BY mean_cost, mean_score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS on_frontier FROM p",
        "scores",
        "costs",
        p=_PROFILE,
    )
)
def pareto_frontier(spark, sf):
    own = analysis.variant_profile(A.score_view(spark, sf).where("complexity is not null"), A.cost_view(spark, sf), ["complexity"])
    return rounded(analysis.pareto(own, by=["complexity"]).select("complexity", "variant_id", "mean_cost", "mean_score", "on_frontier"))


_MEANS = "SELECT variant_id, avg(overall_median) AS q, avg(total_cost_usd) AS c, quantile_cont(overall_median, 0.25) AS q25 FROM scores JOIN (SELECT run_id, total_cost_usd FROM costs) USING (run_id) GROUP BY variant_id"


@query(
    sql(
        """SELECT a.variant_id, round(a.q - b.q, 6) AS quality_gain, round(a.c - b.c, 6) AS extra_cost, round(a.c / b.c, 6) AS cost_multiple, round(CASE WHEN a.c - b.c > 0 THEN (a.q - b.q) / (a.c - b.c) ELSE 0 END, 9) AS quality_per_extra_dollar,
        a.q > b.q AND (a.c <= b.c OR (a.q - b.q) / nullif(a.c - b.c, 0) > 0) AS justified FROM m a, m b WHERE b.variant_id = 'v1' AND a.variant_id <> 'v1'""",
        "scores",
        "costs",
        m=_MEANS,
    )
)
def break_even(spark, sf):
    out = analysis.break_even(A.score_view(spark, sf), A.cost_view(spark, sf))
    return out.select("variant_id", *[F.round(c, 9 if c == "quality_per_extra_dollar" else 6).alias(c) for c in ("quality_gain", "extra_cost", "cost_multiple", "quality_per_extra_dollar")], "justified")


@query(sql("SELECT budget, variant_id, CAST(floor(budget / c) AS BIGINT) AS n_runs, round(q, 6) AS mean_score, round(q25, 6) AS q25_score FROM m, (VALUES (100000.0::DOUBLE), (500000.0::DOUBLE), (2000000.0::DOUBLE)) v(budget) WHERE budget >= c", "scores", "costs", m=_MEANS))
def budget_simulation(spark, sf):
    return rounded(analysis.budget_simulation(A.score_view(spark, sf), A.cost_view(spark, sf), BUDGETS))


@query(
    sql(
        "SELECT a.variant_id, a.dimension, round(a.m, 6) AS median_score, round(a.m - coalesce(b.m, 0), 6) AS delta FROM d a LEFT JOIN d b ON a.dimension = b.dimension AND b.variant_id = 'v1' WHERE a.variant_id <> 'v1'",
        "scores",
        "longs",
        d="SELECT variant_id, dimension, median(score) AS m FROM longs JOIN (SELECT design_id, variant_id FROM scores) USING (design_id) GROUP BY ALL",
    )
)
def dimension_delta(spark, sf):
    rows = longs(spark, sf).join(A.score_view(spark, sf).select("design_id", "variant_id"), "design_id")
    return rounded(analysis.dimension_delta(rows))


@query(
    sql(
        "SELECT variant_id, round(avg(CASE WHEN dimension = 'performance' THEN score END), 6) AS performance, round(avg(CASE WHEN dimension = 'quality' THEN score END), 6) AS quality, round(avg(CASE WHEN dimension = 'security' THEN score END), 6) AS security FROM longs JOIN (SELECT design_id, variant_id FROM scores) USING (design_id) GROUP BY variant_id",
        "scores",
        "longs",
    )
)
def dimension_pivot(spark, sf):
    """Scores written as JSON of both shapes, read back, and pivoted."""
    e = A.evaluations(spark, sf)
    record = lambda d: F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score"))
    listed = F.to_json(F.array(*[record(d) for d in DIMENSIONS]))
    mapped = F.to_json(F.create_map(*[x for d in DIMENSIONS for x in (F.lit(d), F.struct(F.col(d).alias("score")))]))
    own = e.select("design_id", F.when(F.col("evaluator_run") % 2 == 0, listed).otherwise(mapped).alias("json"))
    rows = scoring.scores_from_json(own, "json", ["design_id"]).join(A.score_view(spark, sf).select("design_id", "variant_id"), "design_id")
    return rounded(analysis.pivoted(rows, "variant_id", "dimension", sorted(DIMENSIONS), "score"))


def _pivot_sql(index: str, column: str, values: list[str], value: str, table: str, *views: str) -> str:
    cells = ", ".join(f"round(avg(CASE WHEN {column} = '{v}' THEN {value} END), 6) AS {v}" for v in values)
    return sql(f"SELECT {index}, {cells} FROM {table} WHERE {index} IS NOT NULL GROUP BY {index}", *views)


@query(_pivot_sql("complexity", "variant_id", VARIANTS, "overall_median", "scores", "scores"))
def complexity_pivot(spark, sf):
    return rounded(analysis.pivoted(A.score_view(spark, sf).where("complexity is not null"), "complexity", "variant_id", VARIANTS, "overall_median"))


@query(_pivot_sql("task_id", "variant_id", VARIANTS, "overall_median", "scores", "scores"))
def task_pivot(spark, sf):
    return rounded(analysis.pivoted(A.score_view(spark, sf), "task_id", "variant_id", VARIANTS, "overall_median"))


@query(_pivot_sql("variant_id", "task_id", ["t0", "t1", "t2", "t3", "t4"], "coherence_rate", "scores JOIN coherence USING (design_id)", "scores", "coherence"))
def coherence_pivot(spark, sf):
    return rounded(analysis.pivoted(A.score_view(spark, sf).join(coherence(spark, sf), "design_id"), "variant_id", "task_id", ["t0", "t1", "t2", "t3", "t4"], "coherence_rate"))


@query(
    sql(
        "SELECT complexity, variant_id, round(low, 6) AS low, round(q25, 6) AS q25, round(m, 6) AS median_score, round(q75, 6) AS q75, round(high, 6) AS high, row_number() OVER (PARTITION BY complexity ORDER BY m DESC, variant_id) AS place FROM b",
        "scores",
        b="SELECT complexity, variant_id, min(overall_median) AS low, quantile_cont(overall_median, 0.25) AS q25, quantile_cont(overall_median, 0.5) AS m, quantile_cont(overall_median, 0.75) AS q75, max(overall_median) AS high FROM scores WHERE complexity IS NOT NULL GROUP BY ALL",
    )
)
def boxplot_by_complexity(spark, sf):
    return rounded(analysis.boxplot(A.score_view(spark, sf).where("complexity is not null"), ["complexity", "variant_id"]))


@query(
    sql(
        "SELECT variant_id, round(low, 6) AS low, round(q25, 6) AS q25, round(m, 6) AS median_score, round(q75, 6) AS q75, round(high, 6) AS high, row_number() OVER (ORDER BY m DESC, variant_id) AS place FROM b",
        "scores",
        b="SELECT variant_id, min(overall_median) AS low, quantile_cont(overall_median, 0.25) AS q25, quantile_cont(overall_median, 0.5) AS m, quantile_cont(overall_median, 0.75) AS q75, max(overall_median) AS high FROM scores GROUP BY ALL",
    )
)
def boxplot(spark, sf):
    return rounded(analysis.boxplot(A.score_view(spark, sf), ["variant_id"]))


@query(
    sql(
        "SELECT variant_id, count(*) AS n, round(avg(overall_median), 6) AS mean_score, round(avg(total_cost_usd), 6) AS mean_cost, round(quantile_cont(overall_median, 0.25), 6) AS score_q25, round(quantile_cont(overall_median, 0.75), 6) AS score_q75, round(quantile_cont(total_cost_usd, 0.25), 6) AS cost_q25, round(quantile_cont(total_cost_usd, 0.75), 6) AS cost_q75 FROM scores JOIN (SELECT run_id, total_cost_usd FROM costs) USING (run_id) GROUP BY variant_id",
        "scores",
        "costs",
    )
)
def cost_quality_scatter(spark, sf):
    return rounded(analysis.variant_profile(A.score_view(spark, sf), A.cost_view(spark, sf), []).drop("cv"))


@query(sql("SELECT n, round((b - s * s / n) / (q - s * s / n), 6) AS eta_squared FROM (SELECT CAST(sum(n) AS BIGINT) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM (SELECT variant_id, count(*) AS n, sum(overall_median) AS s, sum(overall_median * overall_median) AS q FROM scores GROUP BY 1))", "scores"))
def eta_squared(spark, sf):
    return rounded(analysis.eta_squared(A.score_view(spark, sf)))


@query(
    sql(
        "SELECT design_id, variant_id, overall_median, label FROM (SELECT *, CASE WHEN gd <= 3 THEN 'top' WHEN gu <= 3 THEN 'bottom' WHEN d = 1 THEN 'variant_best' WHEN u = 1 THEN 'variant_worst' END AS label FROM r) WHERE label IS NOT NULL",
        "scores",
        r="SELECT design_id, variant_id, overall_median, row_number() OVER (ORDER BY overall_median DESC, design_id) AS gd, row_number() OVER (ORDER BY overall_median, design_id) AS gu, row_number() OVER (PARTITION BY variant_id ORDER BY overall_median DESC, design_id) AS d, row_number() OVER (PARTITION BY variant_id ORDER BY overall_median, design_id) AS u FROM scores",
    )
)
def case_study(spark, sf):
    return analysis.case_studies(A.score_view(spark, sf))


@query(
    """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    p AS (SELECT a.label, list_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id)
    SELECT CAST(label AS BIGINT) AS label, (SELECT count(*) FROM u WHERE u.label = p.label) AS n, round(avg(c), 4) AS mean_similarity, round(1 - avg(c), 4) AS diversity FROM p GROUP BY label"""
)
def novelty_cosine(spark, sf):
    return analysis.novelty(A.table(spark, sf, "embeddings").withColumn("label", F.col("label").cast("long")), ["label"])
