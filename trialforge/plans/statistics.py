"""Queries of rank statistics. Statistics without p-values have SQL; p-values are held against known values in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialforge.operators import decisions, ranking
from trialforge.plans.registry import VIEWS, query, rounded, sql
from trialforge.plans.scores import coherence, longs
from trialforge.sources import adapter as A
from trialforge.sources.scratch import stored


#: DuckDB has no error function: upper tails by Simpson's rule over 600 steps.
_STEPS = "list_sum(list_transform(range(601), lambda i: CASE WHEN i IN (0, 600) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {}))"


def _normal_upper(z: str) -> str:
    return f"(0.5 - ({z}) / 1800 / sqrt(2 * pi()) * {_STEPS.format(f'exp(-0.5 * pow(({z}) * i / 600, 2))')})"


def _t_two_sided(t: str, df: str) -> str:
    return f"(1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * abs({t}) / 1800 * {_STEPS.format(f'pow(1 + pow({t} * i / 600, 2) / {df}, -({df} + 1) / 2)')})"


def _mann_whitney_p(u: str, n1: str, n2: str, ties: str, greater: bool = False) -> str:
    """The normal approximation; samples of 8 values or fewer don't occur here."""
    best = u if greater else f"greatest({u}, {n1} * {n2} - {u})"
    z = f"(({best}) - {n1} * {n2} / 2.0::DOUBLE - 0.5) / sqrt({n1} * {n2} / 12.0::DOUBLE * ({n1} + {n2} + 1 - {ties} / (({n1} + {n2}) * ({n1} + {n2} - 1.0::DOUBLE))))"
    return f"CASE WHEN {n1} = 0 OR {n2} = 0 THEN 1.0 ELSE least(1.0, {1 if greater else 2} * {_normal_upper(z)}) END"


#: Shares of the rank sums of n differences, for n up to 50, by adding one rank at a time.
_RANK_SUMS = "SELECT 0 AS n, [1.0::DOUBLE] AS p UNION ALL SELECT n + 1, list_transform(range(len(p) + n + 1), lambda i: (coalesce(p[i + 1], 0) + CASE WHEN i > n THEN coalesce(p[i - n], 0) ELSE 0 END) / 2) FROM sums WHERE n < 50"


def _wilcoxon_sql(keys: str, pairs: str, family: str, least: int = 1, more: str = "", names: str = "variant_a, variant_b") -> str:
    """Everything that wilcoxon() gives. pairs: a FROM clause with keys and d."""
    part = f"PARTITION BY {keys}, d = 0"
    return f"""(WITH RECURSIVE sums AS ({_RANK_SUMS}), d AS (SELECT {keys}, round(d, 9) AS d FROM {pairs}),
    x AS (SELECT *, rank() OVER ({part} ORDER BY abs(d)) + (count(*) OVER ({part}, abs(d)) - 1) / 2.0::DOUBLE AS r, (count(*) OVER ({part}, abs(d)))::DOUBLE AS t FROM d),
    g AS (SELECT {keys}, count(*) AS n, count(*) FILTER (d = 0) AS zeros, count(*) FILTER (d <> 0) AS n_used, avg(d) AS mean_diff, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS w_minus, coalesce(sum(t * t - 1) FILTER (d <> 0), 0)::DOUBLE AS ties FROM x GROUP BY ALL HAVING count(*) >= {least}),
    z AS (SELECT *, least(w_plus, w_minus) AS w, n_used * (n_used + 1) * (2 * n_used + 1) / 24 - ties / 48 AS v FROM g),
    p AS (SELECT z.*, CASE WHEN n_used = 0 THEN 1.0 WHEN n_used <= 50 AND ties = 0 AND zeros = 0 THEN least(1.0, 2 * list_sum(sums.p[1:CAST(floor(w) AS INT) + 1])) WHEN v > 0 THEN least(1.0, 2 * {_normal_upper('(n_used * (n_used + 1) / 4 - w) / sqrt(v)')}) ELSE 1.0 END AS p_value FROM z LEFT JOIN sums ON sums.n = z.n_used)
    SELECT {keys}, n, zeros, n_used, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(ties, 6) AS ties, round(mean_diff, 6) AS mean_diff, round(1 - 2 * w / (n * (n + 1)), 6) AS effect_compat, round(CASE WHEN n_used > 0 THEN 1 - 4 * w / (n_used * (n_used + 1)) ELSE 0 END, 6) AS effect,
    round(p_value, 6) AS p_value, round(least(1.0, p_value * {family}), 6) AS p_adjusted{more} FROM p)"""


_BOTH = "(SELECT {}a.variant_id AS variant_a, b.variant_id AS variant_b, a.v - b.v AS d FROM {} a JOIN {} b USING ({}task_id, repetition) WHERE {})"
_ALL, _BASE = "a.variant_id < b.variant_id", "a.variant_id = 'v1' AND b.variant_id <> 'v1'"
#: Blocks that have every variant of their complexity.
_STRATA = {"cells": "SELECT complexity, variant_id, task_id, repetition, arg_min(overall_median, design_id) AS v FROM scores WHERE complexity IS NOT NULL GROUP BY ALL", "whole": "SELECT c.* FROM cells c JOIN (SELECT complexity, task_id, repetition, count(*) AS k FROM cells GROUP BY ALL) USING (complexity, task_id, repetition) JOIN (SELECT complexity, count(DISTINCT variant_id) AS all_k FROM cells GROUP BY ALL) USING (complexity) WHERE k = all_k"}
_COHERENT = {"cells": "SELECT variant_id, task_id, repetition, arg_min(coherence_rate, design_id) AS v FROM scores JOIN coherence USING (design_id) GROUP BY ALL", "whole": VIEWS["whole"]}


def _coherent(spark, sf):
    return A.score_view(spark, sf).join(coherence(spark, sf).select("design_id", "coherence_rate"), "design_id")


@query(sql("SELECT variant_id, round(avg(r), 6) AS mean_rank, round(avg(v), 6) AS mean_score, count(*) AS n_blocks FROM ranked GROUP BY variant_id", "ranked"))
def mean_ranks(spark, sf):
    return rounded(ranking.mean_ranks(A.score_view(spark, sf)))


_Q = """SELECT k, n_blocks, round((12 / (n_blocks * k * (k + 1)) * squares - 3 * n_blocks * (k + 1)) / (1 - ties / (n_blocks * k * (k * k - 1))), 6) AS q FROM
    (SELECT count(*) AS k, max(n) AS n_blocks, sum(t * t) AS squares FROM (SELECT variant_id, sum(r) AS t, count(*) AS n FROM ranked GROUP BY 1)),
    (SELECT sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT count(*) AS t FROM ranked GROUP BY task_id, repetition, v))"""


@query(sql(_Q, "ranked"))
def friedman_q(spark, sf):
    return rounded(ranking.friedman(A.score_view(spark, sf)))


@query(sql(_Q, "runs", "coherence", "medians", "tasks", cells="SELECT variant_id, task_id, repetition, arg_min(coherence_rate, run_id) AS v FROM runs JOIN coherence ON run_id = design_id JOIN medians USING (design_id) WHERE status = 'completed' GROUP BY ALL", whole=VIEWS["whole"], ranked=VIEWS["ranked"]))
def friedman_q_coherence(spark, sf):
    return rounded(ranking.friedman(_coherent(spark, sf), "coherence_rate"))


# The tail of chi-squared with four degrees of freedom, that is with five variants, has a closed form.
_CHI4 = "SELECT *, CASE k WHEN 5 THEN round(exp(-q / 2) * (1 + q / 2), 6) END AS p_value FROM ({})"


@query(sql(_CHI4.format(_Q), "ranked"))
def friedman_p(spark, sf):
    return rounded(ranking.with_friedman_p(ranking.friedman(A.score_view(spark, sf))))


_Q_STRATA = """SELECT complexity, k, n_blocks, round((12 / (n_blocks * k * (k + 1)) * squares - 3 * n_blocks * (k + 1)) / (1 - ties / (n_blocks * k * (k * k - 1))), 6) AS q FROM
    (SELECT complexity, count(*) AS k, max(n) AS n_blocks, sum(t * t) AS squares FROM (SELECT complexity, variant_id, sum(r) AS t, count(*) AS n FROM ranked GROUP BY ALL) GROUP BY ALL) JOIN
    (SELECT complexity, sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT complexity, count(*) AS t FROM ranked GROUP BY complexity, task_id, repetition, v) GROUP BY ALL) USING (complexity)"""


@query(sql(_CHI4.format(_Q_STRATA), "scores", **_STRATA, ranked=VIEWS["ranked"]))
def friedman_by_complexity(spark, sf):
    return rounded(ranking.with_friedman_p(ranking.friedman(A.score_view(spark, sf).where("complexity is not null"), strata=["complexity"])))


_SIGNED = """SELECT variant_a, variant_b, count(*) AS n, CAST(sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, round(avg(d), 6) AS mean_diff, coalesce(round(sum(CASE WHEN d > 0 THEN r END), 6), 0) AS w_plus, coalesce(round(sum(CASE WHEN d < 0 THEN r END), 6), 0) AS w_minus FROM
    (SELECT *, CASE WHEN d <> 0 THEN rank() OVER (PARTITION BY variant_a, variant_b, d = 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY variant_a, variant_b, d = 0, abs(d)) - 1) / 2.0::DOUBLE END AS r FROM
    (SELECT a.variant_id AS variant_a, b.variant_id AS variant_b, round(a.v - b.v, 9) AS d FROM whole a JOIN whole b USING (task_id, repetition) WHERE {}))  GROUP BY ALL"""


def _signed(df):
    return rounded(df.select("variant_a", "variant_b", "n", "zeros", "mean_diff", "w_plus", "w_minus"))


@query(sql(_SIGNED.format("a.variant_id = 'v1' AND b.variant_id <> 'v1'"), "whole"))
def signed_rank_baseline(spark, sf):
    return _signed(ranking.signed_ranks(ranking.paired(A.score_view(spark, sf), baseline="v1"), ["variant_a", "variant_b"]))


@query(sql(_SIGNED.format("a.variant_id < b.variant_id"), "whole"))
def signed_rank_pairs(spark, sf):
    return _signed(ranking.signed_ranks(ranking.paired(A.score_view(spark, sf)), ["variant_a", "variant_b"]))


_VS = "variant_a, variant_b"


@query(sql(f"SELECT * FROM {_wilcoxon_sql(_VS, _BOTH.format('', 'whole', 'whole', '', _BASE), 'count(*) OVER ()')}", "whole"))
def wilcoxon_baseline(spark, sf):
    return rounded(ranking.wilcoxon(A.score_view(spark, sf), baseline="v1"))


def _posthoc(scores):
    """All pairs, if the Friedman test is significant at 0.05."""
    gate = ranking.with_friedman_p(ranking.friedman(scores)).where("p_value < 0.05").select(F.lit(True).alias("significant"))
    return rounded(ranking.wilcoxon(scores).crossJoin(gate))  # one row or none


_POSTHOC = f"SELECT w.*, true AS significant FROM {_wilcoxon_sql(_VS, _BOTH.format('', 'whole', 'whole', '', _ALL), 'count(*) OVER ()')} w, ({_CHI4.format(_Q)}) f WHERE f.p_value < 0.05"


@query(sql(_POSTHOC, "ranked"))
def posthoc_wilcoxon_bonferroni(spark, sf):
    return _posthoc(A.score_view(spark, sf))


_SHIFTED = VIEWS["cells"].replace("arg_min(overall_median, design_id)", "arg_min(overall_median + 0.3 * CAST(substr(variant_id, 2, 1) AS DOUBLE), design_id)")


@query(sql(_POSTHOC, "scores", cells=_SHIFTED, whole=VIEWS["whole"], ranked=VIEWS["ranked"]))
def posthoc_of_shifted_scores(spark, sf):
    """The same with an effect of the variant added to its scores, so that the test is significant."""
    shift = F.substring("variant_id", 2, 1).cast("double") * 0.3
    return _posthoc(A.score_view(spark, sf).withColumn("overall_median", F.col("overall_median") + shift))


@query(sql(f"SELECT * FROM {_wilcoxon_sql('complexity, ' + _VS, _BOTH.format('complexity, ', 'whole', 'whole', 'complexity, ', _ALL), '1', 3)}", "scores", **_STRATA))
def wilcoxon_pairs_by_complexity(spark, sf):
    return rounded(ranking.wilcoxon(A.score_view(spark, sf).where("complexity is not null"), strata=["complexity"], family=None, least_blocks=3))


@query(sql(f"SELECT * FROM {_wilcoxon_sql('complexity, ' + _VS, _BOTH.format('complexity, ', 'whole', 'whole', 'complexity, ', _BASE), '1', 3)}", "scores", **_STRATA))
def wilcoxon_baseline_by_complexity(spark, sf):
    return rounded(ranking.wilcoxon(A.score_view(spark, sf).where("complexity is not null"), strata=["complexity"], family=None, least_blocks=3, baseline="v1"))


@query(sql(f"SELECT * FROM {_wilcoxon_sql(_VS, _BOTH.format('', 'whole', 'whole', '', _BASE), 'count(*) OVER ()')}", "scores", "coherence", **_COHERENT))
def wilcoxon_baseline_coherence(spark, sf):
    return rounded(ranking.wilcoxon(_coherent(spark, sf), value="coherence_rate", baseline="v1"))


@query(sql(f"SELECT * FROM {_wilcoxon_sql(_VS, _BOTH.format('', 'whole', 'whole', '', _ALL), 'count(*) OVER ()')}", "scores", "coherence", **_COHERENT))
def posthoc_coherence(spark, sf):
    return rounded(ranking.wilcoxon(_coherent(spark, sf), value="coherence_rate"))


#: Pairs of the targeted comparisons, by parent variant, and the variable each is about.
TARGETED = {
    "C1": ("v1", "v2a", "feedback source"),
    "C2": ("v2a", "v2b", "reviewer identity"),
    "C3": ("v2b", "v4", "feedback dynamics"),
    "C4": ("v2b", "v5", "reviewer specialization"),
    "C5": ("v3b", "v7", "synthesis mechanism"),
    "C6": ("v3c", "v8", "diversity source"),
    "C7": ("v4", "v8", "adversarial structure"),
    "C8": ("v5", "v6", "specialization target"),
}


_SPEC = ", ".join(f"('{k}', '{a}', '{b}', '{what}')" for k, (a, b, what) in TARGETED.items())
_D = """SELECT a.variant_id AS variant_a, b.variant_id AS variant_b, round((a.m - b.m) / sqrt(((a.n - 1) * a.s2 + (b.n - 1) * b.s2) / (a.n + b.n - 2)), 6) AS cohens_d FROM
    (SELECT variant_id, count(*) AS n, avg(overall_median) AS m, var_samp(overall_median) AS s2 FROM scores GROUP BY 1) a JOIN (SELECT variant_id, count(*) AS n, avg(overall_median) AS m, var_samp(overall_median) AS s2 FROM scores GROUP BY 1) b ON a.variant_id < b.variant_id"""
_AMONG = "(a.variant_id, b.variant_id) IN (" + ", ".join(f"('{a}', '{b}')" for a, b, _ in TARGETED.values()) + ")"


@query(sql(f"SELECT * FROM (VALUES {_SPEC}) s(comparison, variant_a, variant_b, variable) LEFT JOIN {_wilcoxon_sql(_VS, _BOTH.format('', 'whole', 'whole', '', _AMONG), str(len(TARGETED)))} USING (variant_a, variant_b) LEFT JOIN ({_D}) USING (variant_a, variant_b)", "whole"))
def targeted_comparisons(spark, sf):
    """The eight targeted comparisons with p times eight and Cohen's d; pairs without data have nulls."""
    scores = A.score_view(spark, sf)
    spec = spark.createDataFrame([(k, *v) for k, v in TARGETED.items()], "comparison string, variant_a string, variant_b string, variable string")
    tested = ranking.wilcoxon(scores, pairs=[v[:2] for v in TARGETED.values()], family=len(TARGETED))
    return rounded(spec.join(tested, ["variant_a", "variant_b"], "left").join(ranking.cohens_d(scores), ["variant_a", "variant_b"], "left"))


#: Cells overall and by complexity, and the blocks of a stratum that have all of its variants.
_ALL_STRATA = {
    "cells": "SELECT stratum, variant_id, task_id, repetition, arg_min(overall_median, design_id) AS v FROM (SELECT *, 'all' AS stratum FROM scores UNION ALL SELECT *, complexity FROM scores WHERE complexity IS NOT NULL) GROUP BY ALL",
    "whole": "SELECT c.* FROM cells c JOIN (SELECT stratum, task_id, repetition, count(*) AS k FROM cells GROUP BY ALL) USING (stratum, task_id, repetition) JOIN (SELECT stratum, count(DISTINCT variant_id) AS all_k FROM cells GROUP BY ALL) USING (stratum) WHERE k = all_k",
}
_D_STRATA = _D.replace("FROM scores GROUP BY 1", "FROM whole GROUP BY ALL").replace("overall_median", "v").replace("SELECT variant_id, count(*)", "SELECT stratum, variant_id, count(*)").replace("SELECT a.variant_id", "SELECT a.stratum, a.variant_id").replace("b ON a.variant_id < b.variant_id", "b ON a.stratum = b.stratum AND a.variant_id < b.variant_id")


@query(
    sql(
        f"SELECT * REPLACE (CASE WHEN stratum = 'all' THEN least(1.0, round(p_value * {len(TARGETED)}, 6)) ELSE p_value END AS p_adjusted) FROM (SELECT * FROM {_wilcoxon_sql('stratum, ' + _VS, _BOTH.format('a.stratum, ', 'whole', 'whole', 'stratum, ', _AMONG), '1')}) JOIN (SELECT comparison, variant_a, variant_b, variable FROM (VALUES {_SPEC}) s(comparison, variant_a, variant_b, variable)) USING (variant_a, variant_b) LEFT JOIN ({_D_STRATA}) USING (stratum, variant_a, variant_b) WHERE stratum = 'all' OR n >= 3",
        "scores",
        **_ALL_STRATA,
    )
)
def targeted_by_complexity(spark, sf):
    """The targeted comparisons that have data, overall and by complexity, from one plan over all strata."""
    spec = spark.createDataFrame([(k, *v) for k, v in TARGETED.items()], "comparison string, variant_a string, variant_b string, variable string")
    found = rounded(ranking.targeted(A.score_view(spark, sf), [v[:2] for v in TARGETED.values()]))
    return rounded(found.withColumn("p_adjusted", F.when(F.col("stratum") == "all", F.least(F.lit(1.0), F.col("p_value") * len(TARGETED))).otherwise(F.col("p_value")))).join(F.broadcast(spec), ["variant_a", "variant_b"])


@query(sql(_CHI4.format(_Q_STRATA.replace("complexity", "stratum")), "scores", **_ALL_STRATA, ranked=VIEWS["ranked"].replace("PARTITION BY task_id", "PARTITION BY stratum, task_id")))
def friedman_all_strata(spark, sf):
    """Friedman's test overall and by complexity, from one plan over all strata."""
    return rounded(ranking.with_friedman_p(ranking.friedman(ranking.stratified(A.score_view(spark, sf)), strata=["stratum"])))


@query(
    sql(
        """SELECT a.variant_id AS variant_a, b.variant_id AS variant_b, round((a.m - b.m) / sqrt(((a.n - 1) * a.s2 + (b.n - 1) * b.s2) / (a.n + b.n - 2)), 6) AS cohens_d FROM g a JOIN g b ON a.variant_id < b.variant_id""",
        "scores",
        g="SELECT variant_id, count(*) AS n, avg(overall_median) AS m, var_samp(overall_median) AS s2 FROM scores GROUP BY 1",
    )
)
def cohens_d_pairs(spark, sf):
    return rounded(ranking.cohens_d(A.score_view(spark, sf)))


def _u_sql(axis: str, level: dict, low: str, high: str) -> str:
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in level.items())
    return f"""SELECT '{axis}' AS axis, '{low}' AS level_a, '{high}' AS level_b, count(*) FILTER (level = '{low}') AS n_first, count(*) FILTER (level = '{high}') AS n_second,
    round(sum(r) FILTER (level = '{low}') - count(*) FILTER (level = '{low}') * (count(*) FILTER (level = '{low}') + 1) / 2, 6) AS u FROM
    (SELECT level, rank() OVER (ORDER BY overall_median) + (count(*) OVER (PARTITION BY overall_median) - 1) / 2.0::DOUBLE AS r FROM (SELECT overall_median, CASE variant_id {case} END AS level FROM scores))"""


_PARENTS = {"v1": "v1", "v2a": "v2", "v3b": "v3", "v4": "v4", "v5": "v5"}
_AXES = [(a, {v: ranking.TAXONOMY[p][i] for v, p in _PARENTS.items()}, *sorted({x[i] for x in ranking.TAXONOMY.values()})) for i, a in enumerate(ranking.AXES)]


@query(sql(" UNION ALL ".join(_u_sql(*x) for x in _AXES), "scores"))
def axis_effect_u(spark, sf):
    return rounded(ranking.axis_effects(A.score_view(spark, sf)).select("axis", "level_a", "level_b", "n_first", "n_second", "u"))


def _samples_sql(rows: str, first: str, second: str, value: str, greater: bool = False) -> str:
    """n_first, n_second, u, ties, p_value of two samples of rows; a row is in the first if both conditions hold."""
    return f"""(SELECT *, {_mann_whitney_p('u', 'n_first', 'n_second', 'ties', greater)} AS p_value FROM
    (SELECT count(*) FILTER (a) AS n_first, count(*) FILTER (NOT a) AS n_second, coalesce(sum(r) FILTER (a), 0) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2.0::DOUBLE AS u, coalesce(sum(t * t - 1), 0)::DOUBLE AS ties FROM
    (SELECT a, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r, (count(*) OVER (PARTITION BY v))::DOUBLE AS t FROM (SELECT {first} AS a, {value} AS v FROM {rows} WHERE (({first}) OR ({second})) AND {value} IS NOT NULL))))"""


def _axis_sql(axis: str, level: dict, low: str, high: str) -> str:
    of = lambda x: "variant_id IN (" + ", ".join([f"'{k}'" for k, v in level.items() if v == x] or ["''"]) + ")"
    return f"SELECT '{axis}' AS axis, '{low}' AS level_a, '{high}' AS level_b, n_first, n_second, round(u, 6) AS u, round(CASE WHEN n_first > 0 AND n_second > 0 THEN 1 - 2 * u / (n_first * n_second) END, 6) AS effect, round(ties, 6) AS ties, round(p_value, 6) AS p_value FROM {_samples_sql('scores', of(low), of(high), 'overall_median')}"


@query(sql(" UNION ALL ".join(_axis_sql(*x) for x in _AXES), "scores"))
def axis_effect_p(spark, sf):
    return rounded(ranking.with_mann_whitney_p(ranking.axis_effects(A.score_view(spark, sf))))


_RHO = """SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM b)"""


@query(sql(_RHO, "scores", "coherence", b="SELECT overall_median AS x, coherence_rate AS y FROM scores JOIN coherence USING (design_id)"))
def spearman_rho(spark, sf):
    return rounded(ranking.spearman(_coherent(spark, sf), "overall_median", "coherence_rate"))


@query(sql(_RHO, b="SELECT quality::DOUBLE AS x, (toxic + 2 * (n_chars % 5))::DOUBLE AS y FROM labels JOIN documents USING (doc_id)"))
def human_llm_rho(spark, sf):
    """Scores of two kinds of raters on the same designs: labels, and a function of the documents."""
    human = A.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("human"), "toxic")
    llm = A.table(spark, sf, "documents").select("doc_id", "n_chars")
    both = human.join(llm, "doc_id").select("human", (F.col("toxic") + 2 * (F.col("n_chars") % 5)).cast("double").alias("llm"))
    return rounded(ranking.spearman(both, "human", "llm"))


_RHO_P = f"SELECT n, rho, round(p, 6) AS p_value FROM (SELECT n, round(rho, 6) AS rho, {_t_two_sided('(rho * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2.0::DOUBLE)')} AS p FROM ({_RHO.replace('round(corr(rx, ry), 6)', 'corr(rx, ry)')}))"
_PAIRS = "SELECT overall_median AS x, coherence_rate AS y FROM scores JOIN coherence USING (design_id)"


@query(sql(_RHO_P, "scores", "coherence", b=_PAIRS))
def spearman_p(spark, sf):
    return rounded(ranking.with_spearman_p(ranking.spearman(_coherent(spark, sf), "overall_median", "coherence_rate")))


_FRAMEWORK = """SELECT complexity, budget, variant_id, CASE WHEN rcv = 1 THEN 'robust' WHEN rany = 1 THEN 'maximum' WHEN mean_score >= 4 THEN 'high' ELSE 'good' END AS label, round(mean_score, 6) AS mean_score, round(mean_cost, 6) AS mean_cost, n, coalesce(rate < 0.8, false) AS coherence_warning FROM
    (SELECT *, row_number() OVER (PARTITION BY complexity ORDER BY mean_score DESC, variant_id) AS rany, row_number() OVER (PARTITION BY complexity ORDER BY cv, variant_id) AS rcv, row_number() OVER (PARTITION BY complexity ORDER BY mean_cost, mean_score DESC, variant_id) AS rlow,
    row_number() OVER (PARTITION BY complexity ORDER BY ok DESC, mean_score DESC, variant_id) AS rmod FROM (SELECT *, mean_cost < 2 * min(mean_cost) OVER (PARTITION BY complexity) AS ok FROM p)) x
    JOIN (VALUES ('low'), ('moderate'), ('any')) v(budget) ON (budget = 'low' AND rlow = 1) OR (budget = 'moderate' AND rmod = 1 AND ok) OR (budget = 'any' AND rany = 1)
    LEFT JOIN (SELECT variant_id, avg(coherence_rate) AS rate FROM scores JOIN coherence USING (design_id) GROUP BY 1) c USING (variant_id)"""
_P = """SELECT complexity, variant_id, count(*) AS n, avg(overall_median) AS mean_score, avg(total_cost_usd) AS mean_cost, coalesce(stddev_samp(overall_median), 0) / avg(overall_median) AS cv FROM scores JOIN (SELECT run_id, total_cost_usd FROM costs) USING (run_id) WHERE complexity IS NOT NULL GROUP BY ALL"""


@query(sql(_FRAMEWORK, "scores", "costs", "coherence", p=_P))
def decision_framework(spark, sf):
    return rounded(decisions.framework(A.score_view(spark, sf), A.cost_view(spark, sf), _coherent(spark, sf), confidence=False))


_RANKED_P = "SELECT *, row_number() OVER (PARTITION BY complexity ORDER BY mean_score DESC, variant_id) AS place FROM p"
_RIVALS = "SELECT a.complexity, a.variant_id, b.variant_id AS rival FROM placed a JOIN placed b ON b.complexity = a.complexity AND b.place = CASE a.place WHEN 1 THEN 2 ELSE 1 END"
_NUMBERED = "SELECT complexity, variant_id, overall_median AS v, row_number() OVER (PARTITION BY complexity, variant_id ORDER BY run_id) AS i FROM scores JOIN (SELECT run_id FROM costs) USING (run_id) WHERE complexity IS NOT NULL"
_TESTED = _wilcoxon_sql("complexity, variant_id", "(SELECT a.complexity, a.variant_id, a.v - b.v AS d FROM numbered a JOIN rivals r ON r.complexity = a.complexity AND r.variant_id = a.variant_id JOIN numbered b ON b.complexity = a.complexity AND b.variant_id = r.rival AND b.i = a.i)", "1", 5)


@query(
    sql(
        f"SELECT f.*, round(coalesce(t.p_value, 1), 6) AS p_value, CASE WHEN coalesce(t.p_value, 1) < 0.01 THEN 'high' WHEN coalesce(t.p_value, 1) < 0.05 THEN 'medium' ELSE 'low' END AS confidence FROM ({_FRAMEWORK}) f LEFT JOIN (SELECT complexity, variant_id, p_value FROM {_TESTED}) t USING (complexity, variant_id)",
        "scores",
        "costs",
        "coherence",
        p=_P,
        placed=_RANKED_P,
        rivals=_RIVALS,
        numbered=_NUMBERED,
    )
)
def decision_framework_confidence(spark, sf):
    return rounded(decisions.framework(A.score_view(spark, sf), A.cost_view(spark, sf), _coherent(spark, sf)))


@query(sql("SELECT DISTINCT variant_id FROM (SELECT variant_id, coalesce(mean_score > max(mean_score) OVER (PARTITION BY complexity ORDER BY mean_cost, mean_score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS f FROM p) WHERE f", "scores", "costs", p=_P))
def pareto_union(spark, sf):
    return decisions.pareto_union(A.score_view(spark, sf), A.cost_view(spark, sf))


def _told(name: str, statistic: str, supported: str, rows: str) -> str:
    return f"SELECT '{name}' AS prediction, round({statistic}, 6) AS statistic, {supported} AS supported FROM {rows}"


_ENOUGH = "CASE WHEN n_first >= 3 AND n_second >= 3 THEN p_value {} 0.05 END"
_CV = "(SELECT variant_id, coalesce(stddev_samp(overall_median), 0) / avg(overall_median) AS cv FROM scores GROUP BY 1)"


@query(
    sql(
        " UNION ALL ".join(
            [
                _told("P1", "p_value", _ENOUGH.format(">"), _samples_sql("(SELECT * FROM scores WHERE complexity = 'simple')", "variant_id = 'v1'", "variant_id <> 'v1'", "overall_median")),
                _told("P2", "max(m)", "starts_with(arg_max(variant_id, (m, variant_id)), 'v3')", "(SELECT variant_id, avg(overall_median) AS m FROM scores WHERE complexity = 'complex' GROUP BY 1)"),
                _told("P3", "min(cv)", "starts_with(arg_min(variant_id, (cv, variant_id)), 'v7')", _CV),
                _told("P4", "max(cv)", "starts_with(arg_max(variant_id, (cv, variant_id)), 'v4')", _CV),
                _told("P5", "p_value", _ENOUGH.format("<"), _samples_sql("(SELECT l.score, s.variant_id FROM longs l JOIN scores s USING (design_id) WHERE dimension IN ('security', 'performance'))", "variant_id = 'v5'", "variant_id = 'v2a'", "score", True)),
                _told("P6", "p_value", _ENOUGH.format("<"), _samples_sql("scores", "variant_id IN ('v1', 'v3b')", "variant_id NOT IN ('v1', 'v3b')", "overall_median", True)),
                _told("P7", "p_value", _ENOUGH.format("<"), _samples_sql("(SELECT * FROM scores JOIN coherence USING (design_id))", "variant_id <> 'v1'", "variant_id = 'v1'", "coherence_rate", True)),
                _told("P8", "rho", "p_value < 0.05 AND rho > 0.3", f"({_RHO_P})"),
            ]
        ),
        "scores",
        "coherence",
        "longs",
        b=_PAIRS,
    )
)
def predictions(spark, sf):
    scores = stored(A.score_view(spark, sf), "scores")
    of = scores.select("design_id", "variant_id")
    rates = of.join(coherence(spark, sf).select("design_id", "coherence_rate"), "design_id")
    return decisions.predictions(scores, longs(spark, sf).join(of, "design_id"), rates)
