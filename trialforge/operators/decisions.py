"""The decision framework and the eight predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialforge.functions import tails
from trialforge.operators import analysis, prefix, ranking
from trialforge.sources.scratch import stored

WARN_BELOW = 0.8


def framework(scores: DataFrame, costs: DataFrame, coherence: DataFrame | None = None, confidence: bool = True) -> DataFrame:
    """complexity, budget (low, moderate, any), variant_id, label, mean_score, mean_cost, n, coherence_warning, and p_value and confidence if asked for.

    low: the cheapest variant on the frontier; any: the best mean; moderate: the best mean among costs strictly below
    twice the cheapest. Labels, first that fits: robust (lowest cv), maximum (best mean), high (mean of 4 or more),
    good. Confidence compares with the best other variant, value by value in the order of run ids, as far as both go.
    Ties in means go to the smaller variant_id.
    """
    by = ["complexity"]
    rows = scores.where("complexity is not null")
    own = analysis.variant_profile(rows, costs, by)
    own = analysis.pareto(own, by=by)
    w = Window.partitionBy("complexity")
    first = lambda *o: F.row_number().over(w.orderBy(*o))
    own = own.withColumn("cheapest", F.min("mean_cost").over(w))
    frontier_cost = F.when(F.col("on_frontier"), F.col("mean_cost"))
    affordable = F.col("mean_cost") < 2 * F.col("cheapest")
    own = own.withColumn("r_low", first(frontier_cost.asc_nulls_last(), "variant_id")).withColumn("r_any", first(F.col("mean_score").desc(), "variant_id")).withColumn("r_mod", first(affordable.desc(), F.col("mean_score").desc(), "variant_id")).withColumn("r_cv", first("cv", "variant_id"))
    label = F.when(F.col("r_cv") == 1, "robust").when(F.col("r_any") == 1, "maximum").when(F.col("mean_score") >= 4.0, "high").otherwise("good")
    other = F.when(F.col("r_any") == 1, F.max(F.when(F.col("r_any") == 2, F.col("variant_id"))).over(w)).otherwise(F.max(F.when(F.col("r_any") == 1, F.col("variant_id"))).over(w))
    own = own.withColumn("label", label).withColumn("rival", other)
    budgets = F.array_compact(F.array(F.when((F.col("r_low") == 1) & F.col("on_frontier"), "low"), F.when((F.col("r_mod") == 1) & affordable, "moderate"), F.when(F.col("r_any") == 1, "any")))
    out = own.withColumn("budget", F.explode(budgets)).select("complexity", "budget", "variant_id", "label", "mean_score", "mean_cost", "n", "rival")
    if coherence is not None:
        rate = coherence.groupBy("variant_id").agg(F.avg("coherence_rate").alias("rate"))
        out = out.join(F.broadcast(rate), "variant_id", "left").withColumn("coherence_warning", F.coalesce(F.col("rate") < WARN_BELOW, F.lit(False))).drop("rate")
    if not confidence:
        return out.drop("rival")
    known = rows.select("run_id", "complexity", "variant_id", "overall_median").join(costs.select("run_id"), "run_id")
    each = prefix.numbered(stored(known, "runs"), ["run_id"], "i", ["complexity", "variant_id"])
    a = each.select("complexity", F.col("variant_id").alias("variant_a"), "i", F.col("overall_median").alias("va"))
    b = each.select("complexity", F.col("variant_id").alias("variant_b"), "i", F.col("overall_median").alias("vb"))
    wanted = out.select("complexity", F.col("variant_id").alias("variant_a"), F.col("rival").alias("variant_b")).distinct()
    pairs = a.join(F.broadcast(wanted), ["complexity", "variant_a"]).join(b, ["complexity", "variant_b", "i"]).withColumn("d", F.col("va") - F.col("vb"))
    tested = ranking.signed_ranks(pairs, ["complexity", "variant_a"]).where("n >= 5").withColumn("p_value", tails.wilcoxon_column()("w_plus", "w_minus", "n_used", "ties", "zeros"))
    out = out.join(tested.select("complexity", F.col("variant_a").alias("variant_id"), "p_value"), ["complexity", "variant_id"], "left")
    p = F.coalesce("p_value", F.lit(1.0))
    return out.withColumn("p_value", p).withColumn("confidence", F.when(p < 0.01, "high").when(p < 0.05, "medium").otherwise("low")).drop("rival")


def pareto_union(scores: DataFrame, costs: DataFrame) -> DataFrame:
    """Variants on the frontier of any complexity."""
    own = analysis.variant_profile(scores.where("complexity is not null"), costs, ["complexity"])
    return analysis.pareto(own, by=["complexity"]).where("on_frontier").select("variant_id").distinct()


def two_samples(rows: DataFrame, first, second, value: str = "overall_median", alternative: str = "two-sided") -> DataFrame:
    """Rank-sum statistics and p of the rows where `first` holds against those where `second` does (null-safe)."""
    side = F.when(F.coalesce(first, F.lit(False)), "a").when(F.coalesce(second, F.lit(False)), "b")
    return ranking.with_mann_whitney_p(ranking.mann_whitney(rows.withColumn("side", side), "side", value, "a"), alternative)


#: Parent variants that the predictions speak of.
SETS = {"baseline": ["v1"], "reviewers": ["v2"], "merges": ["v3"], "adversarial": ["v4"], "specialists": ["v5"], "consensus": ["v7"]}
SPECIALIST_DIMENSIONS = "(?i)security|scalability|performance"


def predictions(scores: DataFrame, dimension_scores: DataFrame, coherence: DataFrame, aware: list[str] | None = None) -> DataFrame:
    """prediction (P1 to P8), statistic, supported; supported is null where there are not enough data.

    scores: score view; dimension_scores: variant_id, dimension, score; coherence: variant_id, design_id, coherence_rate;
    aware: parent variants that see the rubric. Scores are read several times, so they should be stored; each of the
    other tables is read once.
    """
    coherence = stored(coherence.select("variant_id", "design_id", "coherence_rate"), "coherence")
    parent = ranking.parent_variant(F.col("variant_id"))
    member = lambda name: parent.isin(SETS[name])
    enough = (F.col("n_first") >= 3) & (F.col("n_second") >= 3)

    def told(name: str, df: DataFrame, statistic, supported) -> DataFrame:
        return df.select(F.lit(name).alias("prediction"), F.round(statistic.cast("double"), 6).alias("statistic"), supported.alias("supported"))

    simple = two_samples(scores.where("complexity = 'simple'"), member("baseline"), ~member("baseline"))
    out = told("P1", simple, F.col("p_value"), F.when(enough, F.col("p_value") > 0.05))
    peak = scores.where("complexity = 'complex'").groupBy("variant_id").agg(F.avg("overall_median").alias("m")).agg(F.max("m").alias("m"), F.max_by("variant_id", F.struct("m", F.col("variant_id"))).alias("variant_id"))
    out = out.union(told("P2", peak, F.col("m"), F.when(F.col("variant_id").isNotNull(), member("merges"))))
    spread = analysis.variance(scores)
    low = spread.agg(F.min("cv").alias("cv"), F.min_by("variant_id", F.struct("cv", "variant_id")).alias("variant_id"))
    high = spread.agg(F.max("cv").alias("cv"), F.max_by("variant_id", F.struct("cv", "variant_id")).alias("variant_id"))
    out = out.union(told("P3", low, F.col("cv"), F.when(F.col("variant_id").isNotNull(), member("consensus")))).union(told("P4", high, F.col("cv"), F.when(F.col("variant_id").isNotNull(), member("adversarial"))))
    special = two_samples(dimension_scores.where(F.col("dimension").rlike(SPECIALIST_DIMENSIONS)), member("specialists"), member("reviewers"), "score", "greater")
    out = out.union(told("P5", special, F.col("p_value"), F.when(enough, F.col("p_value") < 0.05)))
    rubric = two_samples(scores, parent.isin(aware or ["v1", "v3"]), ~parent.isin(aware or ["v1", "v3"]), "overall_median", "greater")
    out = out.union(told("P6", rubric, F.col("p_value"), F.when(enough, F.col("p_value") < 0.05)))
    steady = two_samples(coherence, ~member("baseline"), member("baseline"), "coherence_rate", "greater")
    out = out.union(told("P7", steady, F.col("p_value"), F.when(enough, F.col("p_value") < 0.05)))
    both = scores.select("design_id", "overall_median").join(coherence.select("design_id", "coherence_rate"), "design_id")
    tied = ranking.with_spearman_p(ranking.spearman(both, "overall_median", "coherence_rate"))
    return out.union(told("P8", tied, F.col("rho"), (F.col("p_value") < 0.05) & (F.col("rho") > 0.3)))
