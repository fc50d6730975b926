"""Queries over the co-bucketed tables: the views, and analyses that read them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialforge.operators import analysis
from trialforge.plans.registry import query, rounded, sql
from trialforge.sources import bucketed


@query(sql("SELECT * FROM scores", "scores"))
def bucketed_scores(spark, sf):
    """The score view, joined bucket with bucket."""
    return bucketed.built(spark, sf).score_view()


@query(sql("SELECT * FROM costs", "costs"))
def bucketed_costs(spark, sf):
    """The cost view, from the files of completed runs."""
    return bucketed.built(spark, sf).cost_view()


@query(sql("SELECT variant_id, r.task_id, repetition, design_id, pairs_checked, contradictions FROM coherence JOIN runs r ON run_id = design_id WHERE status = 'completed'", "coherence", "runs"))
def bucketed_coherence(spark, sf):
    """Checks of each completed design, summed and joined within its bucket."""
    return bucketed.built(spark, sf).coherence_view()


@query(sql("SELECT variant_id, evaluator_model, count(*) AS n, round(avg(overall_score - overall_median), 6) AS mean_off, round(avg(abs(overall_score - overall_median)), 6) AS mean_distance FROM evaluations JOIN medians USING (design_id) JOIN runs ON run_id = design_id WHERE status = 'completed' GROUP BY ALL", "evaluations", "medians", "runs"))
def rater_offsets(spark, sf):
    """How far each rater is from the median of the designs of each variant."""
    off = F.col("overall_score") - F.col("overall_median")
    return rounded(bucketed.built(spark, sf).rater_view().groupBy("variant_id", "evaluator_model").agg(F.count("*").alias("n"), F.avg(off).alias("mean_off"), F.avg(F.abs(off)).alias("mean_distance")))


@query(sql("SELECT variant_id, count(*) AS n, round(avg(overall_median), 6) AS mean_score, round(coalesce(stddev_samp(overall_median), 0), 6) AS std_score, round(coalesce(stddev_samp(overall_median), 0) / avg(overall_median), 6) AS cv FROM scores GROUP BY variant_id", "scores"))
def bucketed_variance(spark, sf):
    """Variance of the median score of each variant, from the buckets."""
    return rounded(analysis.variance(bucketed.built(spark, sf).score_view()))
