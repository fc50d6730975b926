"""Scores of designs from several raters: medians, disagreement, agreement, ensembles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_IN_TASK = 500_000


def long_scores(evaluations: DataFrame, dimensions: list[str], keys: list[str]) -> DataFrame:
    """keys, dimension, score: one row per rater and dimension that has a score."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("score")) for d in dimensions])
    return evaluations.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.dimension", "p.score").where("score is not null")


def scores_from_json(evaluations: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys, dimension, score, justification, blockers from JSON in either shape: a list of records, or a map from
    dimension to record (or to a bare number). A missing score counts as 0.0 and a missing dimension as ""; malformed
    JSON gives no rows."""
    record = "struct<dimension:string,score:double,justification:string,blockers:array<string>>"
    listed = F.from_json(column, f"array<{record}>")
    mapped = F.from_json(column, "map<string,struct<score:double,justification:string,blockers:array<string>>>")
    as_list = F.transform(F.map_entries(mapped), lambda e: F.struct(e["key"].alias("dimension"), e["value"]["score"].alias("score"), e["value"]["justification"].alias("justification"), e["value"]["blockers"].alias("blockers")))
    numbers = F.from_json(column, "map<string,double>")
    bare = F.transform(F.map_entries(numbers), lambda e: F.struct(e["key"].alias("dimension"), e["value"].alias("score"), F.lit(None).cast("string").alias("justification"), F.lit(None).cast("array<string>").alias("blockers")))
    text = F.ltrim(column)
    rows = F.when(text.startswith("["), listed).when(text.rlike(r'^\{[^{]*\}\s*$'), bare).otherwise(as_list)
    out = evaluations.select(*keys, F.explode(rows).alias("p"))
    return out.select(*keys, F.coalesce("p.dimension", F.lit("")).alias("dimension"), F.coalesce("p.score", F.lit(0.0)).alias("score"), "p.justification", F.coalesce("p.blockers", F.array().cast("array<string>")).alias("blockers"))


def dimension_medians(scores: DataFrame, key: str = "design_id", limit: float = 1.5) -> DataFrame:
    """key, dimension, median, n, range, flagged (two raters or more and a range above the limit)."""
    out = scores.groupBy(key, "dimension").agg(F.median("score").alias("median_score"), F.count("*").alias("n"), (F.max("score") - F.min("score")).alias("score_range"))
    return out.withColumn("flagged", (F.col("n") >= 2) & (F.col("score_range") > limit))


def disagreement_flags(scores: DataFrame, key: str = "design_id", limit: float = 1.5) -> DataFrame:
    """key, dimension, range and the sorted scores of flagged dimensions."""
    own = scores.groupBy(key, "dimension").agg(F.sort_array(F.collect_list("score")).alias("scores"))
    spread = F.round(F.array_max("scores") - F.array_min("scores"), 6)
    return own.where((F.size("scores") >= 2) & (spread > limit)).select(key, "dimension", spread.alias("score_range"), "scores")


def overall_medians(evaluations: DataFrame, key: str = "design_id", column: str = "overall_score") -> DataFrame:
    """The median over raters; a missing score counts as 0.0 and pulls it down."""
    return evaluations.groupBy(key).agg(F.median(F.coalesce(column, F.lit(0.0))).alias("overall_median"))


def blocker_union(records: DataFrame, key: str, arrays: list[str], distinct: bool = False) -> DataFrame:
    """key, blocker_count, blockers_json (null if there are none): all arrays of a design's raters."""
    own = F.flatten(F.array(*[F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays]))
    out = records.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(own))).alias("b"))
    out = out.withColumn("b", F.array_distinct("b")) if distinct else out
    return out.select(key, F.size("b").cast("long").alias("blocker_count"), F.when(F.size("b") > 0, F.to_json("b")).alias("blockers_json"))


def blocker_means(scores: DataFrame, counts: DataFrame) -> DataFrame:
    """variant_id, n, mean_blockers, total_blockers over scored designs; a design without blockers counts as 0. counts: design_id, blocker_count."""
    own = scores.select("variant_id", "design_id").join(counts.select("design_id", "blocker_count"), "design_id", "left").withColumn("c", F.coalesce("blocker_count", F.lit(0)))
    return own.groupBy("variant_id").agg(F.count("*").alias("n"), F.avg("c").alias("mean_blockers"), F.sum("c").alias("total_blockers"))


def blocker_histogram(blockers: DataFrame, group: str, text: str, width: int = 100) -> DataFrame:
    """group, blocker (its first characters), n."""
    return blockers.groupBy(group, F.substring(text, 1, width).alias("blocker")).agg(F.count("*").alias("n"))


def alpha_proxy(scores: DataFrame, key: str = "design_id") -> DataFrame:
    """1 - mean variance within dimensions / variance over all, within [0, 1]; 1 where nothing varies, null under three scores. Dimensions with one score count nowhere."""
    per = scores.groupBy(key, "dimension").agg(F.count("*").alias("n"), F.var_samp("score").alias("v"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("q"))
    own = per.where("n >= 2").groupBy(key).agg(F.avg("v").alias("within"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    alpha = F.when(F.col("n") < 3, F.lit(None)).when(total <= 1e-9, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("within") / total)))
    return own.select(key, alpha.alias("alpha"))


def ordinal_alpha(scores: DataFrame, key: str = "design_id", unit: str = "dimension", value: str = "score") -> DataFrame:
    """Krippendorff's ordinal alpha of each key over its units; null where all values are equal or no unit has two.

    The ordinal distance of two values is the distance of their mid-ranks among all values of the key. So the sums over
    all pairs of values, of a unit (observed) or of the key (expected), are the sizes times the sums of squared
    mid-ranks less the squared sums: no pairs are made. Values are counted first, so a key costs its distinct values.

    Rows are dealt by key once, to so many tasks that each gets about ROWS_IN_TASK of them however many there are, and all
    counts and orders are made there.
    """
    tasks = max(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-scores.count() // ROWS_IN_TASK))
    dealt = scores.select(key, unit, F.col(value).alias("c")).repartition(tasks, key)
    counts = dealt.groupBy(key, unit, "c").agg(F.count("*").alias("n"))
    size = F.sum("n").over(Window.partitionBy(key, unit))
    counts = counts.withColumn("m", size).where("m >= 2")
    whole = Window.partitionBy(key)
    below = F.sum("n").over(whole.orderBy("c").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    middle = below - F.sum("n").over(Window.partitionBy(key, "c")) / 2 - F.sum("n").over(whole) / 2
    ranked = counts.withColumn("r", middle)
    weigh = lambda *by: ranked.groupBy(*by).agg(F.sum("n").cast("double").alias("m"), F.sum(F.col("n") * F.col("r")).alias("s"), F.sum(F.col("n") * F.col("r") * F.col("r")).alias("q"))
    units = weigh(key, unit).groupBy(key).agg(F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum((F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("observed"))
    expected = F.col("m") * F.col("q") - F.col("s") * F.col("s")
    return units.select(key, F.when(expected > 1e-9, 1 - (F.col("m") - 1) * F.col("observed") / expected).alias("alpha"))


def ensemble(evaluations: DataFrame, weights: dict[str, float], key: str = "design_id", model: str = "evaluator_model", score: str = "overall_score") -> DataFrame:
    """Mean score of each rater model, weighted; models without a score leave their weight out."""
    per = evaluations.groupBy(key, model).agg(F.avg(score).alias("s"))
    weight = reduce(lambda out, kv: F.when(F.col(model) == kv[0], F.lit(kv[1])).otherwise(out), weights.items(), F.lit(0.0))
    return per.withColumn("w", weight).groupBy(key).agg((F.sum(F.col("s") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("ensemble_score"), F.count("*").alias("n_models"))


def weighted_overall(scores: DataFrame, weights: dict[str, float], key: str = "design_id") -> DataFrame:
    """Rubric-weighted mean of the dimension scores."""
    w: Column = reduce(lambda out, kv: F.when(F.col("dimension") == kv[0], F.lit(kv[1])).otherwise(out), weights.items(), F.lit(0.0))
    return scores.groupBy(key).agg((F.sum(F.col("score") * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("weighted_overall"))


def reliability(designs: DataFrame, evaluations: DataFrame, key: str = "design_id", cut: float = 0.7) -> DataFrame:
    """One row: mean and median alpha, share above the cut, share of designs with a disagreement, mean over designs of the raters' population deviation (two raters or more). designs: key, alpha, flagged."""
    spread = evaluations.groupBy(key).agg(F.count("overall_score").alias("n"), F.stddev_pop("overall_score").alias("sd")).where("n >= 2").agg(F.avg("sd").alias("mean_intra_std"))
    own = designs.agg(F.count("*").alias("n_designs"), F.avg("alpha").alias("mean_alpha"), F.median("alpha").alias("median_alpha"), F.avg(F.when(F.col("alpha").isNotNull(), (F.col("alpha") > cut).cast("double"))).alias("share_reliable"), F.avg(F.col("flagged").cast("double")).alias("disagreement_rate"))
    return own.crossJoin(spread)  # one row by one row

