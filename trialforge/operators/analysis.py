"""Descriptive analytics of scores and costs by variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _over(top, bottom, otherwise: float | None = 0.0):
    """top / bottom, and `otherwise` where bottom is not positive."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(otherwise).cast("double"))


def variance(scores: DataFrame, value: str = "overall_median", by: str = "variant_id") -> DataFrame:
    """by, n, mean, sd (0 for one value), cv (0 where the mean is not positive)."""
    out = scores.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean_score"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_score"))
    return out.withColumn("cv", _over(F.col("std_score"), F.col("mean_score")))


def token_efficiency(scores: DataFrame, costs: DataFrame) -> DataFrame:
    both = scores.select("run_id", "variant_id", "overall_median").join(costs.select("run_id", "total_cost_usd", "total_input_tokens", "total_output_tokens"), "run_id")
    out = both.groupBy("variant_id").agg(F.avg("overall_median").alias("mean_score"), F.avg("total_cost_usd").alias("mean_cost"), F.avg(F.col("total_input_tokens") + F.col("total_output_tokens")).alias("mean_all"))
    return out.select("variant_id", "mean_score", "mean_cost", F.floor("mean_all").cast("long").alias("mean_tokens"), _over(F.col("mean_score"), F.col("mean_cost")).alias("quality_per_dollar"), _over(F.col("mean_score"), F.col("mean_all") / 1000).alias("quality_per_1k_tokens"))


def descriptive(scores: DataFrame, costs: DataFrame) -> DataFrame:
    """Per variant ("all") and per variant and complexity: n, mean, sd, median, extremes, quartiles, costs and tokens."""
    both = scores.select("run_id", "variant_id", "complexity", "overall_median").join(costs.select("run_id", "total_cost_usd", (F.col("total_input_tokens") + F.col("total_output_tokens")).alias("tokens")), "run_id", "left")
    v = "overall_median"
    out = both.groupingSets([["variant_id"], ["variant_id", "complexity"]], "variant_id", "complexity").agg(
        F.grouping_id().alias("g"), F.count(v).alias("n"), F.avg(v).alias("mean_score"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_score"), F.percentile(v, 0.5).alias("median_score"), F.min(v).alias("min_score"), F.max(v).alias("max_score"),
        F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.75).alias("q75"), F.avg(F.coalesce("total_cost_usd", F.lit(0.0))).alias("mean_cost"), F.floor(F.avg(F.coalesce("tokens", F.lit(0)))).cast("long").alias("mean_tokens"),
    )
    return out.where("g = 1 or complexity is not null").withColumn("complexity", F.when(F.col("g") == 1, "all").otherwise(F.col("complexity"))).drop("g")


def variant_profile(scores: DataFrame, costs: DataFrame, by: list[str]) -> DataFrame:
    """by, variant_id: n, means and quartiles of score and cost, and cv. Rows without a cost are left out."""
    both = scores.join(costs.select("run_id", "total_cost_usd"), "run_id")
    out = both.groupBy(*by, "variant_id").agg(F.count("*").alias("n"), F.avg("overall_median").alias("mean_score"), F.avg("total_cost_usd").alias("mean_cost"), F.percentile("overall_median", 0.25).alias("score_q25"), F.percentile("overall_median", 0.75).alias("score_q75"), F.percentile("total_cost_usd", 0.25).alias("cost_q25"), F.percentile("total_cost_usd", 0.75).alias("cost_q75"), F.coalesce(F.stddev_samp("overall_median"), F.lit(0.0)).alias("sd"))
    return out.withColumn("cv", _over(F.col("sd"), F.col("mean_score"))).drop("sd")


def pareto(rows: DataFrame, cost: str = "mean_cost", quality: str = "mean_score", by: list[str] | None = None) -> DataFrame:
    """rows with on_frontier: better than everything cheaper. Of equal costs the best quality counts; null and NaN are never on it.

    The window runs over one row per variant, not over observations.
    """
    clean = F.col(cost).isNotNull() & F.col(quality).isNotNull() & ~F.isnan(cost) & ~F.isnan(quality)
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col(cost), F.col(quality).desc()).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.when(clean, F.col(quality))).over(order)
    return rows.withColumn("on_frontier", clean & (best.isNull() | (F.col(quality) > best)))


def break_even(scores: DataFrame, costs: DataFrame, baseline: str = "v1", least_gain: float = 0.0) -> DataFrame:
    """Each variant against the baseline: gains in quality and cost, cost multiple (null where the baseline is free), quality for each further dollar, justified."""
    own = scores.join(costs.select("run_id", "total_cost_usd"), "run_id").groupBy("variant_id").agg(F.avg("overall_median").alias("q"), F.avg("total_cost_usd").alias("c"))
    base = own.where(F.col("variant_id") == baseline).select(F.col("q").alias("bq"), F.col("c").alias("bc"))
    out = own.where(F.col("variant_id") != baseline).crossJoin(base)  # one row
    dq, dc = F.col("q") - F.col("bq"), F.col("c") - F.col("bc")
    return out.select("variant_id", dq.alias("quality_gain"), dc.alias("extra_cost"), _over(F.col("c"), F.col("bc"), None).alias("cost_multiple"), _over(dq, dc, 0.0).alias("quality_per_extra_dollar"), ((dq > least_gain) & ((dc <= 0) | (dq / F.when(dc != 0, dc) > 0))).alias("justified"))


def budget_simulation(scores: DataFrame, costs: DataFrame, budgets: list[float]) -> DataFrame:
    """budget, variant_id, n_runs affordable (one at least), mean and lower-quartile quality."""
    own = scores.join(costs.select("run_id", "total_cost_usd"), "run_id").groupBy("variant_id").agg(F.avg("total_cost_usd").alias("c"), F.avg("overall_median").alias("mean_score"), F.percentile("overall_median", 0.25).alias("q25_score"))
    grid = own.select("*", F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget"))
    return grid.where("budget >= c").select("budget", "variant_id", F.floor(F.col("budget") / F.col("c")).cast("long").alias("n_runs"), "mean_score", "q25_score")


def dimension_delta(scores: DataFrame, baseline: str = "v1") -> DataFrame:
    """variant_id, dimension, median_score, delta to the baseline's median (0.0 where it has none). scores: variant_id, dimension, score."""
    own = scores.groupBy("variant_id", "dimension").agg(F.median("score").alias("median_score"))
    base = own.where(F.col("variant_id") == baseline).select("dimension", F.col("median_score").alias("base"))
    return own.where(F.col("variant_id") != baseline).join(F.broadcast(base), "dimension", "left").select("variant_id", "dimension", "median_score", (F.col("median_score") - F.coalesce("base", F.lit(0.0))).alias("delta"))


def eta_squared(scores: DataFrame, group: str = "variant_id", value: str = "overall_median") -> DataFrame:
    """One row: share of the sum of squares that lies between groups."""
    own = scores.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    total = own.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    middle = F.col("s") * F.col("s") / F.col("n")
    return total.select("n", _over(F.col("between") - middle, F.col("q") - middle).alias("eta_squared"))


def coherence_per_design(checks: DataFrame, key: str = "design_id") -> DataFrame:
    """key, pairs_checked, contradictions, coherence_rate; only a true contradiction counts."""
    out = checks.groupBy(key).agg(F.count("*").alias("pairs_checked"), F.sum(F.when(F.col("contradicts"), 1).otherwise(0)).alias("contradictions"))
    return out.withColumn("coherence_rate", 1 - F.col("contradictions") / F.col("pairs_checked"))


def pivoted(rows: DataFrame, index: str, columns: str, values: list[str], value: str) -> DataFrame:
    """index by columns, mean of value; the columns' values are given, so that no pass is needed to find them."""
    return rows.groupBy(index).pivot(columns, values).agg(F.avg(value))


def boxplot(scores: DataFrame, by: list[str], value: str = "overall_median") -> DataFrame:
    """Five numbers of each group, and its place by median, best first."""
    out = scores.groupBy(*by).agg(F.min(value).alias("low"), F.percentile(value, 0.25).alias("q25"), F.percentile(value, 0.5).alias("median_score"), F.percentile(value, 0.75).alias("q75"), F.max(value).alias("high"))
    rest = [c for c in by if c != "variant_id"] or [F.lit(0)]
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*rest).orderBy(F.col("median_score").desc(), "variant_id")).cast("long"))


def case_studies(scores: DataFrame, n: int = 3, value: str = "overall_median") -> DataFrame:
    """design_id, variant_id, value, label: the best and worst n of all, then each variant's best and worst; an id keeps its first label. Ties go to the smaller id.

    The best and worst of all come from the n best and worst of each variant, so that no window holds all rows.
    """
    down, up = [F.col(value).desc(), F.col("design_id")], [F.col(value), F.col("design_id")]
    per = lambda o: F.row_number().over(Window.partitionBy("variant_id").orderBy(*o))
    rows = scores.select("design_id", "variant_id", value).withColumn("d", per(down)).withColumn("u", per(up)).where(f"d <= {n} or u <= {n}")
    rows = rows.withColumn("gd", F.row_number().over(Window.orderBy(*down))).withColumn("gu", F.row_number().over(Window.orderBy(*up)))
    label = F.when(F.col("gd") <= n, "top").when(F.col("gu") <= n, "bottom").when(F.col("d") == 1, "variant_best").when(F.col("u") == 1, "variant_worst")
    return rows.withColumn("label", label).where("label is not null").select("design_id", "variant_id", value, "label")


def novelty(embeddings: DataFrame, group: list[str], vector: str = "embedding") -> DataFrame:
    """group, n, mean_similarity, diversity: mean cosine over all pairs of a group with two vectors or more, rounded to 4.

    The mean over pairs follows from the sum of the unit vectors: (|sum|**2 - sum of squares) / (n (n - 1)), so no pairs are made.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = embeddings.select(*group, F.col(vector).alias("e"), norm.alias("norm")).where("e is not null")
    cells = unit.select(*group, "norm", F.posexplode("e").alias("_place", "x")).groupBy(*group, "_place").agg(F.sum(F.when(F.col("norm") > 0, F.col("x").cast("double") / F.col("norm")).otherwise(0.0)).alias("s"))
    square = cells.groupBy(*group).agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    sizes = unit.groupBy(*group).agg(F.count("*").alias("n"), F.sum((F.col("norm") > 0).cast("double")).alias("ones"))
    mean = (F.col("square") - F.col("ones")) / (F.col("n") * (F.col("n") - 1))
    return sizes.where("n >= 2").join(square, group).select(*group, "n", F.round(mean, 4).alias("mean_similarity"), F.round(1 - mean, 4).alias("diversity"))
