"""Rank statistics over blocks: complete cases, Friedman, Wilcoxon, Mann-Whitney, Spearman, Cohen's d.

A block is one task and repetition. All statistics are DataFrame aggregates; only p-values, of a few rows, go through
Python. Where a cell has several values, the one with the smallest design_id stands for it. `strata` are columns (such
as complexity) that split everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialforge.functions import tails
from trialforge.operators.prefix import running, sums_before
from trialforge.sources.scratch import stored

BLOCK = ["task_id", "repetition"]


def cells(df: DataFrame, value: str = "overall_median", strata: list[str] | None = None) -> DataFrame:
    """One value of each variant and block."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return rows.groupBy(*(strata or []), "variant_id", *BLOCK).agg(F.min_by(value, "design_id").alias("v"))


def complete(df: DataFrame, value: str = "overall_median", strata: list[str] | None = None) -> DataFrame:
    """Cells of the blocks that have every variant (of the stratum)."""
    own, s = cells(df, value, strata), strata or []
    number = own.groupBy(*s).agg(F.countDistinct("variant_id").alias("k")) if s else own.agg(F.countDistinct("variant_id").alias("k"))
    blocks = own.groupBy(*s, *BLOCK).agg(F.count("*").alias("have"))
    blocks = blocks.join(number, s) if s else blocks.crossJoin(number)  # one row
    return own.join(blocks.where("have = k").select(*s, *BLOCK, "k"), [*s, *BLOCK])


def average_rank(partition: list, column, descending: bool = True):
    """Average rank within a partition; ties share the mean of their places."""
    order = Window.partitionBy(*partition).orderBy(column.desc() if descending else column.asc())
    same = Window.partitionBy(*partition, column)
    return F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / 2.0


def mean_ranks(df: DataFrame, value: str = "overall_median", strata: list[str] | None = None) -> DataFrame:
    """strata, variant_id, mean_rank (1 is best), mean_score, n_blocks over complete blocks."""
    s = strata or []
    ranked = complete(df, value, strata).withColumn("r", average_rank([*s, *BLOCK], F.col("v")))
    return ranked.groupBy(*s, "variant_id").agg(F.avg("r").alias("mean_rank"), F.avg("v").alias("mean_score"), F.count("*").alias("n_blocks"))


def friedman(df: DataFrame, value: str = "overall_median", strata: list[str] | None = None) -> DataFrame:
    """strata, k, n_blocks, q (corrected for ties): of three variants or more."""
    s = strata or []
    ranked = complete(df, value, strata).withColumn("r", average_rank([*s, *BLOCK], F.col("v")))
    sums = ranked.groupBy(*s, "variant_id").agg(F.sum("r").alias("total"), F.max("k").alias("k"), F.count("*").alias("n"))
    ties = ranked.groupBy(*s, *BLOCK, "v").agg(F.count("*").alias("t")).groupBy(*s).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    own = sums.groupBy(*s).agg(F.max("k").alias("k"), F.max("n").alias("n_blocks"), F.sum(F.col("total") * F.col("total")).alias("squares"))
    own = own.join(ties, s) if s else own.crossJoin(ties)  # one row by one row
    n, k = F.col("n_blocks"), F.col("k")
    plain = 12 / (n * k * (k + 1)) * F.col("squares") - 3 * n * (k + 1)
    correction = 1 - F.col("ties") / (n * k * (k * k - 1))
    return own.where("k >= 3").select(*s, "k", "n_blocks", F.when(correction > 0, plain / correction).otherwise(F.lit(0.0)).alias("q"))


def stratified(df: DataFrame, by: str = "complexity", whole: str = "all") -> DataFrame:
    """Each row in the stratum `whole`, and once more in that of its `by`, if it has one: overall and stratified statistics of one plan, with strata=["stratum"]."""
    return df.withColumn("stratum", F.explode(F.array_compact(F.array(F.lit(whole), F.col(by)))))


def with_friedman_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", tails.chi2_column()(F.col("q"), (F.col("k") - 1).cast("double")))


def signed_ranks(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, zeros, n_used, w_plus, w_minus, ties, effect_compat, effect, mean_diff. pairs: keys and d, one row per block.

    effect_compat is 1 - 2W/(n(n+1)) with W the smaller sum, 0.5 where there is no effect and 1 without a difference; effect is 1 - 4W/(m(m+1)) over
    the m non-zero differences, 0 where there is none.
    """
    d = F.round("d", 9)
    # Counts of distinct differences, for all that follows.
    rows = stored(pairs.withColumn("d", d).groupBy(*keys, "d").agg(F.count("*").alias("c"), F.sum("d").alias("total")), "differences").withColumn("size", F.abs("d"))
    sizes = rows.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("d") == 0, F.col("c")).otherwise(0)).alias("zeros"), (F.sum("total") / F.sum("c")).alias("mean_diff"))
    # Ranks are those of the distinct sizes, summed up range by range, with the keys as lanes.
    used = rows.where("d <> 0").groupBy(*keys, "size").agg(F.sum("c").alias("t"), F.sum(F.when(F.col("d") > 0, F.col("c")).otherwise(0)).alias("up"))
    used = running(used, ["size"], {"below": F.col("t")}, keys).withColumn("r", F.col("below") + (F.col("t") + 1) / 2.0)
    sums = used.groupBy(*keys).agg(F.sum(F.col("up") * F.col("r")).alias("w_plus"), F.sum((F.col("t") - F.col("up")) * F.col("r")).alias("w_minus"), F.sum(F.col("t") * (F.col("t") * F.col("t") - 1)).cast("double").alias("ties"))
    out = sizes.join(sums, keys, "left").na.fill(0.0, ["w_plus", "w_minus", "ties"]).withColumn("n_used", F.col("n") - F.col("zeros"))
    w, n, m = F.least("w_plus", "w_minus"), F.col("n"), F.col("n_used")
    return out.withColumn("effect_compat", 1 - 2 * w / (n * (n + 1))).withColumn("effect", F.when(m > 0, 1 - 4 * w / (m * (m + 1))).otherwise(0.0))


def paired(df: DataFrame, value: str = "overall_median", strata: list[str] | None = None, pairs: list[tuple[str, str]] | None = None, baseline: str | None = None, complete_only: bool = True) -> DataFrame:
    """strata, variant_a, variant_b, block, d = a - b: of all pairs a < b, of `pairs`, or of the baseline with all others."""
    own = complete(df, value, strata) if complete_only else cells(df, value, strata)
    s = strata or []
    a = own.select(*s, *BLOCK, F.col("variant_id").alias("variant_a"), F.col("v").alias("va"))
    b = own.select(*s, *BLOCK, F.col("variant_id").alias("variant_b"), F.col("v").alias("vb"))
    joined = a.join(b, [*s, *BLOCK])
    if pairs is not None:
        wanted = df.sparkSession.createDataFrame(pairs, "variant_a string, variant_b string")
        joined = joined.join(F.broadcast(wanted), ["variant_a", "variant_b"])
    elif baseline is not None:
        joined = joined.where((F.col("variant_a") == baseline) & (F.col("variant_b") != baseline))
    else:
        joined = joined.where("variant_a < variant_b")
    return joined.withColumn("d", F.col("va") - F.col("vb"))


def wilcoxon(df: DataFrame, strata: list[str] | None = None, family: int | str | None = "all", least_blocks: int = 1, **how) -> DataFrame:
    """signed_ranks() of paired(), with p_value and p_adjusted = min(1, p * family). family: a number, None for no correction, or "all" for the number of comparisons made (of each stratum)."""
    s = strata or []
    out = signed_ranks(paired(df, strata=strata, **how), [*s, "variant_a", "variant_b"]).where(F.col("n") >= least_blocks)
    out = out.withColumn("p_value", tails.wilcoxon_column()("w_plus", "w_minus", "n_used", "ties", "zeros"))
    m = F.count(F.lit(1)).over(Window.partitionBy(*(s or [F.lit(0)]))) if family == "all" else F.lit(family or 1)
    return out.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p_value") * m))


def targeted(df: DataFrame, pairs: list[tuple[str, str]], by: str = "complexity", least_blocks: int = 3) -> DataFrame:
    """variant_a, variant_b, stratum ("all" or a value of `by`), wilcoxon()'s columns and cohens_d of given pairs.

    Blocks are complete within their stratum. Overall p-values are adjusted for the number of pairs; within a stratum,
    which needs three blocks, they are as they are.
    """
    rows = stratified(df, by)
    found = wilcoxon(rows, strata=["stratum"], pairs=pairs, family=None)
    whole = F.col("stratum") == "all"
    found = found.where(whole | (F.col("n") >= least_blocks)).withColumn("p_adjusted", F.when(whole, F.least(F.lit(1.0), F.col("p_value") * len(pairs))).otherwise(F.col("p_value")))
    own = complete(rows, strata=["stratum"]).select("stratum", "variant_id", F.col("v").alias("overall_median"))
    return found.join(cohens_d(own, strata=["stratum"]), ["stratum", "variant_a", "variant_b"], "left")


def mann_whitney(rows: DataFrame, group: str, value: str, first, strata: list[str] | None = None) -> DataFrame:
    """strata, n_first, n_second, u (of the first), effect = 1 - 2u/(n1 n2), ties. rows with a null group are left out; all groups but `first` (a value or a Column) are the second sample.

    The rank of a value is made from counts of distinct values, summed up range by range, so that no window holds
    all values of a stratum.
    """
    s = strata or []
    own = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(*s, F.col(value).alias("v")).agg(F.sum((F.col(group) == first).cast("long")).alias("a"), F.count("*").alias("t"))
    ranked = sums_before(stored(own, "values"), ["v"], F.col("t"), "below", s).withColumn("r", F.col("below") + (F.col("t") + 1) / 2.0)
    out = ranked.groupBy(*s).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in (("n_first", F.col("a")), ("n_second", F.col("t") - F.col("a")))], F.coalesce(F.sum(F.col("a") * F.col("r")), F.lit(0.0)).alias("rank_sum"), F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double"), F.lit(0.0)).alias("ties"))
    n1, n2 = F.col("n_first"), F.col("n_second")
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2.0
    return out.select(*s, "n_first", "n_second", u.alias("u"), F.when((n1 > 0) & (n2 > 0), 1 - 2 * u / (n1 * n2)).alias("effect"), "ties")


def with_mann_whitney_p(df: DataFrame, alternative: str = "two-sided") -> DataFrame:
    return df.withColumn("p_value", tails.mann_whitney_column(alternative)("u", "n_first", "n_second", "ties"))


def spearman(rows: DataFrame, x: str, y: str, least: int = 5) -> DataFrame:
    """One row: n, rho (null under `least` rows, or where one side does not vary), by average ranks."""
    own = stored(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y")), "values")

    def ranks(c: str) -> DataFrame:
        counts = own.groupBy(c).agg(F.count("*").alias("t"))
        return sums_before(counts, [c], F.col("t"), "below").select(c, (F.col("below") + (F.col("t") + 1) / 2.0).alias(f"r{c}"))

    both = own.join(ranks("x"), "x").join(ranks("y"), "y")
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")
    out = both.agg(F.count("*").alias("n"), F.covar_pop("rx", "ry").alias("together"), spread.alias("spread"))
    return out.select("n", F.when((F.col("n") >= least) & (F.col("spread") > 0), F.col("together") / F.col("spread")).alias("rho"))


def with_spearman_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", tails.spearman_column()("rho", "n"))


def cohens_d(df: DataFrame, value: str = "overall_median", strata: list[str] | None = None) -> DataFrame:
    """strata, variant_a, variant_b, d with the pooled deviation, 0 if a side has one value or nothing varies; all pairs a < b."""
    s = strata or []
    own = df.groupBy(*s, "variant_id").agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("s2"))
    a, b = (own.select(*s, *[F.col(c).alias(f"{c}_{k}") for c in own.columns if c not in s]) for k in "ab")
    ordered = F.col("variant_id_a") < F.col("variant_id_b")
    pairs = a.join(b, s).where(ordered) if s else a.join(b, ordered)
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("s2_a") + (F.col("n_b") - 1) * F.col("s2_b")) / (F.col("n_a") + F.col("n_b") - 2))
    ok = (F.col("n_a") >= 2) & (F.col("n_b") >= 2) & (F.col("s2_a") + F.col("s2_b") > 0)
    return pairs.select(*s, F.col("variant_id_a").alias("variant_a"), F.col("variant_id_b").alias("variant_b"), F.when(ok, (F.col("m_a") - F.col("m_b")) / pooled).otherwise(0.0).alias("cohens_d"))


#: Place of each parent variant on the three axes.
TAXONOMY = {
    "v1": ("centralized", "homogeneous", "cooperative"),
    "v2": ("centralized", "homogeneous", "cooperative"),
    "v3": ("decentralized", "homogeneous", "cooperative"),
    "v4": ("centralized", "homogeneous", "adversarial"),
    "v5": ("centralized", "specialized", "cooperative"),
    "v6": ("decentralized", "specialized", "cooperative"),
    "v7": ("decentralized", "homogeneous", "cooperative"),
    "v8": ("decentralized", "homogeneous", "adversarial"),
}
AXES = ("authority", "roles", "dynamics")


def parent_variant(column):
    """v2a and v2a_same_model belong to v2; null for what is no variant."""
    return F.nullif(F.regexp_extract(column, r"^(v\d+)", 1), F.lit(""))


def axis_level(column, axis: str):
    k, out = AXES.index(axis), F.lit(None).cast("string")
    for parent, levels in TAXONOMY.items():
        out = F.when(parent_variant(column) == parent, F.lit(levels[k])).otherwise(out)
    return out


def axis_effects(df: DataFrame, value: str = "overall_median") -> DataFrame:
    """axis, level_a (alphabetically first), level_b and the rank-sum statistics of each axis; unknown variants are left out."""
    ends = {axis: sorted({levels[i] for levels in TAXONOMY.values()}) for i, axis in enumerate(AXES)}
    # Each row once for each axis, so that all axes share one plan; the axis is the lane of the ranks.
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(low).alias("level_a"), F.lit(high).alias("level_b"), axis_level(F.col("variant_id"), a).alias("level")) for a, (low, high) in ends.items()])).alias("x")
    rows = df.select(F.col(value).alias("value"), each).select("value", "x.*")
    keys = ["axis", "level_a", "level_b"]
    found = mann_whitney(rows, "level", "value", F.col("level_a"), keys)
    # An axis without rows has a row too.
    axes = df.sparkSession.createDataFrame([(a, *x) for a, x in ends.items()], "axis string, level_a string, level_b string")
    return axes.join(found, keys, "left").na.fill(0, ["n_first", "n_second"]).na.fill(0.0, ["u", "ties"])
