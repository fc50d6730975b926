"""Mergeable sketches of scores and texts: a state of bounded size for each group, whatever the group holds.

Sketches are built for the finest groups, before the shuffle, and coarser groups merge them; so quartiles by variant and
complexity and over all complexities read the scores once. Exact percentiles stay in analysis.py.

* Quantiles: KLL sketches. A sketch of parameter k holds a few times k values, is exact up to k values, and beyond that a
  quantile's rank is off by rank_error(k) of n at most, with 99 % confidence.
* Frequent texts: a sketch that tracks `tracked` texts holds exact counts up to that many distinct ones; beyond, a count is
  never too low and at most count_error() too high, and every text that is more frequent than that is there. Counts
  that add up to all texts are taken as exact.

exact_quantiles() takes sketches as a guide only: they tell where a quantile lies, and counts of the values there find it,
whatever the number of values.

Null values are in no sketch; a group without values has none.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialforge.operators.prefix import range_of
from trialforge.sources.scratch import stored

K = 8192
SHARES = {"low": 0.0, "q25": 0.25, "median_score": 0.5, "q75": 0.75, "high": 1.0}


def rank_error(k: int) -> float:
    """Largest error of a rank, as a share of n, with 99 % confidence (the fitted formula of the sketch's publication)."""
    return 2.296 / k**0.9021


def quantile_sketches(rows: DataFrame, by: list[str], value: str, k: int = K) -> DataFrame:
    """by, sketch."""
    return rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def rolled_up(sketches: DataFrame, sets: list[list[str]], k: int = K) -> DataFrame:
    """All columns of `sets`, null where a set lacks them, with `grouping` (0: no column is left out) and the merged sketch, for each grouping set."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return sketches.groupingSets(sets, *columns).agg(F.grouping_id().alias("grouping"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def quantiles(sketches: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """The sketches' other columns, n, and each share's quantile: a value that occurs."""
    found = F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, shares.values())))
    out = sketches.withColumn("n", F.kll_sketch_get_n_double("sketch")).withColumn("_q", found)
    for i, name in enumerate(shares):
        out = out.withColumn(name, F.col("_q")[i])
    return out.drop("sketch", "_q")


def _matched(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the further columns of `other` for the same keys, nulls equal."""
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(other.withColumnsRenamed({c: f"_of_{c}" for c in keys}), same).drop(*[f"_of_{c}" for c in keys])


def exact_quantiles(rows: DataFrame, sets: list[list[str]], value: str, shares: dict[str, float] = SHARES, k: int = K) -> DataFrame:
    """All columns of `sets`, grouping (as rolled_up() has them), n, and each share's quantile: the value of rank ceil(share * n), 1 at least.

    Merged sketches give two edges about each share, as far off as their error. Values between two edges are counted, which
    tells the cell that holds a rank, also where a sketch is further off than its error; the values of these cells alone are
    put in order.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    own = stored(rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*columns, F.col(value).cast("double").alias("_v")), "values")
    off = 1.5 * rank_error(k)
    near = sorted({min(1.0, max(0.0, s + d)) for s in shares.values() for d in (-off, off)})
    merged = rolled_up(quantile_sketches(own, columns, "_v", k), sets, k)
    edges = stored(merged.select(*columns, "grouping", F.kll_sketch_get_n_double("sketch").alias("n"), F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, near))).alias("_edges")), "edges")

    keys = [*columns, "grouping"]
    left_out = lambda s: sum(1 << i for i, c in enumerate(reversed(columns)) if c not in s)
    of_set = lambda s: F.struct(*[(F.col(c) if c in s else F.lit(None).cast(own.schema[c].dataType)).alias(c) for c in columns], F.lit(left_out(s)).cast("long").alias("grouping"))
    each = own.select(F.explode(F.array(*map(of_set, sets))).alias("_set"), "_v").select("_set.*", "_v")
    cells = _matched(each, edges, keys).withColumn("_cell", range_of(F.col("_v"), F.col("_edges"), len(near))).drop("_edges")

    counts = cells.groupBy(*keys, "n", "_cell").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_cell"))  # a row for each cell
    exact = [Fraction(str(float(s))) for s in shares.values()]
    ranks = F.array(*[F.greatest(F.lit(1), F.expr(f"(n * {s.numerator} + {s.denominator - 1}) div {s.denominator}")) for s in exact])
    placed = counts.withColumn("_before", upto - F.col("_c")).select(*keys, "n", "_cell", "_c", "_before", F.posexplode(ranks).alias("_share", "_rank"))
    placed = placed.where("_before < _rank and _rank <= _before + _c").groupBy(*keys, "n", "_cell").agg(F.collect_list(F.struct("_share", (F.col("_rank") - F.col("_before")).alias("_rank"))).alias("_wanted"))

    there = _matched(cells.drop("n"), stored(placed, "cells"), [*keys, "_cell"]).groupBy(*keys, "n", "_cell", "_v").agg(F.count("*").alias("_c"), F.any_value("_wanted").alias("_wanted"))
    there = there.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_cell").orderBy("_v")))
    found = there.select(*keys, "n", "_v", "_c", "_upto", F.explode("_wanted").alias("_w")).where("_upto - _c < _w._rank and _w._rank <= _upto")
    return found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("_w._share") == i, F.col("_v"))).alias(name) for i, name in enumerate(shares)])


def count_error(n: int, tracked: int) -> float:
    """How much too high a count of n texts may be, where more than `tracked` are distinct."""
    return 3.5 * n / 2 ** math.ceil(math.log2(tracked / 0.75))


def text_sketches(rows: DataFrame, by: list[str], text: str, width: int = 100, tracked: int = 1000) -> DataFrame:
    """by, sketch, rows: of the first characters of texts."""
    own = rows.where(F.col(text).isNotNull()).select(*by, F.substring(text, 1, width).alias("_text"))
    return own.groupBy(*by).agg(F.expr(f"approx_top_k_accumulate(_text, {tracked})").alias("sketch"), F.count("*").alias("rows"))


def frequent_texts(sketches: DataFrame, by: list[str], top: int, tracked: int = 1000) -> DataFrame:
    """by, text, n (never too low), at_least (n less the bound), place: the `top` most frequent texts, of equal counts the first by text. At most `tracked` texts of a group are put in order."""
    merged = sketches.groupBy(*by).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"), F.sum("rows").alias("rows"))
    each = merged.select(*by, "rows", F.explode(F.expr(f"approx_top_k_estimate(sketch, {tracked})")).alias("e")).select(*by, "rows", F.col("e.item").alias("text"), F.col("e.count").alias("n"), F.sum("e.count").over(Window.partitionBy(*by)).alias("told"))
    bound = F.when(F.col("told") == F.col("rows"), F.lit(0)).otherwise(F.ceil(F.col("rows") * count_error(1, tracked)))
    ordered = each.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "text"))).where(F.col("place") <= top)
    return ordered.select(*by, "text", "n", F.greatest(F.lit(0), F.col("n") - bound).cast("long").alias("at_least"), "place")
