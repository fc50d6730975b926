"""Running sums, numbers and neighbours over a whole table without one task that sees all rows.

Values are cut into ranges at approximate quantiles, found by an aggregate of the same plan. Sums of ranges are a few
rows; a running sum is that of the ranges before, plus a window within the range. Of lanes, only those of more than
LEAST rows are cut: a small lane is a window of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256
LEAST = 100_000


def range_of(column: Column, edges: Column, n: int) -> Column:
    """How many of n edges (an array, sorted) are at most the value, by bisection."""

    def pick(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(column < edges[m], pick(a, m)).otherwise(pick(m + 1, b))

    return pick(0, n)


def same_lane(lanes: list[str]) -> Column:
    """That the columns of lanes equal _lane0, _lane1, ..., nulls too."""
    same = F.lit(True)
    for i, c in enumerate(lanes):
        same &= F.col(c).eqNullSafe(F.col(f"_lane{i}"))
    return same


def ranged(rows: DataFrame, first: str, lanes: list[str] | None = None) -> DataFrame:
    """rows with _cut, whether their lane is cut, and _range, the number of their range by the column `first`: up to RANGES ranges of about the same size. Lanes of up to LEAST rows are one range."""
    n = min(RANGES, max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    at = F.col(first).cast("double")
    if lanes:
        # One row for each lane of more than LEAST rows.
        large = rows.groupBy(*lanes).agg(F.count("*").alias("_n")).where(F.col("_n") > LEAST)
        large = large.select(*[F.col(c).alias(f"_lane{i}") for i, c in enumerate(lanes)], F.lit(True).alias("_cut"))
        rows = rows.join(F.broadcast(large), same_lane(lanes), "left").drop(*[f"_lane{i}" for i in range(len(lanes))]).na.fill(False, ["_cut"])
    else:
        rows = rows.withColumn("_cut", F.lit(True))
    edges = rows.where("_cut").agg(F.percentile_approx(at, [k / n for k in range(1, n)], 4 * n).alias("_edges"))  # one row
    return rows.crossJoin(F.broadcast(edges)).withColumn("_range", F.when(F.col("_cut"), range_of(at, F.col("_edges"), n - 1)).otherwise(0)).drop("_edges")


def along(rows: DataFrame, order: list[str], values: dict[str, Column], columns: list[str], lanes: list[str] | None = None) -> DataFrame:
    """rows with what running() and followed() add, from one cut into ranges and one order within them."""
    lanes, names = lanes or [], list(values)
    cut = ranged(rows, order[0], lanes)
    for c, v in values.items():
        cut = cut.withColumn(f"_v_{c}", v)
    first = [F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("_first")] if columns else []
    totals = cut.where("_cut").groupBy(*lanes, "_range").agg(*[F.sum(f"_v_{c}").alias(f"_v_{c}") for c in names], *first)
    # One row for each range (and lane that is cut).
    over = Window.partitionBy(*(lanes or [F.lit(0)])).orderBy("_range")
    far = [F.sum(f"_v_{c}").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_far_{c}") for c in names] + ([F.lead("_first").over(over).alias("_first")] if columns else [])
    far = totals.select(*[F.col(c).alias(f"_lane{i}") for i, c in enumerate(lanes)], F.col("_range").alias("_r"), *far)
    within = Window.partitionBy(*lanes, "_range").orderBy(*order)
    near = [F.sum(f"_v_{c}").over(within.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_near_{c}") for c in names] + [F.lead(c).over(within).alias(f"_next_{c}") for c in columns] + [F.lead(F.lit(True)).over(within).isNull().alias("_last")]
    both = cut.select("*", *near).join(far if lanes else F.broadcast(far), (F.col("_range") == F.col("_r")) & same_lane(lanes), "left")
    sums = [(F.coalesce(F.col(f"_far_{c}"), F.lit(0)) + F.coalesce(F.col(f"_near_{c}"), F.lit(0))).alias(c) for c in names]
    return both.select(*rows.columns, *sums, *[F.when(F.col("_last"), F.col(f"_first.{c}")).otherwise(F.col(f"_next_{c}")).alias(f"next_{c}") for c in columns])


def running(rows: DataFrame, order: list[str], values: dict[str, Column], lanes: list[str] | None = None) -> DataFrame:
    """rows with the sum of each value over the rows that come before, by `order` (whose first column is a number without nulls), in each lane. Rows equal in all of `order` come in any order."""
    return along(rows, order, values, [], lanes)


def sums_before(rows: DataFrame, order: list[str], value: Column, out: str, lanes: list[str] | None = None) -> DataFrame:
    """rows with the sum of one value over the rows that come before, as running() has it."""
    return running(rows, order, {out: value}, lanes)


def followed(rows: DataFrame, order: list[str], columns: list[str], lanes: list[str] | None = None) -> DataFrame:
    """rows with next_<column> of the row that comes after, by `order`, in each lane; null for the last one. The last row of a range takes the first one of the next range that has any."""
    return along(rows, order, {}, columns, lanes)


def numbered(rows: DataFrame, order: list[str], out: str, lanes: list[str] | None = None) -> DataFrame:
    """rows with their number from 1, by `order`, in each lane. Where the first order column is no number, by a window over the lane."""
    if rows.schema[order[0]].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double"):
        return running(rows, order, {out: F.lit(1)}, lanes).withColumn(out, F.col(out) + 1)
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*(lanes or [F.lit(0)])).orderBy(*order)).cast("long"))
