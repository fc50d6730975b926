"""Experiment tables laid out for the joins that nearly every analysis makes: co-bucketed by design and run.

A design has its run's id here, so runs, evaluations, medians and coherence checks are dealt into the same buckets by
that id, once, when they are written, and sorted in them. Views join bucket with bucket: no exchange and no sort. Runs
are also partitioned by status, so that views of final runs read the files of completed ones alone. Medians have one row
for each design, however many evaluations it has; the buckets of evaluations follow their designs.

A built store writes a table when it is first read, so that a view costs the tables that it joins and no others.

The number of buckets follows the rows (ROWS_IN_BUCKET of the largest table), so that buckets stay of a size as the
tables grow; tables that are to be joined share it. What is added later goes into the same buckets, as further files.
Null ids are in no view, and go to one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.sources import adapter

ROWS_IN_BUCKET = 2_000_000
#: Key of each table, and the columns that partition it.
LAYOUT = {"runs": ("run_id", ["status"]), "evaluations": ("design_id", []), "scores_median": ("design_id", []), "coherence_checks": ("design_id", [])}


class BucketedStore:
    def __init__(self, spark: SparkSession, prefix: str, buckets: int, sources: dict[str, Callable[[], DataFrame]] | None = None):
        """sources: what a table is written from when it is read and is not there."""
        self.spark, self.prefix, self.buckets, self.sources = spark, prefix, buckets, sources or {}

    def name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def exists(self) -> bool:
        return all(self.spark.catalog.tableExists(self.name(t)) for t in LAYOUT)

    def write(self, table: str, rows: DataFrame, mode: str = "overwrite") -> None:
        """One exchange: each task gets whole buckets, and writes a sorted file for each (and each status)."""
        key, by = LAYOUT[table]
        writer = rows.repartition(self.buckets, key).write.mode(mode).format("parquet").bucketBy(self.buckets, key).sortBy(key)
        (writer.partitionBy(*by) if by else writer).saveAsTable(self.name(table))

    def add(self, table: str, rows: DataFrame) -> None:
        """Further rows of new designs, in the same buckets."""
        self.write(table, rows.select(*self.read(table).columns), "append")

    def read(self, table: str) -> DataFrame:
        if table in self.sources and not self.spark.catalog.tableExists(self.name(table)):
            self.write(table, self.sources[table]())
        return self.spark.table(self.name(table))

    def drop(self) -> None:
        for t in LAYOUT:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(t)}")

    def final_runs(self) -> DataFrame:
        return self.read("runs").where("status = 'completed'")

    def score_view(self) -> DataFrame:
        """variant_id, task_id, repetition, design_id, run_id, overall_median, complexity of scored designs of completed runs."""
        done = self.final_runs().select("run_id", "variant_id", "task_id", "repetition")
        scored = self.read("scores_median").select("design_id", "overall_median")
        tasks = F.broadcast(adapter.tasks(self.spark))  # a fixed table
        return done.join(scored, done["run_id"] == scored["design_id"]).join(tasks, "task_id", "left").select("variant_id", "task_id", "repetition", "design_id", "run_id", "overall_median", "complexity")

    def cost_view(self) -> DataFrame:
        return self.final_runs().select("variant_id", "task_id", "repetition", "run_id", "total_cost_usd", "total_input_tokens", "total_output_tokens", "duration_seconds")

    def coherence_view(self) -> DataFrame:
        """variant_id, task_id, repetition, design_id, pairs_checked, contradictions of completed runs with checks: summed within the buckets."""
        own = self.read("coherence_checks").groupBy("design_id").agg(F.count("*").alias("pairs_checked"), F.sum(F.col("contradicts").cast("long")).alias("contradictions"))
        done = self.final_runs().select("run_id", "variant_id", "task_id", "repetition")
        return done.join(own, done["run_id"] == own["design_id"]).select("variant_id", "task_id", "repetition", "design_id", "pairs_checked", "contradictions")

    def rater_view(self) -> DataFrame:
        """Evaluations of completed runs with the run's variant and task, and the design's median."""
        done = self.final_runs().select("run_id", "variant_id", "task_id")
        each = self.read("evaluations").select("design_id", "evaluator_model", "overall_score")
        scored = self.read("scores_median").select(F.col("design_id").alias("_id"), "overall_median")
        return done.join(each, done["run_id"] == each["design_id"]).join(scored, F.col("design_id") == F.col("_id")).select("variant_id", "task_id", "design_id", "evaluator_model", "overall_score", "overall_median")


def built(spark: SparkSession, sf: str, rows_in_bucket: int = ROWS_IN_BUCKET) -> BucketedStore:
    """The tables of sf, laid out in buckets: each is written when this application first reads it."""
    prefix = f"tf_{hashlib.md5(f'{spark.sparkContext.applicationId} {sf} {rows_in_bucket}'.encode()).hexdigest()[:16]}"
    evaluations = adapter.evaluations(spark, sf)

    def medians() -> DataFrame:
        # Bucket by bucket where evaluations are laid out; else from their scores alone, dealt by design once.
        there = spark.catalog.tableExists(store.name("evaluations"))
        own = store.read("evaluations") if there else evaluations.select("design_id", "overall_score").repartition(store.buckets, "design_id")
        return own.groupBy("design_id").agg(F.median("overall_score").alias("overall_median"), F.count("*").alias("n_raters"))

    sources = {"runs": lambda: adapter.runs(spark, sf), "evaluations": lambda: evaluations, "scores_median": medians, "coherence_checks": lambda: adapter.coherence_checks(spark, sf)}
    store = BucketedStore(spark, prefix, max(1, -(-evaluations.count() // rows_in_bucket)), sources)
    return store
