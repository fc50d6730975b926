"""Completeness kept up to date batch by batch: what is new is counted, not all that is there.

A batch of facts (a completed run, a scored run, a checked run) is written under its batch id, without what earlier
batches had; beside it go its new triples and one row of changes to the counts. Facts that were there of its runs come
from one exchange of run ids and kinds, and new triples are compared with the earlier triples, which are as few as the
design has; so no batch orders the earlier facts again and again. The counts are the sum of these rows. A batch that is
delivered again (after a failure, under the same id) is compared with the batches before it alone and overwrites its own
files, so it changes nothing. Facts may come in any order: a design is evaluated once its run is completed and its score
is there, whichever comes last; of a batch, only the runs that it names are looked up among earlier facts.

Null run ids are left out; repeated facts count once; an empty batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.operators.progress import TRIPLE

KINDS = ("completed", "scored", "checked")
FACT = "run_id long, kind string, variant_id string, task_id string, repetition long"
TRIPLES = "variant_id string, task_id string, repetition long"
CHANGES = ["actual_runs", "inside", "final_designs", "evaluated", "checked"]


class Completeness:
    """matrix: the expected triples, a configuration table. folder: a shared one, of this feed alone."""

    def __init__(self, spark: SparkSession, folder: str, matrix: DataFrame):
        self.spark, self.folder, self.matrix = spark, folder.rstrip("/"), matrix.select(*TRIPLE).distinct()

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema + ", batch long")
        return self.spark.read.schema(schema + ", batch long").parquet(f"{self.folder}/{name}")

    def facts(self) -> DataFrame:
        return self._read("facts", FACT)

    def changes(self) -> DataFrame:
        return self._read("changes", ", ".join(f"{c} long" for c in CHANGES))

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        """Takes in a batch of facts: columns of FACT (triples with completed runs). For foreachBatch."""
        bit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(1 << i)) for i, k in enumerate(KINDS)])
        columns = [c.split()[0] for c in FACT.split(", ")]
        before = self.facts().where(F.col("batch") < batch_id).select("run_id", bit.alias("old"), F.lit(0).alias("new"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in FACT.split(", ")[2:])])
        given = batch.where(F.col("run_id").isNotNull() & F.col("kind").isin(*KINDS)).select("run_id", F.lit(0).alias("old"), bit.alias("new"), *columns[2:])
        # A row of each run that the batch names: kinds that were there and that are new, as bits, and its triple.
        triple = F.any_value(F.when(F.col("new") == 1, F.struct(*TRIPLE)), True)
        runs = before.unionByName(given).groupBy("run_id").agg(F.bit_or("old").alias("old"), F.bit_or("new").alias("new"), triple.alias("triple"))
        runs = runs.withColumn("new", F.col("new").bitwiseAND(F.bitwise_not("old"))).where("new <> 0")
        path = f"{self.folder}/runs/batch={batch_id}"
        runs.write.mode("overwrite").parquet(path)
        runs = self.spark.read.schema("run_id long, old int, new int, triple struct<variant_id: string, task_id: string, repetition: long>").parquet(path)

        gone = F.filter(F.array(*[F.when(F.col("new").bitwiseAND(F.lit(1 << i)) != 0, F.lit(k)) for i, k in enumerate(KINDS)]), lambda k: k.isNotNull())
        fresh = runs.select("run_id", F.explode(gone).alias("kind"), "triple")
        fresh.select("run_id", "kind", *[F.when(F.col("kind") == "completed", F.col(f"triple.{c}")).alias(c) for c in TRIPLE]).write.mode("overwrite").parquet(f"{self.folder}/facts/batch={batch_id}")

        has = lambda column, kinds: F.col(column).bitwiseAND(F.lit(sum(1 << KINDS.index(k) for k in kinds))) == sum(1 << KINDS.index(k) for k in kinds)
        now = F.col("old").bitwiseOR(F.col("new"))
        gained = lambda *kinds: F.coalesce(F.count_if(has("now", kinds) & ~has("old", kinds)), F.lit(0))
        of_runs = runs.withColumn("now", now).agg(gained("completed").alias("final_designs"), gained("completed", "scored").alias("evaluated"), gained("completed", "checked").alias("checked"))

        done = runs.where(F.col("new").bitwiseAND(F.lit(1)) != 0).select("triple.*").distinct()
        earlier = self._read("triples", TRIPLES).where(F.col("batch") < batch_id).select(*TRIPLE)
        done.join(earlier, TRIPLE, "left_anti").write.mode("overwrite").parquet(f"{self.folder}/triples/batch={batch_id}")
        new = self._read("triples", TRIPLES).where(F.col("batch") == batch_id).select(*TRIPLE)
        inside = new.join(self.matrix.withColumn("wanted", F.lit(1)), TRIPLE, "left")
        of_triples = inside.agg(F.count("*").alias("actual_runs"), F.count("wanted").alias("inside"))
        of_triples.crossJoin(of_runs).select(*CHANGES).write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch_id}")  # one row by one row

    def now(self) -> DataFrame:
        """The row of progress.completeness(), from the sums of the changes."""
        sums = self.changes().agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CHANGES])
        out = self.matrix.agg(F.count("*").alias("expected_runs")).crossJoin(sums)  # one row by one row
        ratio = lambda top, bottom: F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)
        return out.select(
            "expected_runs", "actual_runs", (F.col("expected_runs") - F.col("inside")).alias("missing_runs"), "final_designs", (F.col("final_designs") - F.col("evaluated")).alias("unevaluated"), (F.col("final_designs") - F.col("checked")).alias("unchecked"),
            ratio("actual_runs", "expected_runs").alias("run_coverage"), ratio("evaluated", "final_designs").alias("evaluation_coverage"), ratio("checked", "final_designs").alias("coherence_coverage"),
        )


def facts_of(runs: DataFrame, scored: DataFrame, checked: DataFrame) -> DataFrame:
    """Tables as a feed of facts: completed runs with their triples, scored and checked run ids."""
    done = runs.where("status = 'completed'").select("run_id", F.lit("completed").alias("kind"), *TRIPLE)
    none = [F.lit(None).cast("string").alias(c) for c in TRIPLE[:2]] + [F.lit(None).cast("long").alias(TRIPLE[2])]
    rest = [df.select("run_id", F.lit(k).alias("kind"), *none) for k, df in (("scored", scored), ("checked", checked))]
    return done.unionByName(rest[0]).unionByName(rest[1])
