"""What is done and what is left: expected matrix, missing runs, pending work, budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialforge.operators.prefix import sums_before

TRIPLE = ["variant_id", "task_id", "repetition"]


def expected(spark: SparkSession, variants: list[str], tasks: list[str], repetitions: list[int]) -> DataFrame:
    """The matrix of variants, tasks and repetitions, from three short lists."""
    lists = [F.explode(F.array(*[F.lit(x) for x in values])) for values in (variants, tasks)]
    return spark.range(1).select(lists[0].alias("variant_id")).select("variant_id", lists[1].alias("task_id")).select("*", F.explode(F.array(*[F.lit(int(r)).cast("long") for r in repetitions])).alias("repetition"))


def expected_of(runs: DataFrame) -> DataFrame:
    """The matrix of the variants, tasks and repetitions that occur in runs: three short lists, gathered in one row."""
    lists = runs.agg(*[F.collect_set(c).alias(c) for c in TRIPLE])
    out = lists.select(F.explode("variant_id").alias("variant_id"), "task_id", "repetition").select("variant_id", F.explode("task_id").alias("task_id"), "repetition")
    return out.select("variant_id", "task_id", F.explode("repetition").alias("repetition"))


def missing_runs(matrix: DataFrame, runs: DataFrame) -> DataFrame:
    return matrix.join(runs.where("status = 'completed'").select(*TRIPLE).distinct(), TRIPLE, "left_anti")


def pending(matrix: DataFrame, runs: DataFrame, scored: DataFrame, checked: DataFrame, force: bool = False) -> DataFrame:
    """TRIPLE and whether generate, evaluate and coherence are pending: all three without a completed run (or with force), else what the run lacks. scored, checked: run_id."""
    done = runs.where("status = 'completed'").groupBy(*TRIPLE).agg(F.max("run_id").alias("run_id"))
    flags = done.join(scored.select("run_id").distinct().withColumn("s", F.lit(True)), "run_id", "left").join(checked.select("run_id").distinct().withColumn("c", F.lit(True)), "run_id", "left")
    out = matrix.join(flags, TRIPLE, "left")
    new = F.col("run_id").isNull() | F.lit(force)
    return out.select(*TRIPLE, new.alias("generate"), (new | F.col("s").isNull()).alias("evaluate"), (new | F.col("c").isNull()).alias("coherence"))


def stage_counts(work: DataFrame) -> DataFrame:
    """stage, pending, done of a pending() frame."""
    stages = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("open")) for s in ("generate", "evaluate", "coherence")])).alias("x")
    return work.select(stages).select("x.*").groupBy("stage").agg(F.sum(F.col("open").cast("long")).alias("pending"), F.sum((~F.col("open")).cast("long")).alias("done"))


def next_stages(work: DataFrame) -> DataFrame:
    """TRIPLE and `ready`: the stages that can start now. Evaluation and coherence wait for the run of their own triple only, and not for each other."""
    ready = F.when(F.col("generate"), F.array(F.lit("generate"))).otherwise(F.array_compact(F.array(F.when(F.col("evaluate"), "evaluate"), F.when(F.col("coherence"), "coherence"))))
    return work.select(*TRIPLE, F.array_join(ready, "+").alias("ready"))


def barrier(work: DataFrame) -> DataFrame:
    """One row: triples, the open ones, and whether the analysis may begin, which waits for all of them."""
    open_ = F.col("generate") | F.col("evaluate") | F.col("coherence")
    return work.agg(F.count("*").alias("triples"), F.count_if(open_).alias("open"), (F.count_if(open_) == 0).alias("analyse"))


def staged_run(matrix: DataFrame, state: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], generate: Callable[[DataFrame], None], evaluate: Callable[[DataFrame], None], coherence: Callable[[DataFrame], None], analyse: Callable[[], DataFrame], limit: float = float("inf"), order: list[str] | None = None) -> DataFrame | None:
    """Runs what is pending, stage by stage, and the analysis behind the barrier; None while anything is open.

    state() gives runs, scored and checked as they are now; a stage's function gets the triples (or runs) that it is to
    work on and stores what it makes, so that a run that was broken off goes on where it stood. Generation stops when
    the completed runs have cost `limit`; evaluation and coherence don't wait for each other. order: columns by which
    triples are dealt (by hash as a default).
    """
    now = lambda: pending(matrix, *state())
    runs, _, _ = state()
    spent = runs.where("status = 'completed'").agg(F.sum("total_cost_usd")).first()[0] if "total_cost_usd" in runs.columns else 0
    if (spent or 0) < limit:
        generate(now().where("generate").select(*TRIPLE).orderBy(*(order or hash_order(*TRIPLE))))
    for name, work in (("evaluate", evaluate), ("coherence", coherence)):
        work(now().where(F.col(name) & ~F.col("generate")).select(*TRIPLE))
    return analyse() if barrier(now()).first()["analyse"] else None


def completeness(matrix: DataFrame, runs: DataFrame, designs: DataFrame, scored: DataFrame, checked: DataFrame) -> DataFrame:
    """One row: expected, actual (all completed triples, inside the matrix or not), missing, final designs, evaluated and checked designs, and the ratios. designs: design_id, run_id."""
    done = runs.where("status = 'completed'")
    final = designs.join(done.select("run_id"), "run_id", "left_semi")
    parts = [
        matrix.agg(F.count("*").alias("expected_runs")), done.select(*TRIPLE).distinct().agg(F.count("*").alias("actual_runs")), missing_runs(matrix, runs).agg(F.count("*").alias("missing_runs")), final.agg(F.count("*").alias("final_designs")),
        final.join(scored.select("design_id"), "design_id", "left_anti").agg(F.count("*").alias("unevaluated")), final.join(checked.select("design_id"), "design_id", "left_anti").agg(F.count("*").alias("unchecked")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    ratio = lambda top, bottom: F.when(F.col(bottom) > 0, top / F.col(bottom)).otherwise(0.0)
    return out.withColumn("run_coverage", ratio(F.col("actual_runs"), "expected_runs")).withColumn("evaluation_coverage", ratio(F.col("final_designs") - F.col("unevaluated"), "final_designs")).withColumn("coherence_coverage", ratio(F.col("final_designs") - F.col("unchecked"), "final_designs"))


def admission(requests: DataFrame, runs: DataFrame, resume: bool = False, force: bool = False) -> DataFrame:
    """Decision on each requested triple: run, rerun (delete first), or the reason of a rejection."""
    known = runs.groupBy(*TRIPLE).agg(F.max_by("status", "run_id").alias("status"))
    status, again = F.col("status"), F.lit(resume or force)
    decision = F.when(status.isNull(), "run").when((status == "completed") & ~F.lit(force), "reject_completed").when((status != "completed") & ~again, "reject_existing").otherwise("rerun")
    return requests.join(known, TRIPLE, "left").select(*TRIPLE, decision.alias("decision"))


def within_budget(runs: DataFrame, limit: float, order: list[str], cost: str = "total_cost_usd", lane: str | None = None) -> DataFrame:
    """Runs until the cost passes the limit; the run that crosses it is the last. order: columns, the first a number; lane: budgets are per value of this column."""
    spent = sums_before(runs, order, F.coalesce(F.col(cost).cast("double"), F.lit(0.0)), "spent_before", [lane] if lane else None)
    return spent.where(F.col("spent_before") <= limit)


def hash_text(*columns, seed: int = 42):
    """A hexadecimal text that deals rows alike at every run and in every engine."""
    return F.md5(F.concat_ws("_", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))).cast("binary"))


def hash_order(*columns, seed: int = 42):
    """A sort key that shuffles rows alike at every run: by hash, with the columns themselves against ties."""
    return [hash_text(*columns, seed=seed), *[F.col(c) for c in columns]]


def stratified_sample(rows: DataFrame, by: str, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """max(1, int(n * fraction)) rows of each stratum, by smallest hash.

    Hashes are counted by their first three digits; whole bins are taken as long as they fit, and only the rows of a
    stratum's last bin, about one in 4,096, are put in order.
    """
    own = rows.withColumn("_bin", F.substring(hash_text(key, seed=seed), 1, 3))
    bins = own.groupBy(by, "_bin").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by)  # 4,096 rows at most
    upto = F.sum("_n").over(w.orderBy("_bin"))
    left = F.greatest(F.lit(1), F.floor(F.sum("_n").over(w) * fraction)) - (upto - F.col("_n"))
    bins = bins.select(F.col(by).alias("_by"), F.col("_bin").alias("_b"), "_n", left.alias("_left")).where("_left > 0")
    met = own.join(bins, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bin") == F.col("_b")))
    whole = met.where("_n <= _left").select(*rows.columns)
    cut = met.where("_n > _left").withColumn("_place", F.row_number().over(Window.partitionBy("_by", "_b").orderBy(*hash_order(key, seed=seed))))
    return whole.union(cut.where("_place <= _left").select(*rows.columns))


def call_seed(*parts):
    """md5 of the parts joined by "_", low 31 bits."""
    digest = F.md5(F.concat_ws("_", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 25, 8), 16, 10).cast("long").bitwiseAND(F.lit(2147483647))


def scoring_queue(designs: DataFrame, evaluations: DataFrame, checks: DataFrame, medians: DataFrame, wanted: int) -> DataFrame:
    """Designs that still need work, from what is there: design_id, evals_left, checks_left, median_missing. designs: design_id, pairs (checks that the design's rubric asks for); evaluations, checks, medians: design_id.

    A queue that was broken off goes on from these counts; more than was wanted leaves nothing to do.
    """
    count = lambda df, name: df.groupBy("design_id").agg(F.count("*").alias(name))
    own = designs.join(count(evaluations, "evals"), "design_id", "left").join(count(checks, "checks"), "design_id", "left").join(medians.select("design_id").distinct().withColumn("has", F.lit(True)), "design_id", "left")
    left = lambda want, have: F.greatest(F.lit(0), want - F.coalesce(have, F.lit(0))).cast("long")
    out = own.select("design_id", left(F.lit(wanted), F.col("evals")).alias("evals_left"), left(F.coalesce("pairs", F.lit(0)), F.col("checks")).alias("checks_left"), F.col("has").isNull().alias("median_missing"))
    return out.where("evals_left > 0 or checks_left > 0 or median_missing")


def resumption(designs: DataFrame, evaluations: DataFrame, checks: DataFrame, medians: DataFrame, wanted: int) -> DataFrame:
    """One row: designs, what was done of them before (evaluations, checks, medians), pending designs, and the calls they need."""
    of = lambda df: df.join(designs.select("design_id"), "design_id", "left_semi").agg(F.count("*").alias("n"))
    queue = scoring_queue(designs, evaluations, checks, medians, wanted).agg(F.count("*").alias("pending"), F.coalesce(F.sum(F.col("evals_left") + F.col("checks_left")), F.lit(0)).alias("calls_left"))
    out = designs.agg(F.count("*").alias("designs"))
    for name, df in (("evals_done", evaluations), ("checks_done", checks), ("medians_done", medians.select("design_id").distinct())):
        out = out.crossJoin(of(df).withColumnRenamed("n", name))  # one row each
    return out.crossJoin(queue)
