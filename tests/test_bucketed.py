"""Co-bucketed tables: no exchange in the joins of their views, the same rows as the plain views."""

import pytest

from tests.helpers import assert_same
from trialforge.plans.catalogue import QUERIES
from trialforge.sources import adapter, bucketed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module", params=[400, 1_000_000])
def store(spark, sf, request):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    out = bucketed.built(spark, sf, request.param)
    yield out
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    out.drop()


@pytest.mark.parametrize("view", ["score_view", "cost_view", "coherence_view", "rater_view"])
def test_views_join_without_exchange(store, view):
    text = plan(getattr(store, view)())
    assert "Exchange hashpartitioning" not in text and "Exchange SinglePartition" not in text and "Exchange rangepartitioning" not in text


def test_final_runs_are_pruned(store):
    assert "PartitionFilters: [isnotnull(status" in plan(store.cost_view())


def test_same_rows(store, spark, sf):
    assert_same(store.score_view().toPandas(), adapter.score_view(spark, sf).toPandas())
    assert_same(store.cost_view().toPandas(), adapter.cost_view(spark, sf).toPandas())


def test_medians_need_no_exchange(store):
    from pyspark.sql import functions as F

    text = plan(store.read("evaluations").groupBy("design_id").agg(F.median("overall_score")))
    assert "Exchange" not in text


def test_added_rows_stay_in_their_buckets(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    store = bucketed.BucketedStore(spark, "tf_added", 3)
    try:
        tables = {"runs": adapter.runs(spark, sf), "scores_median": adapter.medians(spark, sf), "evaluations": adapter.evaluations(spark, sf), "coherence_checks": adapter.coherence_checks(spark, sf)}
        for t, df in tables.items():
            key = bucketed.LAYOUT[t][0]
            store.write(t, df.where(f"{key} % 2 = 0"))
            store.add(t, df.where(f"{key} % 2 = 1"))
        assert "Exchange hashpartitioning" not in plan(store.score_view())
        assert_same(store.score_view().toPandas(), adapter.score_view(spark, sf).toPandas())
    finally:
        store.drop()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not store.exists()


def test_built_once(spark, sf):
    first = bucketed.built(spark, sf)
    files = first.read("runs").inputFiles()
    assert bucketed.built(spark, sf).read("runs").inputFiles() == files
    assert QUERIES["bucketed_scores"](spark, sf).count() == adapter.score_view(spark, sf).count()


def test_only_what_is_read_is_written(spark, sf):
    store = bucketed.built(spark, sf, 777)
    try:
        assert_same(store.score_view().toPandas(), adapter.score_view(spark, sf).toPandas())
        there = {t for t in bucketed.LAYOUT if spark.catalog.tableExists(store.name(t))}
        assert there == {"runs", "scores_median"} and not store.exists()
        assert_same(store.read("scores_median").toPandas(), adapter.medians(spark, sf).toPandas())
    finally:
        store.drop()
