"""Stores, configuration and sinks."""

from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from trialforge.sources import config, schemas, sinks
from trialforge.sources.store import Store, found_runs, without_results


def runs(spark, *rows):
    return schemas.conform(spark.createDataFrame(list(rows), "run_id string, variant_id string, task_id string, repetition int, status string"), "runs")


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.version() is None
    store.initialise()
    assert store.version() == schemas.VERSION
    store.upsert("runs", runs(spark, ("a", "v1", "t1", 0, "running"), ("b", "v1", "t1", 1, "completed")))
    store.upsert("runs", runs(spark, ("a", "v1", "t1", 0, "completed")))
    assert {(r["run_id"], r["status"]) for r in store.read("runs").collect()} == {("a", "completed"), ("b", "completed")}
    store.upsert("designs", schemas.conform(spark.createDataFrame([("d1", "a"), ("d2", "b")], "design_id string, run_id string"), "designs"))
    store.upsert("evaluations", schemas.conform(spark.createDataFrame([("e1", "d1"), ("e2", "d2")], "evaluation_id string, design_id string"), "evaluations"))
    assert {r["table_name"]: r["rows"] for r in store.counts().collect()}["evaluations"] == 2
    out = f"file://{tmp_path}/export"
    assert store.export(out) == ["runs", "designs", "evaluations", "schema_version"]
    other = Store(spark, f"file://{tmp_path}/other")
    other.write("runs", runs(spark, ("a", "v9", "t1", 0, "failed")))
    assert other.load(out)["runs"] == (1, 1)
    assert other.read("runs").where("run_id = 'a'").first()["variant_id"] == "v9"
    assert other.load(out, ["runs"], clear=True)["runs"] == (2, 0)
    store.delete_runs(spark.createDataFrame([("a",)], "run_id string"))
    assert [r["evaluation_id"] for r in store.read("evaluations").collect()] == ["e2"]


def test_violations(spark):
    df = runs(spark, ("a", "v1", "t1", 0, "x"), ("b", "v1", "t1", 0, "x"))
    assert schemas.key_violations(df, "runs").count() == 0
    assert schemas.key_violations(df, "runs", ["variant_id", "task_id", "repetition"]).count() == 1
    child = spark.createDataFrame([("d", "zzz"), ("e", None)], "design_id string, run_id string")
    assert [r["design_id"] for r in schemas.orphans(child, "run_id", df, "run_id").collect()] == ["d"]


def test_interpolation():
    env = {"A": "1", "EMPTY": ""}
    assert config.interpolated({"x": ["${A}", "${B:-two}", "${C}", 3, "${A:-9}-${B:-}", "${EMPTY:-d}|${EMPTY}"]}, env) == {"x": ["1", "two", "${C}", 3, "1-", "|"]}


def test_variants_of_files(tmp_path):
    """Files with a wrapper extend others by name, one level; agents named one by one become lists; empty variables count as set."""
    files = {
        "a.yaml": "variant:\n  id: a\n  extends: none_of_this_counts.yaml\n  flow: {rounds: 2, mode: x}\n  agents:\n    lead: {model: m1}\n    reviewers: {model: m2, n: 2}\n",
        "b.yaml": "variant:\n  extends: a.yaml\n  id: b\n  flow: {rounds: 3}\n  agents:\n    reviewers: {model: '${M:-m3}'}\n",
        "c.yaml": "variant:\n  id: c\n  extends: b.yaml\n",
        "d.yaml": "id: d\nagents:\n  participant_2: {model: y}\n  participant_1: {model: x, id: own}\n  debater_1: {model: z}\n  debaters: [{id: q}]\n",
        "none_of_this_counts.yaml": "{}",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    trees = config.load_variants(str(tmp_path), {"M": ""})
    assert trees["b"] == {"id": "b", "flow": {"rounds": 3, "mode": "x"}, "agents": {"lead": {"model": "m1"}, "reviewers": {"model": "", "n": 2}}}
    assert trees["c"] == {"id": "c", "flow": {"rounds": 3}, "agents": {"reviewers": {"model": ""}}}  # what b extends does not count
    assert trees["d"]["agents"] == {"participants": [{"id": "own", "model": "x"}, {"id": "participant_2", "model": "y"}], "debater_1": {"model": "z"}, "debaters": [{"id": "q"}]}
    (tmp_path / "e.yaml").write_text("variant: {id: e, extends: missing.yaml}")
    with pytest.raises(FileNotFoundError):
        config.load_variants(str(tmp_path))


def test_inheritance_and_agents(spark):
    trees = {"base": {"flow": {"a": 1, "b": 2}}, "child": {"extends": "base", "flow": {"b": 3}}}
    assert config.inherited(trees)["child"] == {"flow": {"a": 1, "b": 3}}
    assert config.named_agents({"lead": {"model": "m"}}) == [{"id": "lead", "model": "m"}]
    assert config.named_agents({"debaters": [{"id": "x"}, {"model": "m"}]}) == [{"id": "x"}, {"id": "debaters_1", "model": "m"}]
    assert config.named_agents([{"model": "m"}]) == [{"id": "agent_0", "model": "m"}]
    rows = config.dimension(spark, {"t1": {"complexity": "simple", "m": {"p": 2}}, "t2": {}}, {"complexity": "complexity", "p": "m.p"}).collect()
    assert [tuple(r) for r in rows] == [("t1", "simple", "2"), ("t2", None, None)]


def test_results_to_make_again(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "design_id string")
    tables = {"evaluations": ids("a", "a", "b", None), "scores_median": ids("a", "b"), "coherence_checks": ids("a")}
    left = without_results(tables, ids("a"))
    assert {k: sorted(str(r["design_id"]) for r in df.collect()) for k, df in left.items()} == {"evaluations": ["None", "b"], "scores_median": ["b"], "coherence_checks": ["a"]}
    assert without_results(tables, ids("a"), ("coherence_checks",))["coherence_checks"].count() == 0


def test_runs_of_files(spark, tmp_path):
    for name, text in (("x", '{"run_id": "r1"}'), ("y", "{}"), ("z", "no json")):
        (tmp_path / f"{name}.json").write_text(text)
    got = {r["file"].rsplit("/", 1)[1]: r["run_id"] for r in found_runs(spark, f"file://{tmp_path}/*.json").collect()}
    assert got == {"x.json": "r1", "y.json": "unknown", "z.json": "unknown"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456), ("b", None)], "name string, value double")
    assert "| a | 1.235 |" in sinks.markdown(df, "T")
    sinks.write_csv(df, f"file://{tmp_path}/c", 2)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").where("name = 'a'").first()["value"] == "1.23"
    events = spark.createDataFrame([("s", "X", 1, 2, 3, 4)], "name string, ph string, ts long, dur long, pid long, tid long")
    sinks.write_chrome(events, f"file://{tmp_path}/t")
    assert spark.read.json(f"file://{tmp_path}/t").select(F.sum("dur")).first()[0] == 2
    assert '"traceEvents"' in sinks.chrome_document(events)


def test_pages(spark):
    """Charts are well-formed, hold every row that can be drawn, and escape names."""
    df = spark.createDataFrame([("a<b", 1.0, 2.0, True), ("c", 3.0, 1.0, False), ("d", 2.0, 4.0, True), ("e", None, 1.0, False)], "name string, x double, y double, best boolean")
    text = sinks.scatter_page(df, "x", "y", "name", "T & U", "best")
    root = ElementTree.fromstring(text[text.index("<svg") :])
    tags = [e.tag.rsplit("}", 1)[1] for e in root.iter()]
    assert tags.count("circle") == 3 and tags.count("polyline") == 1 and "a&lt;b" in text and "T &amp; U" in text
    grid = spark.createDataFrame([("v1", 1.0, None), ("v2", 2.0, 3.0)], "variant_id string, t1 double, t2 double")
    root = ElementTree.fromstring(sinks.heatmap_page(grid, "variant_id", "H").split("</title>")[1])
    assert sum(e.tag.endswith("rect") for e in root.iter()) == 3
    boxes = spark.createDataFrame([("v1", 1.0, 2.0, 2.5, 3.0, 4.0), ("v2", 1.0, 1.0, 1.0, 1.0, None)], "variant_id string, low double, q25 double, median double, q75 double, high double")
    root = ElementTree.fromstring(sinks.boxplot_page(boxes, "variant_id", "B").split("</title>")[1])
    assert sum(e.tag.endswith("rect") for e in root.iter()) == 1
    for page in (sinks.scatter_page(df.limit(0), "x", "y", "name", "T"), sinks.heatmap_page(grid.limit(0), "variant_id", "H"), sinks.boxplot_page(boxes.limit(0), "variant_id", "B")):
        ElementTree.fromstring(page.split("</title>")[1])


def test_console_table(spark):
    df = spark.createDataFrame([("a", 1.5, 10), ("long name", None, 2)], "name string, value double, n long")
    assert sinks.console_table(df, "T") == "T\nname      | value |  n\n----------+-------+---\na         | 1.500 | 10\nlong name |       |  2\n"
