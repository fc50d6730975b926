"""Taken rows and rejects of raters' JSON, against a plain reading of the same texts."""

import json

from trialforge.operators import ingest

TEXTS = [
    None, "", "  ", "nope", "{", "5", '"text"', "true", "null", "[]", "{}", "[null]", "[[1]]", "[true, 3]", '{"a": null}', '{"a": true, "b": [1]}', '{"": 2, " ": 3, "é": 4}',
    '[{"dimension": "a", "score": 3, "justification": "j", "blockers": ["x", "y"]}]', '[{"dimension": "a"}, {"score": 2}, {"dimension": "", "score": 2}, {"dimension": "b", "score": null}, {"dimension": "c", "score": "4"}]',
    '{"a": 1, "b": 2.5, "c": {"score": 3}, "d": {"score": 1e3, "blockers": "no list", "justification": 7}, "e": {}}', '[{"dimension": "a", "score": 1}, {"dimension": "a", "score": 2}]', '[{"dimension": 5, "score": 1}]', '{"a": -0.5, "b": 12345678901}',
]


def number(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def plain(text):
    if text is None or not text.strip():
        return [(None, "missing", None, None)]
    try:
        v = json.loads(text)
    except ValueError:
        return [(None, "malformed", None, None)]
    if not isinstance(v, (list, dict)):
        return [(None, "no list or map", None, None)]
    if not v:
        return [(None, "empty", None, None)]
    out = []
    for i, (key, e) in enumerate([(None, e) for e in v] if isinstance(v, list) else sorted(v.items())):
        bare = isinstance(v, dict) and number(e)
        if not bare and not isinstance(e, dict):
            out.append((i, "no record", None, None))
            continue
        dimension = key if isinstance(v, dict) else e.get("dimension")
        dimension = dimension if dimension is None else str(dimension)
        score = e if bare else e.get("score") if number(e.get("score")) else None
        reason = "no dimension" if dimension is None or not dimension.strip() else "no score" if score is None else None
        out.append((i, reason, dimension, None if score is None else float(score)))
    return out


def test_equals_plain_reading(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(0, None)], "id long, answer string")
    told = ingest.elements(df.selectExpr("*", "1 as value", "2 as pos", "3 as key"), "answer", ["id"])
    want = [(i, p, *rest) for i, t in [*enumerate(TEXTS), (0, None)] for p, *rest in plain(t)]
    good = sorted((r["id"], r["place"], r["dimension"], r["score"]) for r in ingest.taken(told).collect())
    assert good == sorted((i, p, d, s) for i, p, reason, d, s in want if reason is None)
    bad = sorted(((r["id"], r["place"], r["reason"]) for r in ingest.rejects(told).collect()), key=str)
    assert bad == sorted(((i, p, reason) for i, p, reason, *_ in want if reason), key=str)
    account = {r["outcome"]: r["n"] for r in ingest.account(told).collect()}
    assert sum(account.values()) == len(want) == len(good) + len(bad)
    raws = {(r["id"], r["place"]): r["raw"] for r in ingest.rejects(told).collect()}
    assert raws[3, None] == "nope" and json.loads(raws[18, 4]) == {"dimension": "c", "score": "4"}


def test_fields(spark):
    df = spark.createDataFrame([(1, TEXTS[17]), (2, TEXTS[19])], "id long, answer string")
    rows = {(r["id"], r["dimension"]): r for r in ingest.taken(ingest.elements(df, "answer", ["id"])).collect()}
    assert rows[1, "a"]["justification"] == "j" and rows[1, "a"]["blockers"] == ["x", "y"]
    assert rows[2, "d"]["score"] == 1000.0 and rows[2, "d"]["blockers"] == [] and rows[2, "a"]["justification"] is None
    assert ingest.elements(df.limit(0), "answer", ["id"]).count() == 0
