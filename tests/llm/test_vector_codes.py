"""Codebooks and codes against a plain version with Python integers."""

import hashlib
import math

import numpy as np
import pytest

from tests.helpers import assert_same, oracle_rows
from trialforge.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds, scale=256):
    """rows: (id, vector, label), ids distinct."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [(i, [v[p * width : p * width + width] for p in range(parts)], label) for i, v, label in kept]
    first = sorted(cut, key=lambda r: r[0])[:entries]
    books = [[r[1][p] for r in first] for p in range(parts)]

    def assign(p, x):
        distances = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return distances.index(min(distances)), min(distances)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in cut:
                members.setdefault(assign(p, v[p])[0], []).append(v[p])
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])]
    told = []
    for i, v, label in cut:
        codes = [assign(p, v[p]) for p in range(parts)]
        told.append((i, "".join(f"{c:02x}" for c, _ in codes), sum(d for _, d in codes), label))
    sums = {}
    for _, _, e, label in told:
        sums[label] = sums.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, sums[label]) for i, c, e, label in told), sha


def run(df, **more):
    told, books = vector_codes.compressed(df, **more)
    return sorted((tuple(r) for r in told.select("id", "code", "error", "label_error").collect()), key=str), vector_codes.digest(books)


@pytest.mark.parametrize("width", [1, 2, 5, 16])
def test_search_equals_all_distances(width):
    rng = np.random.default_rng(width)
    book = rng.integers(-6, 6, (64, width))
    book[10:20] = book[:10]  # ties: the lower index wins
    x = rng.integers(-6, 6, (500, width))
    code, distance = vector_codes.nearest(x, book)
    full = ((x[:, None] - book) ** 2).sum(axis=2)
    assert np.array_equal(code, full.argmin(axis=1)) and np.array_equal(distance, full.min(axis=1))
    large = x * (1 << 24)
    assert np.array_equal(vector_codes.nearest(large, book * (1 << 24))[0], code)
    assert len(vector_codes.nearest(x[:0], book)[0]) == 0


def test_equals_plain_version(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 12)], None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(300)]
    rows += [(1000, None, 1), (1001, [None] + [0.5] * 11, 1), (1002, [float("nan")] * 12, 1), (1003, [float("-inf")] + [0.0] * 11, 1)]
    rows += [(2000 + i, rows[i][1], rows[i][2]) for i in range(10)]  # equal vectors
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got, sha = run(df, parts=4, entries=16, rounds=2)
    want, want_sha = brute(rows, 4, 16, 2)
    assert got == sorted(want, key=str) and sha == want_sha


def test_edges(spark):
    v = [0.1, -0.2, 0.3, 0.4]
    df = spark.createDataFrame([(None, v, 1), (1, v, None), (1, v, None), (2, [0.0] * 4, None), (3, [1.0] * 2, 2), (4, [], 2), (5, [3e38] * 4, 2)], SCHEMA)
    df = df.selectExpr("*", "1 as id", "'x' as code", "2 as x", "3 as error", "4 as n")
    told, books = vector_codes.compressed(df, parts=2, entries=8)
    rows = told.collect()
    assert sorted((str(r["id"]), r["code"]) for r in rows) == [("1", "0000"), ("1", "0000"), ("2", "0101"), ("None", "0000")]
    assert books.shape == (2, 2, 2) and {r["label_error"] for r in rows} == {0}
    told, books = vector_codes.compressed(df.limit(0))
    assert told.count() == 0 and vector_codes.digest(books) == hashlib.sha256(b"").hexdigest()
    told, _ = vector_codes.compressed(df.where("size(embedding) = 0"))
    assert [(r["code"], r["error"]) for r in told.collect()] == [("00" * 16, 0)]
    told, books = vector_codes.compressed(df.where("id = 1 and vec_id is null"), parts=2)
    assert told.first()["code"] == "0000" and books.shape == (2, 1, 2)
    with pytest.raises(ValueError):
        vector_codes.compressed(df, parts=3)
    with pytest.raises(ValueError):
        vector_codes.compressed(df, entries=257)


def test_op13_equals_sql(spark, sf):
    assert_same(queries.op13_vector_codes(spark, sf).toPandas(), oracle_rows(queries.ORACLE_SQL["op13_vector_codes"], sf))
