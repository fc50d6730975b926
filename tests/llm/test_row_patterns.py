"""Row patterns against regular expressions with backtracking, tried at every start."""

import hashlib
import random
import re

import numpy as np
import pytest

from tests.helpers import assert_same, oracle_rows
from trialforge.llm import queries, row_patterns
from trialforge.llm.row_patterns import D, NO_NUMBER, READY, U, cents, zigzags

from pyspark.sql import functions as F

#: Capital: the row may be P with this goal; N is neither D nor U.
FORMS = {"optional": "A((?:[dD]+[uU]+)+)([DUN]?)", "greedy": "A((?:[dD]+[uU]+)+)([DUN])", "reluctant": "A((?:[dD]+[uU]+?)+?)([DUN])"}
GAP = 1_800_000_000


def letters_from(rows, i):
    """rows: (at, id, number, move, close) in order. A letter for each row after i, by the goal of row i."""
    out = []
    for k in range(i + 1, len(rows)):
        (at, _, x, move, close), (before, _, y, *_) = rows[k], rows[k - 1]
        near = at - before <= GAP and x is not None
        letter = "d" if near and move and y is not None and x < y else "u" if near and move and y is not None and x > y else "n"
        out.append(letter.upper() if near and close and x >= rows[i][2] else letter)
    return "".join(out)


def brute(clients, ending):
    found = []
    for client, rows in clients.items():
        rows = sorted(set(rows), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0, bool(r[3]), bool(r[4])))
        no = 0
        for i in range(len(rows)):
            if rows[i][2] is None:
                continue
            if m := re.match(FORMS[ending], "A" + letters_from(rows, i)):
                no += 1
                last = i + m.end() - 1
                labels = "A" + m[1].upper() + ("P" if m[2] else "")
                found.append((client, no, rows[i][1], rows[last][1], m.end(), sum(r[2] for r in rows[i : last + 1]), hashlib.sha256(labels.encode()).hexdigest()))
    return sorted(found)


def walks(seed, clients=6, n=120):
    rng = random.Random(seed)
    out = {}
    for c in range(clients):
        at, x, rows = 0, 50, []
        for i in range(rng.choice([0, 1, 2, 3, n, n])):
            at += rng.choice([0, 1, 60_000_000, 60_000_000, GAP, GAP + 1 if rng.random() < 0.1 else 5])
            x = max(0, min(100, x + rng.choice([-30, -7, -1, 0 if rng.random() < 0.3 else 2, 1, 7, 30])))
            rows.append((at, c * 1000 + i, None if rng.random() < 0.02 else x, rng.random() < 0.97, rng.random() < 0.4))
        out[c] = rows
    return out


def frame(spark, clients, parts=3):
    flat = [(c, *r) for c, rows in clients.items() for r in rows]
    flat += flat[::7]  # repeated rows
    random.Random(1).shuffle(flat)
    df = spark.createDataFrame(flat, "key long, at_us long, id long, number long, move boolean, close boolean")
    return df.withColumn("ts", F.timestamp_micros("at_us")).repartition(parts)


def found(df, ending):
    out = zigzags(df, "key", "ts", "id", F.col("number"), F.col("move"), F.col("close"), GAP, ending)
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("ending", row_patterns.ENDINGS)
@pytest.mark.parametrize("seed", range(12))
def test_scan_equals_backtracking(ending, seed):
    for client, rows in walks(seed, 4, 80).items():
        codes, numbers = [], []
        for k, (at, _, x, move, close) in enumerate(rows):
            near = k > 0 and at - rows[k - 1][0] <= GAP and x is not None
            y = rows[k - 1][2] if k else None
            codes.append((D if near and move and y is not None and x < y else U if near and move and y is not None and x > y else 0) + (READY if near and close else 0) + (NO_NUMBER if x is None else 0))
            numbers.append(x or 0)
        first, last, total, shas = row_patterns.matches(np.array(codes, np.uint8), np.array(numbers, np.int64), ending)
        got = [(client, k + 1, rows[a][1], rows[b][1], b - a + 1, t, s.hex()) for k, (a, b, t, s) in enumerate(zip(first.tolist(), last.tolist(), total.tolist(), shas, strict=True))]
        assert got == brute({client: rows}, ending)


@pytest.mark.parametrize("ending", row_patterns.ENDINGS)
@pytest.mark.parametrize("parts", [1, 60])
def test_ranges_are_joined(spark, ending, parts):
    """60 ranges of a dozen rows: most runs and keys cross borders."""
    clients = walks(99)
    clients[50] = [(i * 1000, i, (i % 2) * 10 + i // 7 % 3, True, i % 5 == 0) for i in range(150)]  # one run over a dozen ranges
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert found(frame(spark, clients), ending) == brute(clients, ending)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edges(spark):
    clients = {1: [(0, 1, 10, None, None), (1, 2, 5, True, None), (2, None, 8, True, None), (2, 3, 20, None, True)], 2: [(0, 9, 1, True, True)], 3: [(0, 1, 5, True, True), (0, 1, 4, True, True), (0, 1, 6, True, True), (1, 1, None, True, True)]}
    df = frame(spark, clients)
    more = spark.createDataFrame([(None, 0, 1, 1, True, True, None), (7, None, 1, 1, True, True, None)], df.schema)
    df = df.unionByName(more).withColumn("part", F.lit("x")).withColumn("edge", F.lit(1)).withColumn("chain", F.lit(2))
    assert found(df, "optional") == brute(clients, "optional")
    assert found(df.limit(0), "optional") == []
    assert found(df.where("key = 2"), "greedy") == []
    with pytest.raises(ValueError):
        found(df, "lazy")


def test_keys_of_any_type(spark):
    clients = walks(5, 3, 40)
    df = frame(spark, clients)
    got = zigzags(df.withColumn("key", F.concat(F.lit("é"), F.col("key"))), "key", "ts", "id", F.col("number"), F.col("move"), F.col("close"), GAP)
    assert sorted((int(r[0][1:]), *r[1:]) for r in got.collect()) == brute(clients, "optional")


def test_times_without_a_zone(spark):
    """Gaps are those of the clock on the wall, in a session's zone that skips an hour too."""
    rows = [(1, f"2024-03-31 0{h}:{m:02d}:00", h * 60 + m, x) for h, m, x in ((0, 50, 9), (1, 10, 5), (1, 35, 8), (1, 50, 4), (2, 10, 6), (2, 39, 3), (3, 9, 7), (3, 40, 1), (3, 50, 2))]
    df = spark.createDataFrame(rows, "key long, t string, id long, number long").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    want = brute({1: [(i * 60_000_000, i, x, True, True) for _, _, i, x in rows]}, "optional")
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("Europe/Berlin", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = zigzags(df, "key", "ts", "id", F.col("number"), F.lit(True), F.lit(True), GAP)
            assert sorted(tuple(r) for r in got.collect()) == want and len(want) >= 3
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)


def test_cents(spark):
    values = [1.005, -0.125, None, float("nan"), float("inf"), 1e300, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(cents(F.col("v"))).collect()] == [int(np.floor(100 * 1.005 + 0.5)), -12, None, None, None, None, 0]


def test_op11_equals_sql(spark, sf):
    assert_same(queries.op11_row_patterns(spark, sf).toPandas(), oracle_rows(queries.ORACLE_SQL["op11_row_patterns"], sf))
