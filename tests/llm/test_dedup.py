"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.helpers import assert_same, oracle_rows
from tests.llm.conftest import BASE, TEXTS
from trialforge.llm import exact_dedup, near_dedup, queries
from trialforge.llm._common import pieces_of
from trialforge.llm.exact_dedup import CountingQuotientFilter


def brute_exact(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    size = Counter(t for _, t in norm)
    first = {t: min([i for i, x in norm if x == t and i is not None], default=None) for t in size}
    return sorted(((i is None, i or 0, first[t] if size[t] > 1 else i, size[t], i == first[t] if size[t] > 1 else True, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=str)


def test_exact_edges(edge, none):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.annotate(edge).collect()), key=str)
    assert got == brute_exact(TEXTS)
    assert exact_dedup.annotate(none).count() == 0 and exact_dedup.distinct_rows(none).count() == 0


def test_distinct_rows(edge):
    rows = exact_dedup.distinct_rows(edge).collect()
    texts = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in rows)
    assert max(texts.values()) == 1 and set(texts) == {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in TEXTS}
    assert rows[0].__fields__ == edge.columns


def test_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    pool[:50] = (pool[50:100] & np.uint64(0xFFFFFFFF00000000)) | np.uint64(7)  # runs of one quotient
    parts = [rng.choice(pool, 4000) for _ in range(5)] + [np.zeros(0, np.uint64), np.array([0, 2**64 - 1, 0], np.uint64)]
    filters = [CountingQuotientFilter.from_bytes(CountingQuotientFilter.build(*np.unique(p, return_counts=True)).to_bytes()) for p in parts]
    keys, counts = exact_dedup.merged(filters).entries()
    want, n = np.unique(np.concatenate(parts), return_counts=True)
    assert np.array_equal(keys, want) and np.array_equal(counts, n)


def test_op5_equals_sql(spark, sf):
    assert_same(queries.op5_exact_dedup(spark, sf).toPandas(), oracle_rows(queries.ORACLE_SQL["op5_exact_dedup"], sf))


def brute_near(rows, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[a + 1 :]:
            if s and u and i is not None and j is not None and 100 * len(s & u) >= percent * len(s | u):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {(i, len(s), None if i is None else top(i)) for i, s in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_edges(edge, none, percent):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(edge, percent).collect()}
    assert got == brute_near(TEXTS, percent)
    assert near_dedup.near_duplicates(none, percent).count() == 0 and near_dedup.distinct_rows(none).count() == 0


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(words)), n):
        out[k] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("least,part", [(128, 200_000), (7, 200_000), (7, 12)])
def test_near_groups(spark, monkeypatch, least, part):
    """Dense groups around and beyond the threshold, with members that only other members link; in one task, as a grid, and with buckets in parts."""
    monkeypatch.setattr(near_dedup, "MEET_LEAST", least)
    monkeypatch.setattr(near_dedup, "PAIR_LEAST", 4 * least)
    monkeypatch.setattr(near_dedup, "MEET_MOST", max(least, 9))
    monkeypatch.setattr(near_dedup, "BUCKET_PART", part)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(k, edited(rng, words, rng.choice([0, 1, 2, 3, 5, 6, 8]))) for k in range(60)]
    far = edited(rng, words, 7).split()
    rows += [(100 + k, edited(rng, far, 1)) for k in range(15)]
    rows += [(200 + k, edited(rng, [f"x{rng.randrange(10**9)}" for _ in range(80)], 1)) for k in range(20)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for percent in (85, 93):
        got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, percent).collect()}
        assert got == brute_near(rows, percent)


def in_stars(sigs, sizes):
    nodes = np.random.default_rng(1).permutation(len(sigs)).astype(np.int64)
    out = near_dedup.star_pairs(nodes, sizes, sigs, 0.8)
    assert sorted(x[0] for x in out) == list(range(len(sigs))) and {c for _, c, first in out if first} == {next(c for _, c, first in out if first)}
    at = {int(v): i for i, v in enumerate(nodes)}
    centre = np.array([at[c] for _, c, _ in sorted(out, key=lambda x: at[x[0]])])
    assert (centre[centre] == centre).all()  # a centre is its own
    for c in np.unique(centre):
        own = np.flatnonzero(centre == c)
        assert near_dedup.close(sigs[c], sizes[c], sigs[own], sizes[own], 0.8)[own != c].all()
    return centre


@pytest.mark.parametrize("alike", [1, 2, 40])
def test_stars_of_unlike_members_take_seconds(alike):
    """20,000 members of a bucket in families of a given size: a few rounds for each part, not one for each member."""
    rng = np.random.default_rng(alike)
    sigs = np.repeat(rng.integers(0, 256, (20_000 // alike, near_dedup.PACKED), dtype=np.uint8), alike, axis=0)
    sigs[np.arange(len(sigs)), rng.integers(0, near_dedup.PACKED, len(sigs))] ^= 1
    sigs = sigs[rng.permutation(len(sigs))]
    began = time.perf_counter()
    centre = in_stars(sigs, np.full(len(sigs), 100))
    assert time.perf_counter() - began < 60
    assert len(np.unique(centre)) <= len(sigs) if alike == 1 else len(np.unique(centre)) < 4 * len(sigs) / alike + 100


def test_stars_of_small_buckets():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (3, near_dedup.PACKED), dtype=np.uint8)
    for n in (1, 2, 3, 7, 60):
        sigs = base[rng.integers(0, 3, n)].copy()
        in_stars(sigs, rng.integers(5, 500, n))


def test_near_small(spark, small, sf):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op2_near_dedup(spark, sf).collect()}
    assert got == brute_near(rows, 85)


def test_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:n], rng.integers(0, 2**64, 4000 - n, dtype=np.uint64)])) for n in (4000, 3600, 2000, 0)]
    sigs = near_dedup.packed_bits(near_dedup.signatures(sets))
    for s, got in zip(sets, near_dedup.estimate(sigs[0], sigs), strict=True):
        want = len(np.intersect1d(sets[0], s)) / len(np.union1d(sets[0], s))
        assert abs(got - want) < 0.2
    assert near_dedup.estimate(sigs[0], sigs)[0] == 1


def test_ids_with_several_texts(spark):
    """Each text of a repeated id has its own links, and only near duplicates of a kept text go."""
    rng = random.Random(11)
    one, two, three, four = ([f"{c}{rng.randrange(10**9)}" for _ in range(120)] for c in "abcd")
    rows = [(5, " ".join(one)), (5, " ".join(two)), (1, edited(rng, one, 1)), (2, edited(rng, two, 1)), (5, " ".join(three)), (5, " ".join(three).upper())]
    rows += [(7, " ".join(four)), (7, edited(rng, four, 1)), (7, ""), (7, None), (8, edited(rng, four, 2)), (9, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(df, 80).collect()}
    assert got == {(5, 1), (5, 2), (1, 1), (2, 2), (5, 5), (7, 7), (8, 7), (9, 9)}
    kept = sorted((r["doc_id"], (r["text"] or "").lower()[:1]) for r in near_dedup.distinct_rows(df, 80).collect())
    assert kept == [(1, "a"), (2, "b"), (5, "c"), (7, ""), (7, "d"), (9, "a")]


def test_distinct_near_rows(edge):
    ids = [r["doc_id"] for r in near_dedup.distinct_rows(edge, 80).collect()]
    assert {1, 2, 3, 4, 8, 12} <= set(ids) and not {5, 6, 10, 11, 13} & set(ids) and ids.count(1) == 1
    assert BASE


def test_shingles_of_pieces():
    """Slices of a column give the sets that the whole column gives, and each set is that of its text."""
    texts = [(t or "").encode() for _, t in TEXTS] * 3
    for column in (pa.array(texts, pa.binary()), pa.array(texts, pa.large_binary()).slice(2)):
        whole = near_dedup.shingles_of(column)
        for limit in (1, 50, 700):
            pieces = [s for p in pieces_of(column, limit) for s in near_dedup.shingles_of(p)]
            assert len(pieces) == len(whole) and all(np.array_equal(a, b) for a, b in zip(pieces, whole, strict=True))
        for s, t in zip(whole, column.to_pylist(), strict=True):
            w = t.lower().split()
            assert len(s) == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ())


def test_ids_of_text(spark):
    """Ids that are no numbers: the smallest in their own order stands for its component."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**9)}" for _ in range(100)]
    rows = [(i, edited(rng, words, 1)) for i in ("b", "10", "a", "9")] + [("z", "other text"), (None, " ".join(words)), ("e", "")]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), 80)
    assert out.schema["component_id"].dataType.typeName() == "string"
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out.collect()} == {("b", "10", False), ("10", "10", True), ("a", "10", False), ("9", "10", False), ("z", "z", True), (None, None, True), ("e", "e", True)}
    assert sorted(str(r["doc_id"]) for r in near_dedup.distinct_rows(spark.createDataFrame(rows, "doc_id string, text string"), 80).collect()) == ["10", "None", "e", "z"]
