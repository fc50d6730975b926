"""Fingerprints and their links against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.conftest import TEXTS
from trialforge.llm import queries, simhash

ALL = (1 << 64) - 1


def brute_fingerprint(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, limit=4):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    values = sorted({f for _, f in prints})
    up = {f: f for f in values}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= limit:
                up[root(a)] = root(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return sorted(((i, f"{f:016x}", least.get(root(f))) for i, f in prints), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_fingerprints():
    texts = [t for _, t in TEXTS] + ["a b c d", " a  b\tc\nd ", "A B C D E", "x" * 50, "one two three four five six seven eight nine " * 30]
    raw = pa.array([(t or "").encode() for t in texts], pa.binary())
    assert simhash.fingerprints_of(raw).tolist() == [brute_fingerprint(t) for t in texts]
    assert simhash.fingerprints_of(raw.slice(3, 4)).tolist() == [brute_fingerprint(t) for t in texts[3:7]]
    assert simhash.fingerprints_of(raw.slice(0, 0)).tolist() == []


def test_shingles_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    texts = ["one two three four five six seven eight nine " * 5, "", "a b", "red green blue white black grey"] * 3
    assert simhash.fingerprints_of(pa.array([t.encode() for t in texts])).tolist() == [brute_fingerprint(t) for t in texts]


def test_edges(edge, none):
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    assert got(simhash.similar(edge)) == brute(rows)
    assert simhash.similar(none).count() == 0


def families(rng, n, centres, most):
    points = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(n // centres):
            x = centre
            for b in rng.sample(range(64), rng.randrange(most + 1)):
                x ^= 1 << b
            points.add(x)
    return sorted(points | {0, ALL, 1, 3, 7, 15, 31})


def components_of(points, limit):
    up = np.arange(len(points))
    for i, x in enumerate(points):
        for j in np.flatnonzero(np.bitwise_count(np.array(points[:i], np.uint64) ^ np.uint64(x)) <= limit):
            simhash.union(up, np.array([i]), np.array([j]))
    return up.tolist()


# Trees over all bits, halves, thirds and quarters: shards are visited; over five and six blocks: none need be.
@pytest.mark.parametrize("blocks", [1, 2, 3, 4, 5, 6])
def test_shards_find_all_links(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "SHARD", 20)
    monkeypatch.setattr(simhash, "SAMPLE", 150)
    monkeypatch.setattr(simhash, "FEW", 16)
    monkeypatch.setattr(simhash, "GROUP", 8)
    points = families(random.Random(blocks), 400, 25, 9)
    prints = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in points], "fp long").repartition(3).cache()
    links = [(np.int64(r["a"]).view(np.uint64), np.int64(r["b"]).view(np.uint64)) for r in simhash.links_of(prints, 4, blocks).collect()]
    label, place = np.arange(len(points)), {x: i for i, x in enumerate(points)}
    for a, b in links:
        simhash.union(label, np.array([place[int(a)]]), np.array([place[int(b)]]))
    assert label.tolist() == components_of(points, 4)


@pytest.mark.parametrize("reach", [0, 1, 2, 4])
def test_balls_reach_their_shards(reach):
    rng = np.random.default_rng(reach)
    points = rng.integers(0, 2**64, 600, dtype=np.uint64)
    near = points[:300].copy()
    mask = (1 << 64) - 1 if reach == 4 else (1 << 24) - 1
    for _ in range(reach):
        near ^= np.uint64(1) << rng.integers(0, 64 if reach == 4 else 24, 300).astype(np.uint64)
    tree = simhash.Tree(points, mask, 40)
    both = np.concatenate([points[:300], near])
    spot, shard, home = tree.dealt(both, reach)
    assert tree.leaves > 10 and sorted(spot[home]) == list(range(600))
    where = [set(shard[spot == i]) for i in range(600)]
    own = {int(i): s for i, s in zip(spot[home], shard[home], strict=True)}
    assert all(own[i] in where[i + 300] or own[i + 300] in where[i] for i in range(300))


def test_compared_in_blocks_equals_all_pairs():
    points = np.array(families(random.Random(2), 300, 5, 6), np.uint64)
    label = np.arange(len(points))
    simhash.compared(points, np.arange(len(points)), 4, label, side=16)
    assert label.tolist() == components_of(points.tolist(), 4)


def test_one_large_family(spark, monkeypatch):
    """A shard with most of the fingerprints is dealt out as a grid."""
    monkeypatch.setattr(simhash, "FEW", 32)
    monkeypatch.setattr(simhash, "SHARD", 64)
    points = sorted({1 << a | 1 << b for a in range(40, 64) for b in range(40, 64)} | {7 << 10, 0xFFFF})
    prints = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in points], "fp long")
    links = simhash.links_of(prints, 4)
    assert links.count() < 5 * 40 * len(points)
    label, place = np.arange(len(points)), {int(np.uint64(x).view(np.int64)): i for i, x in enumerate(points)}
    for r in links.collect():
        simhash.union(label, np.array([place[r["a"]]]), np.array([place[r["b"]]]))
    assert label.tolist() == components_of(points, 4)


def test_op12_equals_brute_force(spark, sf, small):
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    assert got(queries.op12_simhash(spark, sf)) == brute(rows)
