"""Near duplicates by b-bit MinHash.

A text's set is its distinct five-word shingles. Texts with one set are one node. Of each node's K minima the low B bits
are kept and packed; bands of ROWS minima make bucket keys. Nodes that share a bucket are candidates: equal bits of
two packed signatures, corrected for the 2**-B of chance collisions, estimate their similarity, and pairs whose estimate
is SLACK standard errors below the threshold are no links. What remains is confirmed on the full sets.

A bucket is not expanded into pairs. Its members are first compared with centres: the member closest to the bucket's
majority signature, then the one closest to that of the members left, and so on; a centre and what it takes is a star.
Once the confirmed links' components are known, only pairs of different components are left to test. Within a star,
each member is reduced to its symmetric difference with the centre; two members' symmetric difference follows from the
sizes of theirs and what these share, so members outside the centre's component find all their links by an inverted
index over small differences, in a grid of blocks of members, and only links come out. (Members that share no difference cannot
be linked if one of them is not linked with the centre.) Between stars of a bucket, members outside the first centre's
component look for partners by their signatures. So no link between components is lost, and a dense group costs about
one test for each member. (A pair with similarity s shares a bucket with probability 1 - (1 - s**ROWS)**BANDS: all but
5e-8 of the pairs at 0.8, and 6e-11 at 0.85.)

Components: large-star and small-star steps on links, until nothing changes.

Edge cases: ids may be of any type that has an order. Null and empty texts have an empty set and are linked with nothing; texts under five words have one shingle,
their whole sequence. Repeated rows are in one component and share their verdict. An id with several texts has a node
and a verdict for each of their sets. Rows with a null id are answered but link nothing. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.llm._common import as_text, mix64, pieces_of, raw_text, released, stored, unheld, words_in

WORDS, K, B, ROWS = 5, 128, 2, 4
BANDS = K // ROWS
SLACK = 6.0
AT_ONCE, MEET_LEAST, MEET_MOST, STAR_CHUNK, MEETINGS = 4_000_000, 128, 20_000, 20_000, 4_000_000
#: Members of a bucket that one task takes (44 bytes each), and the least rows of a side where only signatures meet.
BUCKET_PART, PAIR_LEAST = 200_000, 512
PACKED = K * B // 8
_CELLS = mix64(np.arange(1, 2 * K + 1, dtype=np.uint64))
MULTIPLY = (_CELLS[:K] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
FLIP = (_CELLS[K:] >> np.uint64(32)).astype(np.uint32)
BIT_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def shingles_of(raw: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (bytes)."""
    index, starts, words = words_in(pc.ascii_lower(as_text(raw)))
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))
    h = known[index]

    def rolled(h: np.ndarray, width: int) -> np.ndarray:
        total = np.zeros(max(0, len(h) - width + 1) if width else 0, np.uint64)
        for k in range(width):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(total)]
        return mix64(total + np.uint64(width))

    every, out = rolled(h, WORDS), []
    for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
        out.append(np.unique(every[a : b - WORDS + 1] if b - a >= WORDS else rolled(h[a:b], b - a)))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """K minima (32 bits each) of each non-empty set."""
    out = np.empty((len(sets), K), np.uint32)
    a = 0
    while a < len(sets):
        b, size = a, 0
        while b < len(sets) and (b == a or size + len(sets[b]) <= 65_536):
            size += len(sets[b])
            b += 1
        flat = (np.concatenate(sets[a:b]) >> np.uint64(32)).astype(np.uint32)
        lengths = np.array([len(x) for x in sets[a:b]])
        starts = np.cumsum(lengths) - lengths
        for k in range(K):
            out[a:b, k] = np.minimum.reduceat((flat ^ FLIP[k]) * MULTIPLY[k], starts)
        a = b
    return out


def packed_bits(minima: np.ndarray) -> np.ndarray:
    low = (mix64(minima.astype(np.uint64)) & np.uint64(2**B - 1)).astype(np.uint8)
    bits = np.stack([(low >> i) & 1 for i in range(B)], axis=2)
    # Bits of one weight lie together, so that equality of values is a bitwise "and" of equalities.
    return np.packbits(bits.transpose(0, 2, 1).reshape(len(low), -1), axis=1)


def band_keys(minima: np.ndarray) -> np.ndarray:
    rows = minima.astype(np.uint64).reshape(len(minima), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key.view(np.int64)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity by counts of equal b-bit values, less the share that is equal by chance."""
    differ = np.bitwise_or.reduce((many ^ one).reshape(len(many), B, K // 8), axis=1)
    equal = K - BIT_COUNT[differ].sum(1, dtype=np.int64)
    return (equal / K - 2.0**-B) / (1 - 2.0**-B)


def floor_of(threshold: float) -> float:
    p = threshold + (1 - threshold) * 2.0**-B
    return threshold - SLACK * (p * (1 - p) / K) ** 0.5 / (1 - 2.0**-B)


def profiles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_key, sig, bands of every row; the last three are null for an empty set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unheld()
        for x in batches:
            done = 0
            for raw in pieces_of(x.column("raw"), AT_ONCE):
                own, done = x.column("id").slice(done, len(raw)), done + len(raw)
                sets = shingles_of(raw)
                sizes = np.array([len(s) for s in sets])
                full = [s for s in sets if len(s)]
                minima = signatures(full)
                # One row for each text with a set, and null for the others.
                place = pa.array(np.cumsum(sizes > 0) - 1, mask=sizes == 0)
                flat = lambda rows: pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))])
                sig = flat(packed_bits(minima)).cast(pa.binary())
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(full) + 1, BANDS, dtype=np.int32)), pa.array(band_keys(minima).ravel()))
                keys = pa.array([xxhash.xxh3_128_digest(s) for s in full], pa.binary())
                yield pa.RecordBatch.from_arrays([own, pa.array(sizes.astype(np.int64)), keys.take(place), sig.take(place), bands.take(place)], ["id", "n_shingles", "set_key", "sig", "bands"])
        released()

    rows = docs.select(F.col(id_col).alias("id"), raw_text(F.col(text_col)).alias("raw"))
    return rows.mapInArrow(run, f"id {kind}, n_shingles long, set_key binary, sig binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, set (sorted hashes as bytes) of the nodes in wanted (node, id, set_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            done = 0
            for raw in pieces_of(x.column("raw"), AT_ONCE):
                own, done = x.column("id").slice(done, len(raw)), done + len(raw)
                sets = [s.tobytes() for s in shingles_of(raw)]
                yield pa.RecordBatch.from_arrays([own, pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["id", "set_key", "set"])
        released()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted.select("id"), "id", "left_semi")
    # A repeated id with another text has another set_key.
    return rows.select("id", raw_text(F.col("text")).alias("raw")).mapInArrow(run, f"id {kind}, set_key binary, set binary").join(wanted, ["id", "set_key"]).select("node", "set").dropDuplicates(["node"])


def grouped(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of each batch, cut so that no key is in two frames. Rows come sorted by key."""
    rest: list[pd.DataFrame] = []  # the rows so far of the last key
    for x in batches:
        if not len(x):
            continue
        keys = x[key].to_numpy()
        if rest and rest[0][key].iloc[0] != keys[0]:
            yield pd.concat(rest, ignore_index=True)
            rest = []
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield pd.concat([*rest, x.iloc[:cut]], ignore_index=True)
            rest = []
        rest.append(x.iloc[cut:])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def spans(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of two or more equal keys."""
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(edge, len(keys)))
    for a, n in zip(edge[size > 1], size[size > 1], strict=True):
        yield int(a), int(a + n)


def majority(sigs: np.ndarray) -> int:
    """The row closest to the bitwise majority of all rows."""
    middle = np.packbits(np.unpackbits(sigs, axis=1).mean(0) >= 0.5)
    return int(np.argmax(estimate(middle, sigs)))


#: Rounds that take no second member before what is left of a bucket is split, and the largest stars that take from it once more.
IDLE_ROUNDS, LARGEST_STARS = 3, 16


def star_pairs(nodes: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, threshold: float) -> list[tuple[int, int, bool]]:
    """(node, centre, is the bucket's first centre) for the members of one bucket, each with the centre that takes it.

    A round takes what is close to the member nearest to the majority. Where IDLE_ROUNDS rounds in a row take one member
    each, or a 64th of what is left at most, that is unlike: it is split by one byte of the signatures after the other, as
    by a further band, and the rounds go on in each part, so that unlike members cost a few rounds and not one each. The largest stars then take what
    other parts have of their kind; who stays alone is a centre. Which centre takes whom only says how pairs are looked
    for later on, not whether.
    """
    centre, todo, first = np.full(len(nodes), -1), [(np.arange(len(nodes)), 0)], None

    def near(c: int, left: np.ndarray) -> np.ndarray:
        out = close(sigs[c], sizes[c], sigs[left], sizes[left], threshold)
        out[left == c] = True
        return out

    while todo:
        left, byte = todo.pop()
        idle = 0
        while len(left) and (idle < IDLE_ROUNDS or byte == sigs.shape[1]):
            if byte == sigs.shape[1]:  # alike in all bytes, but too unlike in size
                c = left[np.argmin(nodes[left])]
            else:
                c = left[majority(sigs[left])] if len(left) > 2 else left[np.argmin(nodes[left])]
            taken = near(c, left)
            first = c if first is None else first
            centre[left[taken]] = c
            idle = idle + 1 if taken.sum() <= max(1, len(left) // 64) else 0
            left = left[~taken]
        if len(left):
            order = np.argsort(sigs[left, byte], kind="stable")
            parts = np.split(left[order], np.flatnonzero(np.diff(sigs[left[order], byte])) + 1)
            alone = [x[0] for x in parts if len(x) == 1]
            centre[alone] = alone
            todo += [(x, byte + 1) for x in parts if len(x) > 1]
    if first is not None:
        stars, count = np.unique(centre, return_counts=True)
        settled = np.isin(np.arange(len(nodes)), stars[count > 1]) | (centre == first)
        for c in stars[np.argsort(-count, kind="stable")][:LARGEST_STARS]:
            # Members of smaller stars, and centres that took no one, come over.
            settled |= centre == c
            free = np.flatnonzero(~settled)
            if count[stars == c] > 1 and len(free):
                centre[free[near(c, free)]] = c
                settled |= centre == c
    return [(int(nodes[k]), int(nodes[c]), bool(c == first)) for k, c in enumerate(centre)]


def close(sig: np.ndarray, size: int, sigs: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which of many may be as similar to one as the threshold says, by estimates and sizes."""
    return (estimate(sig, sigs) >= floor_of(threshold)) & (np.minimum(sizes, size) >= threshold * np.maximum(sizes, size) - 1e-9)


def of_bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, PACKED)


MEMBERS = "key long, node long, n long, sig binary, centre long, first boolean"


def buckets_of(nodes: DataFrame, threshold: float) -> DataFrame:
    """key, node, n, sig, centre, first of the members of every bucket with two members or more.

    A bucket of more than BUCKET_PART members is not one task's: its parts, by hash, each tell the member closest to their
    majority, and the member closest to the majority of these is the bucket's first centre. What it does not take is left
    to the parts, each with centres of its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in grouped(batches, "key"):
            keys, node, n = x["key"].to_numpy(), x["node"].to_numpy(), x["n"].to_numpy()
            out = []
            for a, b in spans(keys):
                sigs = of_bytes(x["sig"].iloc[a:b])
                at = {int(v): i for i, v in enumerate(node[a:b])}
                for own, centre, first in star_pairs(node[a:b], n[a:b], sigs, threshold):
                    k = at[own]
                    out.append((keys[a], own, n[a + k], sigs[k].tobytes(), centre, first))
            if out:
                yield pd.DataFrame(out, columns=["key", "node", "n", "sig", "centre", "first"])
        released()

    rows = nodes.select(F.explode("bands").alias("key"), "node", "n", "sig")
    giant = stored(rows.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > BUCKET_PART).select("key", F.ceil(F.col("members") / BUCKET_PART).alias("parts")), "giant")
    if giant.isEmpty():
        dealt = rows.repartition("key").sortWithinPartitions("key", "node")
        return dealt.mapInPandas(run, MEMBERS)

    def middles(x: pd.DataFrame) -> pd.DataFrame:
        return x.iloc[[majority(of_bytes(x["sig"]))]]

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            near = [bool(close(np.frombuffer(c, np.uint8), m, np.frombuffer(s, np.uint8)[None], np.array([n]), threshold)[0]) for c, m, s, n in zip(x["middle"], x["middle_n"], x["sig"], x["n"], strict=True)]
            yield x[["key", "salt", "node", "n", "sig", "centre"]].assign(near=np.array(near, bool) | (x["node"] == x["centre"]))

    small = rows.join(giant, "key", "left_anti").repartition("key").sortWithinPartitions("key", "node").mapInPandas(run, MEMBERS)
    salted = stored(rows.join(giant, "key").withColumn("salt", F.pmod(F.xxhash64("node"), "parts")).drop("parts"), "salted")
    shape = "key long, node long, n long, sig binary, salt long"
    tops = salted.groupBy("key", "salt").applyInPandas(middles, shape).groupBy("key").applyInPandas(middles, shape)
    tops = stored(tops.select("key", F.col("node").alias("centre"), F.col("n").alias("middle_n"), F.col("sig").alias("middle")), "tops")
    judged = stored(salted.join(tops, "key").mapInPandas(taken, "key long, salt long, node long, n long, sig binary, centre long, near boolean"), "taken")
    left = judged.where("not near").select(F.xxhash64("key", "salt").alias("key"), F.col("key").alias("bucket"), "node", "n", "sig")
    # Parts are buckets of their own here, and go back into their bucket; a member alone in its part is its own centre.
    own = left.select("key", "node", "n", "sig").repartition("key").sortWithinPartitions("key", "node").mapInPandas(run, MEMBERS)
    rest = left.join(own.select("key", "node", "centre"), ["key", "node"], "left").select(F.col("bucket").alias("key"), "node", "n", "sig", F.coalesce("centre", "node").alias("centre"), F.lit(False).alias("first"))
    return small.unionByName(judged.where("near").select("key", "node", "n", "sig", "centre", F.lit(True).alias("first"))).unionByName(rest)


def grid(rows: DataFrame, key: str, least: int) -> DataFrame:
    """rows with role (0: the rows `outside`, 1: all), block and slice: within a key every query meets every row in one
    group. Groups have about as many rows of each role as a 64th of the key's, `least` at least and MEET_MOST at most, so
    that a row is copied 64 times at most up to 64 * MEET_MOST members."""
    sizes = rows.groupBy(key).agg(F.sum(F.col("outside").cast("long")).alias("queries"), F.count("*").alias("members")).where("queries > 0 and members > 1")
    side = F.least(F.lit(MEET_MOST), F.greatest(F.lit(least), F.ceil(F.col("members") / 64)))
    sizes = stored(sizes.select(key, F.ceil(F.col("queries") / side).alias("blocks"), F.ceil(F.col("members") / side).alias("slices")), "sides")
    sized = stored(rows.join(sizes, key), "sized", large_rows=True)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("node"), n)
    queries = sized.where("outside").select(F.lit(0).alias("role"), part("blocks").alias("block"), every("slices").alias("slice"), *rows.columns)
    targets = sized.select(F.lit(1).alias("role"), every("blocks").alias("block"), part("slices").alias("slice"), *rows.columns)
    return queries.union(targets).repartition(key, "block", "slice").sortWithinPartitions(key, "block", "slice", "role", "node")


def meetings(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[dict[str, np.ndarray], dict[str, np.ndarray]]]:
    """Queries and targets (up to STAR_CHUNK at a time) of each group of a grid, by column. Rows come sorted by group and role."""
    at, queries = None, {}
    for x in batches:
        columns = {c: x[c].to_numpy() for c in x.columns}
        group = np.stack([columns[c] for c in (key, "block", "slice")], 1)
        edges = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(1))) if len(x) else np.zeros(0, np.int64)
        split = np.append(0, np.cumsum(columns["role"]))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(x)], strict=True):
            middle = b - int(split[b] - split[a])  # queries stand first
            asks = {c: v[a:middle] for c, v in columns.items()}
            if at is not None and (group[a] == at).all():
                queries = {c: np.concatenate([queries[c], v]) for c, v in asks.items()} if middle > a else queries
            else:
                at, queries = group[a], asks
            if len(queries["role"]):
                for k in range(middle, b, STAR_CHUNK):
                    yield queries, {c: v[k : min(b, k + STAR_CHUNK)] for c, v in columns.items()}


def star_links(stars: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between members of one star in different components, one for each member and component it reaches.

    stars: node, centre. Members outside the centre's component are queries, all members are targets, dealt out as a grid.
    """
    own = stars.join(labels, "node", "left").select("node", "centre", F.coalesce("comp", "node").alias("comp"))
    main = labels.select(F.col("node").alias("centre"), F.col("comp").alias("main"))
    # Stored, so that a large star is a skewed join's and not one task's.
    own = stored(own.join(main, "centre", "left").select("node", "centre", "comp", (F.col("comp") != F.coalesce("main", "centre")).alias("outside")), "members")
    open_ = stored(own.groupBy("centre").agg(F.bool_or("outside").alias("any")).where("any").select("centre"), "open")
    rows = stored(own.join(open_, "centre").join(sets, "node"), "with_sets", large_rows=True)
    rows = rows.join(sets.select(F.col("node").alias("centre"), F.col("set").alias("middle")), "centre")

    def reduce_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            differ = []
            for p, q in zip(x["set"], x["middle"], strict=True):
                both = np.sort(np.concatenate([np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)]))
                twice = np.append(both[1:] == both[:-1], False)
                differ.append(both[~(twice | np.append(False, twice[:-1]))].tobytes())
            yield x[["centre", "outside", "node", "comp"]].assign(n=[len(p) // 8 for p in x["set"]], differ=differ)

    small = rows.select("centre", "outside", "node", "comp", "set", "middle").mapInPandas(reduce_, "centre long, outside boolean, node long, comp long, n long, differ binary")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for queries, targets in meetings(batches, "centre"):
            yield met(queries, targets, percent)

    return grid(stored(small, "differences", large_rows=True), "centre", MEET_LEAST).mapInPandas(meet, "a long, b long").distinct()


def met(queries: dict[str, np.ndarray], targets: dict[str, np.ndarray], percent: int) -> pd.DataFrame:
    """Links of queries with targets in other components, one for each query and component, from differences with a common centre."""
    sizes = [np.fromiter(map(len, x["differ"]), np.int64, len(x["differ"])) // 8 for x in (queries, targets)]
    flat = [np.frombuffer(b"".join(x["differ"]), np.uint64) for x in (queries, targets)]
    owner = [np.repeat(np.arange(len(s)), s) for s in sizes]
    order = np.argsort(flat[0], kind="stable")
    index, whose = flat[0][order], owner[0][order]
    low, high = np.searchsorted(index, flat[1], "left"), np.searchsorted(index, flat[1], "right")
    n, out, begin = high - low, [], 0
    comp, node, size = ([x[c] for x in (queries, targets)] for c in ("comp", "node", "n"))
    last = np.flatnonzero(np.append(owner[1][1:] != owner[1][:-1], True)) + 1 if len(owner[1]) else np.zeros(0, np.int64)
    share = np.cumsum(n)[last - 1] // MEETINGS  # whole targets, about MEETINGS shared elements at a time
    stops = last[np.append(share[1:] != share[:-1], True)] if len(last) else last
    for e in stops:
        m = n[begin:e]
        spot = np.repeat(low[begin:e] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        pair = np.repeat(owner[1][begin:e], m) * len(sizes[0]) + whose[spot]
        pairs, shared = np.unique(pair, return_counts=True)
        t, q = pairs // len(sizes[0]), pairs % len(sizes[0])
        apart = sizes[0][q] + sizes[1][t] - 2 * shared
        total = size[0][q] + size[1][t]
        good = (comp[0][q] != comp[1][t]) & (100 * (total - apart) >= percent * (total + apart))
        a, b, c = node[0][q[good]], node[1][t[good]], comp[1][t[good]]
        out.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "q": a, "c": c}).drop_duplicates(["q", "c"]))
        begin = e
    return pd.concat(out)[["a", "b"]] if out else pd.DataFrame({"a": [], "b": []}).astype("int64")


def cross_pairs(buckets: DataFrame, labels: DataFrame, threshold: float, low: float, high: float) -> DataFrame:
    """a, b: pairs of one bucket with an estimate in [low, high), of different components and different stars, so not with the bucket's first centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        for queries, targets in meetings(batches, "key"):
            sigs = of_bytes(targets["sig"])
            node, n, comp, centre, inside = (targets[c] for c in ("node", "n", "comp", "centre", "outside"))
            for own, size, part, c, sig in zip(queries["node"], queries["n"], queries["comp"], queries["centre"], queries["sig"], strict=True):
                # Of two queries, the one with the larger number asks.
                fits = (comp != part) & (centre != c) & (~inside | (node < own)) & (np.minimum(n, size) >= threshold * np.maximum(n, size) - 1e-9)
                if len(spots := np.flatnonzero(fits)):
                    e = estimate(np.frombuffer(sig, np.uint8), sigs[spots])
                    out += [(min(own, node[m]), max(own, node[m])) for m in spots[(e >= low) & (e < high)]]
            if len(out) > STAR_CHUNK:
                yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")
                out = []
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    rows = buckets.join(labels, "node", "left").select("key", "node", "n", "sig", "centre", F.coalesce("comp", "node").alias("comp"), (F.col("first") & (F.col("node") == F.col("centre"))).alias("first"))
    # The main component of a bucket is its first centre's; without one, the smallest.
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min(F.when(F.col("first"), F.col("comp"))).alias("main")).where("x <> y").select("key", F.coalesce("main", "x").alias("main"))
    dealt = rows.drop("first").join(stored(mixed, "mixed"), "key").withColumn("outside", F.col("comp") != F.col("main")).drop("main")
    return grid(stored(dealt, "mixed_rows"), "key", PAIR_LEAST).mapInPandas(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            good = []
            for p, q in zip(x["p"], x["q"], strict=True):
                u, v = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = np.sort(np.concatenate([u, v]))
                same = int((both[1:] == both[:-1]).sum())
                good.append(100 * same >= percent * (len(u) + len(v) - same))
            yield x.loc[good, ["a", "b"]]
        released()

    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("p")), sets.select(F.col("node").alias("b"), F.col("set").alias("q"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInPandas(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, comp (its component's smallest node) of every node with a link. links: a, b, stored."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    near = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return near.union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def set_keys(raw: pd.Series) -> pd.Series:
    """The set_key of each text, as profiles() has it, and no bytes for an empty set."""
    out = []
    for part in pieces_of(pa.array(raw, pa.large_binary()), AT_ONCE):
        out += [xxhash.xxh3_128_digest(s) if len(s) else b"" for s in shingles_of(part)]
    return pd.Series(out)


def numbered(nodes: DataFrame) -> tuple[DataFrame, bool]:
    """nodes with node, and whether it is a number of its own. node is the id, or, where ids are no integers or sets share one, the place in the order of ids and sets: the smallest node of a component has its smallest id."""
    integral = nodes.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    if integral and nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return nodes.withColumn("node", F.col("id").cast("long")), False
    ordered = nodes.repartitionByRange("id", "set_key").sortWithinPartitions("id", "set_key")
    return stored(ordered.withColumn("node", F.monotonically_increasing_id()), "numbered"), True


def verdicts(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_key, component_id, kept of every row; kept are the rows with the smallest id, and of its sets the smallest, of each component."""
    threshold = percent / 100
    own = stored(profiles(docs, id_col, text_col), "profiles")
    nodes = own.where("set_key is not null and id is not null").groupBy("set_key").agg(F.min(F.struct("id", F.col("n_shingles").alias("n"), "sig", "bands")).alias("x"), F.count("*").alias("rows"))
    nodes, shared = numbered(stored(nodes.select("set_key", "x.id", "x.n", "x.sig", "x.bands", "rows"), "nodes"))
    buckets = stored(buckets_of(nodes, threshold), "buckets")
    wanted = stored(buckets.select("node").distinct().join(nodes.select("node", "id", "set_key"), "node"), "wanted")
    sets = stored(shingle_sets(docs, wanted, id_col, text_col), "sets")
    stars = stored(buckets.select("node", "centre").distinct(), "stars")
    links = [stored(confirmed(stars.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")), sets, percent), "links", large_rows=True)]
    labels = stored(components(links[0]), "labels")
    floor = floor_of(threshold)
    step = (threshold - floor) / 3
    rounds = [
        lambda: star_links(stars, labels, sets, percent),
        lambda: confirmed(stored(cross_pairs(buckets, labels, threshold, threshold - step, 2.0), "pairs"), sets, percent),
        lambda: confirmed(stored(cross_pairs(buckets, labels, threshold, floor, threshold - step), "pairs"), sets, percent),
    ]
    for find in rounds:
        found = stored(find(), "links", large_rows=True)
        if not found.isEmpty():
            links.append(found)
            labels = stored(components(reduce(DataFrame.union, links)), "labels")
    special = nodes.join(labels, "node", "left").where("rows > 1 or comp is not null").select("set_key", "node", F.coalesce("comp", "node").alias("comp"))
    if shared:
        special = special.join(nodes.select(F.col("node").alias("comp"), F.col("id").alias("least")), "comp")
    else:
        special = special.withColumn("least", F.col("comp").cast(docs.schema[id_col].dataType))
    special = special.select("set_key", "least", (F.col("node") == F.col("comp")).alias("first"))
    joined = own.select("id", "n_shingles", "set_key").join(stored(special, "special"), "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    first = F.col("id").isNull() | F.coalesce("first", F.lit(True))
    return joined.select("id", "n_shingles", "set_key", component.alias("component_id"), first.alias("first")).select("id", "n_shingles", "set_key", "component_id", (F.col("id").eqNullSafe(F.col("component_id")) & F.col("first")).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept of every row; links are pairs with 100 * intersection >= percent * union."""
    return verdicts(docs, percent, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def distinct_rows(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are kept of each component; one of the rows that share an id and a set."""
    told = stored(verdicts(docs, percent, id_col, text_col), "verdicts")
    again = stored(told.groupBy("id").agg(F.count("*").alias("n")).where("id is not null and n > 1").select(F.col("id").alias(id_col)), "again")
    gone = stored(told.where("not kept").select(F.col("id").alias(id_col)).distinct(), "gone")
    left = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    if again.isEmpty():
        return left
    key = F.pandas_udf(set_keys, "binary")(raw_text(F.col(text_col)))
    rows = docs.join(again, id_col, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), key.alias("set_key"))
    kept = told.where("kept").select("id", F.coalesce("set_key", F.lit(b"")).alias("set_key"))
    some = rows.join(kept, ["id", "set_key"], "left_semi").dropDuplicates(["id", "set_key"]).select("row.*")
    return left.join(again, id_col, "left_anti").select(*docs.columns).unionByName(some)
