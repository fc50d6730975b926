"""SimHash fingerprints of word shingles, and exact links between them by sharded vantage-point trees.

A fingerprint bit is set if it is set in over half the XXH64 hashes of a text's shingles. Equal fingerprints are put
together first. Of any two fingerprints with at most `limit` differing bits, cut into k blocks of bits, some choice of
blocks shows at most limit // k of them (with one block more than `limit`, none). So there is one vantage-point tree for
each choice of blocks, with the Hamming distance on its bits as metric: an inner node sends what lies within the radius
of its vantage point to one side, the rest to the other, and the leaves are the shards. A fingerprint lives in one shard
of each tree, and visits every other shard that its ball overlaps: the triangle inequality rules all others out, and of
two sides only the outer one visits the inner one. Within a shard the tree goes on, by the same bounds, down to groups
that are compared in full, over all bits. Shards with many fingerprints are dealt out as a grid of pairs of chunks.

Trees are fitted on a sample of at most SAMPLE fingerprints (it only decides how even shards are); all fingerprints are
dealt and compared. A shard gives a forest of its links rather than all of them; components are by large and small stars.

Edge cases: null and empty texts, and those without words, have the fingerprint zero, and link like any other; texts
with fewer words than a shingle are one shingle; repeated rows are one component; a null id is never a component's
smallest one, and rows of a component without any id have a null component_id; an empty table gives no rows. Columns
other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.llm._common import as_text, pieces_of, raw_text, released, stored
from trialforge.llm.near_dedup import components

SAMPLE = 20_000
#: Fingerprints that a shard should hold, and a tree's leaves at most (a tree goes to every task).
SHARD, LEAVES = 2_000, 2_500
#: Groups of this size are compared in full.
GROUP = 192
#: A shard is cut into chunks of at least FEW fingerprints; up to 64 chunks while that keeps them below MANY.
FEW, MANY = 2_048, 65_536
#: Bytes of text, and shingles, at once.
AT_ONCE, SHINGLES = 4 << 20, 1 << 19


def bytes_of(strings: pa.Array, first: int, n: int) -> np.ndarray:
    """The bytes of n strings from `first` on, one after the other."""
    _, ends, data = strings.cast(pa.large_binary()).buffers()
    ends = np.frombuffer(ends, np.int64)[strings.offset + first :][: n + 1] if n else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]


def fingerprints_of(raw: pa.Array, words: int = 4, seed: int = 42) -> np.ndarray:
    """Fingerprints (uint64) of a column of UTF-8 texts."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(as_text(raw)))
    listed = split.offsets.to_numpy().astype(np.int64)
    sizes = pc.binary_length(split.values).to_numpy(zero_copy_only=False).astype(np.int64)[listed[0] : listed[-1]]
    listed = listed - listed[0]
    full = sizes > 0  # an empty text, and white space at its ends, split into empty words
    count = np.append(0, np.cumsum(full))[listed]
    ends_at_all = np.cumsum(sizes + 1)
    ends_at = ends_at_all[full]
    begins_at = ends_at - 1 - sizes[full]
    # All words with one space after each; an empty one stands at an end of its text, so no shingle spans it.
    text = np.full(ends_at_all[-1] if len(sizes) else 0, 0x20, np.uint8)
    letter = np.ones(len(text), bool)
    letter[ends_at_all - 1] = False
    text[letter] = bytes_of(split.values, split.offsets[0].as_py(), len(sizes))
    text = text.tobytes()
    n = np.diff(count)
    shingles = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    ends = np.cumsum(shingles)
    owner_first = np.repeat(count[:-1] - (ends - shingles), shingles) + np.arange(ends[-1] if len(ends) else 0)
    last = owner_first + np.repeat(np.minimum(n, words), shingles) - 1
    ones = np.zeros((len(n), 64), np.int64)
    h = xxhash.xxh64_intdigest
    for a in range(0, len(owner_first), SHINGLES):
        b = min(a + SHINGLES, len(owner_first))
        begin, end = begins_at[owner_first[a:b]].tolist(), (ends_at[last[a:b]] - 1).tolist()
        hashes = np.fromiter((h(text[p:q], seed) for p, q in zip(begin, end, strict=True)), np.uint64, b - a)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = np.searchsorted(ends, np.arange(a, b), "right") if len(n) > 1 else np.zeros(b - a, np.int64)
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """id, fp (the fingerprint's bits as a long) of every row, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints_of(x, words, seed) for x in pieces_of(batch.column("raw").cast(pa.large_binary()), AT_ONCE)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])
        released()

    rows = docs.select(F.col(id_col).alias("id"), raw_text(F.col(text_col)).alias("raw"))
    return stored(rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp long"), "fingerprints", large_rows=True, rows=1000)


def masks_of(n: int, limit: int, blocks: int | None = None) -> list[int]:
    """The bits that each tree looks at. blocks: how many the 64 bits are cut into; by default one more than limit, or so many more that shards of n fingerprints stay small."""
    if blocks is None:
        blocks = limit + 1
        while blocks < 12 and n / 2 ** (64 * (blocks - limit) / blocks) > 10 * SHARD:
            blocks += 1
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(x) for x in combinations(block, max(1, blocks - limit))]


def radius_of(limit: int, masks: list[int]) -> int:
    """How many bits of some tree's mask differ at most, between fingerprints that differ in `limit` bits: with disjoint masks fewer than one share of them, else none."""
    return limit // len(masks) if sum(m.bit_count() for m in masks) == 64 else 0


class Tree:
    """A vantage-point tree: inner nodes hold a vantage point and a radius, leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, mask: int, leaves: int):
        self.mask = np.uint64(mask)
        self.nodes: list[tuple[np.uint64, int, int, int]] = []  # vantage point, radius, inner and outer: nodes, or ~leaf
        self.leaves = 0
        self.root = self.grown(sample & self.mask, leaves)

    def grown(self, sample: np.ndarray, leaves: int) -> int:
        found = split(sample, self.mask) if leaves > 1 else None
        if found is None:
            self.leaves += 1
            return ~(self.leaves - 1)
        point, radius, distance = found
        spot = len(self.nodes)
        self.nodes.append((point, radius, 0, 0))
        near = sample[distance <= radius]
        share = min(leaves - 1, max(1, round(leaves * len(near) / len(sample))))
        inner, outer = self.grown(near, share), self.grown(sample[distance > radius], leaves - share)
        self.nodes[spot] = (point, radius, inner, outer)
        return spot

    def dealt(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of a point, shard, and whether it lives there, for each point's own shard and those that it visits."""
        out, todo = [], [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, spot, home = todo.pop()
            if node < 0 or not len(spot):
                out.append((spot, np.full(len(spot), ~node if node < 0 else 0, np.int64), home))
                continue
            point, radius, inner, outer = self.nodes[node]
            distance = np.bitwise_count((points[spot] ^ point) & self.mask)
            near, far = sides(distance, home, radius, reach)
            todo += [(inner, spot[near], home[near] & (distance[near] <= radius)), (outer, spot[far], home[far])]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def split(points: np.ndarray, mask: np.uint64) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point among the points, the radius that halves them best, and their distances; None if all are alike under the mask."""
    if len(points) < 2:
        return None
    for point in (points[len(points) // 2], points[0]):
        distance = np.bitwise_count((points ^ point) & mask)
        most = int(distance.max())
        if most:
            below = np.cumsum(np.bincount(distance, minlength=most + 1))[:-1]
            return point, int(np.abs(below - len(points) / 2).argmin()), distance
    return None


def sides(distance: np.ndarray, home: np.ndarray, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Who goes within the radius, and who beyond. Where it lives a point goes; into others a ball that overlaps them, but what lives within need not visit beyond."""
    distance = distance.astype(np.int64)
    return distance - reach <= radius, (distance > radius) | (~home & (distance + reach > radius))


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Puts the classes of a and b together, in place: label has each one's smallest member (at last)."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, step := label[label]):
            label[:] = step


def compared(points: np.ndarray, spots: np.ndarray, limit: int, label: np.ndarray, side: int = 1024) -> None:
    """Unites all of spots that differ in `limit` bits at most. Blocks that are one class already are left out."""
    for i in range(0, len(spots), side):
        one = spots[i : i + side]
        for j in range(i, len(spots), side):
            two = spots[j : j + side]
            first = label[one[0]]
            if (label[one] == first).all() and (label[two] == first).all():
                continue
            a, b = np.nonzero(np.bitwise_count(points[one][:, None] ^ points[two]) <= limit)
            union(label, one[a], two[b])


def joined(points: np.ndarray, home: np.ndarray, mask: int, reach: int, limit: int) -> np.ndarray:
    """For each point of a shard, the place of its class's first. The shard's tree is searched down to small groups."""
    label, mask = np.arange(len(points)), np.uint64(mask)
    todo = [(np.arange(len(points)), home)]
    while todo:
        spots, own = todo.pop()
        if not own.any() or len(spots) < 2:
            continue
        found = split(points[spots], mask) if len(spots) > GROUP else None
        if found is None:
            compared(points, spots, limit, label)
            continue
        _, radius, distance = found
        near, far = sides(distance, own, radius, reach)
        if near.sum() + far.sum() > 1.7 * len(spots):
            compared(points, spots, limit, label)  # the bounds rule too little out here
            continue
        todo += [(spots[near], own[near] & (distance[near] <= radius)), (spots[far], own[far])]
    return label


def links_of(prints: DataFrame, limit: int, blocks: int | None = None) -> DataFrame:
    """a, b: links that connect all fingerprints (column fp, distinct and stored) that differ in `limit` bits at most."""
    spark, n = prints.sparkSession, prints.count()
    masks = masks_of(n, limit, blocks)
    reach = radius_of(limit, masks)
    sample = prints.select("fp", F.xxhash64("fp", F.lit(7)).alias("h")).orderBy("h", "fp").limit(SAMPLE).select("fp") if n > SAMPLE else prints.select("fp")
    sample = np.array([r["fp"] for r in sample.collect()], np.int64).view(np.uint64)
    trees = [Tree(sample, m, min(LEAVES, -(-n // SHARD))) for m in masks]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            for t, tree in enumerate(trees):
                spot, shard, home = tree.dealt(points, reach)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(spot), t, np.int32)), pa.array(shard), pa.array(points[spot].view(np.int64)), pa.array(home)], ["tree", "shard", "fp", "home"])

    dealt = stored(prints.select("fp").mapInArrow(deal, "tree int, shard long, fp long, home boolean"), "shards")
    # At most len(trees) * LEAVES rows.
    sizes = dealt.groupBy("tree", "shard").agg(F.count("*").alias("n")).where(F.col("n") > 2 * FEW)
    chunk = F.greatest(F.lit(FEW), F.least(F.lit(MANY), F.ceil(F.col("n") / 64)))
    sizes = sizes.select("tree", "shard", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    dealt = dealt.join(F.broadcast(sizes), ["tree", "shard"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # A pair of chunks meets in one cell; a chunk is compared with itself in each of its cells.
    dealt = dealt.withColumn("row", F.least("own", "other")).withColumn("column", F.greatest("own", "other"))

    def search(key: tuple, group: pa.Table) -> pa.Table:
        points = group.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(points, kind="stable")
        points, home = points[order], group.column("home").to_numpy(zero_copy_only=False)[order]
        label = joined(points, home, masks[key[0].as_py()], reach, limit)
        linked = label != np.arange(len(label))
        return pa.table({"a": points[label[linked]].view(np.int64), "b": points[linked].view(np.int64)})

    return dealt.groupBy("tree", "shard", "row", "column").applyInArrow(search, "a long, b long").where("a <> b").distinct()


def similar(docs: DataFrame, limit: int = 4, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (the smallest id that links lead to) of every row."""
    own = fingerprints(docs, id_col, text_col, words, seed)
    prints = stored(own.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")), "prints")
    labels = stored(components(stored(links_of(prints, limit, blocks), "links")), "labels")
    classes = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"), F.col("comp").isNotNull().alias("linked"), "least", "rows")
    # Fingerprints of one row and no link answer for themselves.
    classes = classes.where("linked or rows > 1")
    least = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = stored(classes.select("fp", "comp").join(least, "comp").select("fp", "component_id", F.lit(True).alias("known")), "classes")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id"))
    return own.join(known, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
