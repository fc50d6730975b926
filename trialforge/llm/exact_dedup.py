"""Exact duplicates by counting quotient filters.

Every text is normalised (each run of ASCII white space becomes one space) and gets a 64-bit fingerprint. Each
partition builds counting quotient filters, one for each range of fingerprints; filters of a range merge without loss,
because their entries are sorted by quotient and remainder and hold the whole fingerprint. A fingerprint with a count
of one is a unique text and needs no more work. Texts whose fingerprint counts more go to byte verification: they are
grouped by their own bytes (combined before the shuffle, so that a hot text costs one row per partition).

Edge cases: null text counts as empty; empty texts equal each other; a table without rows gives no rows. Repeated rows
(same id, same text) count in group_size; annotate() marks each of them kept, distinct_rows() keeps one. A null id is
never the smallest unless the whole group has none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialforge.llm._common import stored

#: Fingerprints held in one filter at most, before it is emitted and another one begins.
FILTER_CAPACITY = 1_000_000
REMAINDER_BITS = 32
#: 64-bit words of a sieve: 16 bits for each fingerprint, but 1 MB at least and 8 MB at most.
SIEVE_WORDS, SIEVE_MOST = 1 << 17, 1 << 20


class CountingQuotientFilter:
    """Compact counting quotient filter over a sorted multiset of 64-bit fingerprints.

    The upper half of a fingerprint is its quotient, the lower half its remainder. `occupied` lists the quotients in use
    (gaps, since they are sorted), `runends` marks the last slot of each quotient's run, `slots` holds remainders and,
    where `counter` is set, the count (less one) of the remainder in the slot before it.
    """

    def __init__(self, occupied: np.ndarray, runends: np.ndarray, slots: np.ndarray, counter: np.ndarray):
        self.occupied, self.runends, self.slots, self.counter = occupied, runends, slots, counter

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """keys: sorted distinct uint64; counts: how often each occurs, below 2**32."""
        quotient = (keys >> np.uint64(REMAINDER_BITS)).astype(np.uint32)
        width = 1 + (counts > 1).astype(np.int64)
        first = np.cumsum(width) - width
        slots, counter = np.zeros(int(width.sum()), np.uint32), np.zeros(int(width.sum()), bool)
        slots[first] = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        many = counts > 1
        slots[first[many] + 1], counter[first[many] + 1] = counts[many] - 1, True
        last = np.append(quotient[1:] != quotient[:-1], True)[: len(keys)]
        runends = np.zeros(len(slots), bool)
        runends[(first + width - 1)[last]] = True
        return cls(quotient[last], runends, slots, counter)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct fingerprints in order, and their counts."""
        run = np.cumsum(self.runends) - self.runends
        own = np.flatnonzero(~self.counter)
        keys = (self.occupied[run[own]].astype(np.uint64) << np.uint64(REMAINDER_BITS)) | self.slots[own].astype(np.uint64)
        counts = np.ones(len(own), np.int64)
        follows = np.append(self.counter[1:], False)[own] if len(own) else np.zeros(0, bool)
        counts[follows] += self.slots[own[follows] + 1]
        return keys, counts

    def to_bytes(self) -> bytes:
        gaps = np.diff(self.occupied, prepend=np.uint32(0)).astype(np.uint32)
        parts = [gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), np.packbits(self.runends).tobytes(), self.slots.tobytes(), np.packbits(self.counter).tobytes()]
        head = np.array([len(self.occupied), len(self.slots)], np.int64).tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        raw = zstandard.ZstdDecompressor().decompress(data)
        n, m = np.frombuffer(raw, np.int64, 2)
        at, bits = 16, -(-int(m) // 8)
        gaps = np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T.copy().view(np.uint32).ravel()
        at += 4 * n
        runends = np.unpackbits(np.frombuffer(raw, np.uint8, bits, at), count=m).astype(bool)
        slots = np.frombuffer(raw, np.uint32, m, at + bits)
        counter = np.unpackbits(np.frombuffer(raw, np.uint8, bits, at + bits + 4 * m), count=m).astype(bool)
        return cls(np.cumsum(gaps, dtype=np.uint32), runends, slots, counter)


def merged(filters: Iterator[CountingQuotientFilter]) -> CountingQuotientFilter:
    """The filter of the multiset union: entries of all filters in order, counts of equal ones added."""
    held = [x.entries() for x in filters]
    keys, counts = (np.concatenate([x[k] for x in held]) if held else np.zeros(0, t) for k, t in ((0, np.uint64), (1, np.int64)))
    order = np.argsort(keys, kind="stable")  # for these a timsort: it finds the sorted runs, one of each filter, and merges them
    keys, counts = keys[order], counts[order]
    if len(keys):
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
    return CountingQuotientFilter.build(keys, np.minimum(counts, 2**32 - 1))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, sha of each row."""
    own = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return own.select("id", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"))


def repeated_fingerprints(fps: DataFrame, n_rows: int) -> DataFrame:
    """Fingerprints (column fp) that occur more than once, by merged filters. Ranges grow in number with the rows."""
    bits = max(3, int(np.ceil(np.log2(max(1, n_rows) / FILTER_CAPACITY))))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def filters() -> Iterator[pd.DataFrame]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            rows = [(i, CountingQuotientFilter.build(k, c).to_bytes()) for i, (k, c) in enumerate(zip(np.split(keys, edges), np.split(counts, edges), strict=True)) if len(k)]
            yield pd.DataFrame(rows, columns=["bin", "data"])

        for x in batches:
            held.append(x["fp"].to_numpy(np.int64).view(np.uint64))
            if sum(map(len, held)) >= FILTER_CAPACITY:
                yield from filters()
                held = []
        if sum(map(len, held)):
            yield from filters()

    def merge(x: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merged(map(CountingQuotientFilter.from_bytes, x["data"])).entries()
        return pd.DataFrame({"fp": keys[counts > 1].view(np.int64)})

    return fps.select("fp").mapInPandas(build, "bin int, data binary").groupBy("bin").applyInPandas(merge, "fp long")


def positions(fp: Column, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(fp, F.lit(k)), F.lit(64 * words)) for k in range(3)]


class Sieve:
    """A Bloom filter of a bounded size over the repeated fingerprints: what it does not hold is unique, so its text need
    not be shuffled. With more fingerprints than it is made for it holds back less, and nothing else changes."""

    def __init__(self, again: DataFrame):
        size = SIEVE_WORDS
        n = again.count()
        while size < SIEVE_MOST and 4 * size < n:
            size *= 2
        at = again.select(F.explode(F.array(*positions(F.col("fp"), size))).alias("at"))
        words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).collect()  # SIEVE_MOST rows at most
        self.words = np.zeros(size, np.int64)
        self.words[[r["word"] for r in words]] = [r["bits"] for r in words]

    def may_hold(self, fp: Column) -> Column:
        words = self.words.view(np.uint64)

        @F.pandas_udf("boolean")
        def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            out = np.ones(len(a), bool)
            for x in (a, b, c):
                at = x.to_numpy(np.int64)
                out &= (words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
            return pd.Series(out)

        return run(*positions(fp, len(self.words)))


def duplicate_classes(docs: DataFrame, again: DataFrame, sieve: Sieve, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fp, sha, keep_id, group_size of every group of two or more equal texts, equal byte by byte. again: the repeated fingerprints, stored."""
    own = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("fp", F.xxhash64("norm"))
    suspects = own.where(sieve.may_hold(F.col("fp"))).join(again, "fp", "left_semi")
    same = suspects.groupBy("fp", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return same.select("fp", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "keep_id", "group_size")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, keep_id, group_size, kept, text_sha256."""
    prints = stored(fingerprinted(docs, id_col, text_col), "fingerprints")
    again = stored(repeated_fingerprints(prints, prints.count()), "repeated")
    classes = stored(duplicate_classes(docs, again, Sieve(again), id_col, text_col), "classes")
    joined = prints.join(classes, ["fp", "sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, less those whose text a smaller id has."""
    prints = stored(fingerprinted(docs, id_col, text_col), "fingerprints")
    again = stored(repeated_fingerprints(prints, prints.count()), "repeated")
    sieve = Sieve(again)
    classes = stored(duplicate_classes(docs, again, sieve, id_col, text_col), "classes").select("fp", "sha", "keep_id", F.lit(True).alias("repeated"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), normalised(F.col(text_col)).alias("norm")).withColumn("fp", F.xxhash64("norm"))
    rows = rows.withColumn("suspect", sieve.may_hold(F.col("fp")))
    suspects = rows.where("suspect").select("row", "fp", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")).join(classes, ["fp", "sha"], "left")
    first = suspects.where(F.col("repeated") & F.col(f"row.{id_col}").eqNullSafe(F.col("keep_id"))).dropDuplicates(["fp", "sha"])
    return rows.where("not suspect").select("row.*").unionByName(suspects.where("repeated is null").select("row.*")).unionByName(first.select("row.*"))
