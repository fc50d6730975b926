"""Snippets of one task in the prompts of another, as a join of rolling hashes.

Snippets are told by their first `width` characters (all, where they have one width). For every window of that width in
a text, two hashes are rolled over whole batches at once: of the window, and of its minimiser, the sub-window of half the width with the least hash. A text that
holds a snippet holds the snippet's minimiser as that of some window, and neighbouring windows mostly share theirs, so a
text is told by about 4 / width of its positions. A sieve of the snippets' minimisers, a bit map of fixed size, keeps the
runs of windows that may hold a snippet, whose text goes on; distinct regions of text are then joined with distinct
snippets by equal window hashes and confirmed character by character. Texts are read once, whatever there is of
snippets; a full sieve lets more through, never less. No text meets a snippet whose hash it does not have, and a passage
that many texts or many snippets share is compared once.

The only thing that goes to the driver, and to tasks, is the sieve: SIEVE_BITS bits at most. Null texts are not checked,
empty ones and those shorter than a snippet hold none; null and empty snippets are in no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the sieve at most, of one of its blocks, and for each snippet.
SIEVE_BITS, BLOCK_BITS, BITS_EACH = 1 << 27, 1 << 19, 16
#: Characters at once.
AT_ONCE = 1 << 20
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2 ** 64."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(AT_ONCE, x, np.uint64)), dtype=np.uint64) for x in (BASE, INVERSE))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the polynomial reaches every bit of the hash."""
    for shift in (33, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def rolled(points: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of `width` among code points (AT_ONCE at most)."""
    if len(points) < width:
        return np.zeros(0, np.uint64)
    up, down = powers()
    total = np.append(np.uint64(0), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * down[: len(points)], dtype=np.uint64))
    return mixed((total[width:] - total[:-width]) * up[: len(points) - width + 1])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours: of two minima that run from the borders of blocks."""
    n = len(x) - width + 1
    padded = np.append(x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def part_of(width: int) -> int:
    return max(1, width // 2)


def minimisers(points: np.ndarray, width: int) -> np.ndarray:
    """The least hash of a half-width window, for each window of `width`."""
    part = part_of(width)
    return sliding_least(rolled(points, part), width - part + 1) if len(points) >= width else np.zeros(0, np.uint64)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def laid_out(texts: list[str | None], width: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """Texts end to end, about AT_ONCE characters at a time: the text's place in the list and where it begins (for each piece), and the characters. A longer text comes in pieces that overlap by the longest snippet."""
    owners, starts, pieces, size = [], [], [], 0
    for i, text in enumerate(texts):
        if text is None or len(text) < width:
            continue
        for a in range(0, len(text) - width + 1, AT_ONCE - longest + 1):
            piece = text[a : a + AT_ONCE]
            if size + len(piece) > AT_ONCE:
                yield np.array(owners), np.array(starts), "".join(pieces)
                owners, starts, pieces, size = [], [], [], 0
            owners.append(i)
            starts.append(size)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield np.array(owners), np.array(starts), "".join(pieces)


def hashed(snippets: DataFrame, width: int) -> DataFrame:
    """snippet, tasks, window, least (the hashes of the snippet and of its minimiser) of every distinct snippet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [points_of(x[:width]) for x in batch.column("snippet").to_pylist()]
            window = np.array([rolled(x, width)[0] for x in points], np.uint64).view(np.int64)
            least = np.array([minimisers(x, width)[0] for x in points], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("snippet"), batch.column("tasks"), pa.array(window), pa.array(least)], ["snippet", "tasks", "window", "least"])

    distinct = snippets.groupBy("snippet").agg(F.collect_set("task_id").alias("tasks"))
    return distinct.mapInArrow(run, f"snippet string, tasks {dict(distinct.dtypes)['tasks']}, window long, least long")


def sieve_of(known: DataFrame) -> np.ndarray:
    """A bit map of the minimisers, in words of 64 bits; how many there are decides its size, up to SIEVE_BITS."""
    n = known.count()
    bits = BLOCK_BITS
    while bits < min(SIEVE_BITS, BITS_EACH * n):
        bits *= 2

    def block(key: tuple, group: pa.Table) -> pa.Table:
        words = np.zeros(BLOCK_BITS // 64, np.uint64)
        spot = group.column("spot").to_numpy().astype(np.uint64)
        np.bitwise_or.at(words, (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([words.tobytes()], pa.binary())})

    spot = F.col("least").bitwiseAND(bits - 1)
    dealt = known.select(F.floor(spot / BLOCK_BITS).cast("int").alias("block"), F.pmod(spot, F.lit(BLOCK_BITS)).alias("spot")).distinct()
    sieve = np.zeros(bits // 64, np.uint64)
    for r in dealt.groupBy("block").applyInArrow(block, "block int, words binary").collect():  # SIEVE_BITS / BLOCK_BITS rows at most
        sieve[r["block"] * BLOCK_BITS // 64 :][: BLOCK_BITS // 64] = np.frombuffer(r["words"], np.uint64)
    return sieve


def regions(prompts: DataFrame, sieve: np.ndarray, width: int, longest: int) -> DataFrame:
    """prompt_id, task_id, region: the stretches of each text whose windows' minimisers are in the sieve, and what a longest snippet has beyond its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.uint64(len(sieve) * 64 - 1)
        for batch in batches:
            spots, found = [], []
            for owners, starts, text in laid_out(batch.column("text").to_pylist(), width, longest):
                least = minimisers(points_of(text), width)
                at = np.arange(len(least))
                piece = np.searchsorted(starts, at, "right") - 1
                whole = at + width <= np.append(starts[1:], len(text))[piece]  # windows of one piece
                head = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (piece[1:] != piece[:-1]) | (whole[1:] != whole[:-1])))
                tail = np.append(head[1:], len(least))
                bit = least[head] & last
                kept = whole[head] & ((sieve[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1)
                ends = np.append(starts[1:], len(text))
                for a, b in zip(head[kept].tolist(), tail[kept].tolist(), strict=True):
                    spots.append(int(owners[piece[a]]))
                    found.append(text[a : min(b - 1 + longest, int(ends[piece[a]]))])
            taken = pa.array(spots, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("prompt_id").take(taken), batch.column("task_id").take(taken), pa.array(found, pa.string())], ["prompt_id", "task_id", "region"])

    kinds = dict(prompts.dtypes)
    return prompts.select("prompt_id", "task_id", "text").mapInArrow(run, f"prompt_id {kinds['prompt_id']}, task_id {kinds['task_id']}, region string")


def windows(distinct: DataFrame, width: int) -> DataFrame:
    """region, place, window: the hash of each window of each region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [rolled(points_of(x), width) for x in batch.column("region").to_pylist()]
            n = np.array([len(v) for v in values], np.int64)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("region").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(place), pa.array(flat.view(np.int64))], ["region", "place", "window"])

    return distinct.mapInArrow(run, "region string, place long, window long")


def contamination(prompts: DataFrame, snippets: DataFrame) -> DataFrame:
    """Distinct prompt_id, task_id where a prompt holds a snippet of another task. prompts: prompt_id, task_id, text; snippets: task_id, snippet."""
    some = snippets.where(F.char_length("snippet") > 0)
    width, longest = some.agg(F.min(F.char_length("snippet")), F.max(F.char_length("snippet"))).first()
    if width is None:
        return prompts.limit(0).select("prompt_id", "task_id")
    if longest > AT_ONCE // 2:
        raise ValueError(f"a snippet has {longest} characters, over {AT_ONCE // 2}")
    known = hashed(some, width)
    met = regions(prompts, sieve_of(known), width, longest)
    inside = windows(met.select("region").distinct(), width).join(known, "window")
    sure = inside.where(F.substring("region", F.col("place").cast("int") + 1, F.char_length("snippet")) == F.col("snippet"))
    tasks = sure.select("region", F.explode("tasks").alias("other")).distinct()
    return met.join(tasks, "region").where(F.col("task_id") != F.col("other")).select("prompt_id", F.col("other").alias("task_id")).distinct()


def checked(prompts: DataFrame, snippets: DataFrame) -> DataFrame:
    """task_id, items, failed: for the prompts of each task, how many (prompt, other task) were checked and how many failed. Prompts without a text are not checked."""
    own = prompts.where(F.col("text").isNotNull())
    tasks = snippets.where(F.col("snippet").isNotNull()).select("task_id").distinct()
    n = tasks.agg(F.count("*").alias("n"))
    counted = own.groupBy("task_id").agg(F.count("*").alias("prompts")).join(tasks.withColumn("has", F.lit(1)), "task_id", "left").crossJoin(F.broadcast(n))  # one row
    found = contamination(own, snippets).groupBy(F.col("task_id").alias("other")).agg(F.count("*").alias("failed"))
    items = counted.select("task_id", (F.col("prompts") * (F.col("n") - F.coalesce("has", F.lit(0)))).alias("items"), F.lit(0).cast("long").alias("failed"))
    return items.unionByName(found.select(F.col("other").alias("task_id"), F.lit(0).cast("long").alias("items"), "failed"))
