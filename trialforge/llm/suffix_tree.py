"""LM scoring by a probabilistic suffix tree over words.

Contexts are the last words of a text, as many as the test asks for. A context becomes a state if it occurs `least`
times or more, however long it is, and a divergence test retains it: the gain in log-likelihood over its parent, summed over all its training
occurrences, each with itself left out, is above `gain` for one of three smoothing strengths; the best strength stays
with the state. A context is tested where its parent does not tell the next word alone already, that is, where the
parent is not always followed by one word, and, from three words on, where the parent is a state: contexts grow by a word
until there is none left to extend. There is no largest depth. A text is scored by the longest state that is a suffix of what
came before each token; a state's distribution is smoothed with that of the next shorter state, down to the root, whose
unigrams are smoothed by adding one (with one share for all unknown words). Each distribution sums to one over the known
tokens and the unknown one.

The model is never gathered in one place. Texts are encoded into blocks, kept in a table bucketed by block, so that they
are not shuffled again. A block asks once for the n-grams it has, by sorted 64-bit hashes dealt into ranges; each range
adds up the training counts of all blocks and answers each block in the order it asked. Exchanges of this kind add up
the gains of the contexts and answer which are states. A token that occurs once after its context gains what the
context's count tells, so only the gains of other ones are sent; of contexts of one and two words the ranges hold which
are frequent in a block, so their keys are not sent again. Answers to the first steps are dealt by block once, into a
table bucketed by block. Hot n-grams cost a block one entry. N-grams of three words are
only asked for after such contexts, longer ones only after states, and only the tokens concerned are carried on, with
what is known already of their contexts' counts. An answer also tells whether other blocks asked for the n-gram: one that
no other block has is not asked for again, nor is any longer one that holds it, since the block counts these by itself.
Gains are rounded to 64ths of a nat token by token and added as integers, so that states do not depend on how texts are
dealt into blocks, and what a longer context adds to a token ends where it rounds to nothing. Keys of 64 bits are taken as exact: among n different n-grams two share one with a probability
of n * n / 2**65.

Edge cases: null and empty texts are their end token alone; without training texts nothing is known and each token has
probability one; repeated rows count and are answered each; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialforge.llm._common import CLEAN, as_text, dropped, mix64, pieces_of, raw_text, released, settings, stored, stored_at, words_in, work_dir

STRENGTHS = (0.05, 0.5, 4.0)
AT_ONCE, ENTRIES = 8_000_000, 2_000_000
END = np.uint64(0x5851F42D4C957F2D)
SCALE = 64  # gains of tokens are counted in whole parts of a nat
#: Tags of rows beside the orders of n-grams: verdicts on contexts of d words are VERDICT + d; CARRIED are tokens carried on, with the words before each up to the next multiple of WINDOW;
#: HELD + d is what a range holds of frequent n-grams of d words: for each block the places of its own among them, and, as block -1, their counts.
VERDICT, CARRIED, HELD, WINDOW = 1_000_000, 2_000_000, 3_000_000, 4


def squeezed(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed; signed ones as unsigned, with the sign as the last bit."""
    if values.dtype == np.int64:
        values = (values << 1 ^ values >> 63).view(np.uint64)
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return np.array([len(values)], np.int64).tobytes() + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueezed(data: bytes, kind: type) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    raw = zstandard.ZstdDecompressor().decompress(data[8:]) if n else b""
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind)
    if values.dtype == np.int64:
        values = (values.view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(values & 1)
    return values


def squeezed_keys(keys: np.ndarray) -> bytes:
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def unsqueezed_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(data, np.uint64), dtype=np.uint64)


def sparse(values: np.ndarray) -> bytes:
    """Rows of integers, of which those that begin with 0 are left out."""
    flags = values[:, 0] > 0
    bits = np.packbits(flags).tobytes()
    return len(bits).to_bytes(8, "little") + bits + squeezed(values[flags].T.ravel())


def dense(data: bytes, n: int, width: int) -> np.ndarray:
    """The n rows again, zeros for those that were left out."""
    out, size = np.zeros((n, width), np.int64), int.from_bytes(data[:8], "little")
    out[np.unpackbits(np.frombuffer(data, np.uint8, size, 8), count=n).astype(bool)] = unsqueezed(data[8 + size :], np.int64).reshape(width, -1).T
    return out


def order_of(keys: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit keys. Numbers of their first bits and their places are sorted, which is several times as fast as to sort places by keys; where that leaves keys out of order, as they differ in later bits alone, these are."""
    if not len(keys):
        return np.zeros(0, np.int64)
    skip, low = np.uint64(64 - max(1, int(keys.min() ^ keys.max()).bit_length())), np.uint64((1 << (len(keys) - 1).bit_length()) - 1)
    order = (np.sort((keys << skip) & ~low | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    ordered = keys[order]
    return order if (ordered[1:] >= ordered[:-1]).all() else np.argsort(keys, kind="stable")


def encoded(docs: DataFrame, training: Column, id_col: str, text_col: str) -> DataFrame:
    """block, ids, train, lengths, vocab, seq, tokens (training tokens), size (all tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 28
        for x in batches:
            done = 0
            for raw in pieces_of(x.column("raw"), AT_ONCE):
                own = x.slice(done, len(raw))
                done += len(raw)
                index, starts, words = words_in(pc.ascii_lower(as_text(raw)))
                seq = np.insert(index.astype(np.uint32) + np.uint32(1), starts[1:], 0)  # 0 ends a text
                lengths, train = (np.diff(starts) + 1).astype(np.uint32), own.column("train").to_numpy(zero_copy_only=False)
                vocab = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.uint64, len(words))
                row = {"block": block, "ids": json.dumps(own.column("id").to_pylist()).encode(), "train": np.packbits(train).tobytes(), "lengths": squeezed(lengths), "vocab": np.append(END, vocab).tobytes(), "seq": squeezed(seq), "tokens": int(lengths[train].sum()), "size": int(lengths.sum())}
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in row.values()], list(row))
                block += 1
        released()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(training, F.lit(False)).alias("train"), raw_text(F.col(text_col)).alias("raw"))
    return rows.mapInArrow(run, "block long, ids binary, train binary, lengths binary, vocab binary, seq binary, tokens long, size long")


class Block:
    """The tokens of a block, in order, and n-grams by where they end. Tokens lie in runs: the block's texts, or, of a
    block that is carried on, what is left of them; `docs` has each run's text and `begin` its first token's place there."""

    def __init__(self, number: int, lengths: np.ndarray, vocab: np.ndarray, seq: np.ndarray, train: np.ndarray, docs: np.ndarray, begin: np.ndarray):
        self.number, self.lengths, self.vocab, self.seq, self.train, self.docs, self.begin = number, lengths, vocab, seq, train, docs, begin
        self.n, self.starts = len(lengths), np.cumsum(lengths) - lengths
        self.numbered: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, row: pd.Series) -> Block:
        lengths = unsqueezed(row["lengths"], np.uint32).astype(np.int64)
        n = len(lengths)
        train = np.unpackbits(np.frombuffer(row["train"], np.uint8), count=n).astype(bool)
        return cls(row["block"], lengths, np.frombuffer(row["vocab"], np.uint64), unsqueezed(row["seq"], np.uint32), train, np.arange(n), np.zeros(n, np.int64))

    def windows(self, at: np.ndarray, reach: int) -> tuple[Block, np.ndarray]:
        """The block of the tokens `at` and of up to `reach` tokens before each, and where `at` lie in it."""
        run = self.owner_of(at)
        change = np.zeros(len(self.seq) + 1, np.int64)
        np.add.at(change, np.maximum(at - reach, self.starts[run]), 1)
        np.add.at(change, at + 1, -1)
        kept = np.cumsum(change[:-1]) > 0
        spots = np.flatnonzero(kept)
        owner = self.owner_of(spots)
        first = np.flatnonzero(np.append(True, (spots[1:] != spots[:-1] + 1) | (owner[1:] != owner[:-1])))
        runs, used = owner[first], np.zeros(len(self.vocab), bool)
        used[self.seq[spots]] = True
        seq = (np.cumsum(used) - 1)[self.seq[spots]].astype(np.uint32)
        part = Block(self.number, np.diff(np.append(first, len(spots))), self.vocab[used], seq, self.train[runs], self.docs[runs], self.begin[runs] + spots[first] - self.starts[runs])
        return part, (np.cumsum(kept) - 1)[at]

    @cached_property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.lengths)

    @cached_property
    def place(self) -> np.ndarray:
        return np.arange(len(self.seq)) - np.repeat(self.starts, self.lengths)

    def owner_of(self, at: np.ndarray) -> np.ndarray:
        """The runs of some tokens, without laying out those of all."""
        return np.searchsorted(self.starts, at, "right") - 1

    def place_of(self, at: np.ndarray) -> np.ndarray:
        """The places of some tokens in their texts."""
        run = self.owner_of(at)
        return at - self.starts[run] + self.begin[run]

    def number_all(self, n: int, at: np.ndarray) -> None:
        """Numbers the n-grams that end at `at`, which grams() then picks from where it can."""
        which = np.full(len(self.seq), -1, np.int32)
        if n == 1:
            order = order_of(self.vocab)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            self.numbered[1] = rank[self.seq], self.vocab[order]
        else:
            which[at], distinct = self.sorted_grams(n, at)
            self.numbered[n] = which, distinct

    def sorted_grams(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if n == 1:
            distinct, which = np.unique(self.vocab[self.seq[at]], return_inverse=True)
            return which, distinct
        total = np.zeros(len(at), np.uint64)
        for k in range(n - 1, -1, -1):
            total = total * np.uint64(0x9E3779B97F4A7C15) + self.vocab[self.seq[at - k]]
        keys = mix64(total + np.uint64(n))
        order = order_of(keys)
        ordered = keys[order]
        first = np.append(True, ordered[1:] != ordered[:-1]) if len(ordered) else np.zeros(0, bool)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(first) - 1
        return which, ordered[first]

    def grams(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the n-grams that end at the tokens `at`: the number of each among the distinct ones, and these, sorted."""
        if n not in self.numbered or (self.numbered[n][0][at] < 0).any():
            return self.sorted_grams(n, at)
        every, distinct = self.numbered[n]
        which, met = every[at], np.zeros(len(distinct), bool)
        met[which] = True
        return (np.cumsum(met) - 1)[which], distinct[met]

    def counts_here(self, n: int, at: np.ndarray) -> np.ndarray:
        """Training counts, in this block, of the n-grams that end at each of the tokens `at`, which are all their occurrences."""
        which, distinct = self.grams(n, at)
        return np.bincount(which[self.train[self.owner_of(at)]], minlength=len(distinct))[which]

    def asked(self, n: int, at: np.ndarray, cut: int) -> list[tuple]:
        """Requests for counts of the n-grams that end at the tokens `at`, with their training counts in this block. A token counts once for each time it is in `at`."""
        which, distinct = self.grams(n, at)
        return list(dealt(self.number, n, distinct, np.bincount(which[self.train[self.owner_of(at)]], minlength=len(distinct)).astype(np.uint32), cut))


def dealt(block: int, n: int, keys: np.ndarray, values: np.ndarray, cut: int, packed=lambda v: squeezed(v.ravel())) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """Sorted keys and what goes with them, by the ranges (2**cut) they fall in."""
    for i, own in ranges_of(keys, cut):
        yield i, block, n, squeezed_keys(keys[own]), packed(values[own])


def ranges_of(keys: np.ndarray, cut: int) -> Iterator[tuple[int, slice]]:
    """The ranges that sorted keys fall in, and where."""
    edges = np.searchsorted(keys, np.arange(1 << cut, dtype=np.uint64) << np.uint64(64 - cut))
    for i, (a, b) in enumerate(zip(edges, np.append(edges[1:], len(keys)), strict=True)):
        if b > a:
            yield i, slice(a, b)


ASKS, ANSWERS = "bin int, block long, n int, keys binary, data binary", "block long, n int, bin int, data binary, known long"


def answered(x: pd.DataFrame, read, answer, shift: int, least: int = 0) -> Iterator[tuple[int, int, int, bytes, int]]:
    """For all requests of one range and order: values of equal keys, as read(data, number of keys) gives them, added up as
    integers, answer(sums, number of blocks that asked), and that for each block in its own order. least: what is HELD
    of the keys whose first sum is that or more comes as well, if not 0."""
    keys = [unsqueezed_keys(k) for k in x["keys"]]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")  # merges the sorted requests
    ordered = every[order]
    first = np.append(True, ordered[1:] != ordered[:-1])
    which = np.empty(len(every), np.int64)
    which[order] = np.cumsum(first) - 1
    given = np.concatenate([read(v, len(k)) for v, k in zip(x["data"], keys, strict=True)])
    edges = np.flatnonzero(first)
    sums = np.add.reduceat(given[order], edges, axis=0)
    values, known, a = answer(sums, np.diff(np.append(edges, len(every)))), int((sums[:, 0] > 0).sum()), 0
    n, number = int(x["n"].iloc[0]), int(x["bin"].iloc[0])
    often = sums[:, 0] >= least
    place = np.cumsum(often) - 1
    if least and often.any():
        yield -1, HELD + n, number, squeezed(sums[often, 0].astype(np.uint64)), 0
    for block, own in zip(x["block"], keys, strict=True):
        mine = which[a : a + len(own)]
        yield block, n + shift, number, squeezed(values[mine]), known
        if least and (frequent := often[mine]).any():
            yield block, HELD + n, number, squeezed(np.diff(place[mine[frequent]], prepend=0).astype(np.uint32)), 0
        a, known = a + len(own), 0


def exchange(requests: DataFrame, read, answer, shift: int = 0, least: int = 0) -> DataFrame:
    """block, n, bin, data, known of the answers."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        rows = [r for _, own in x.groupby("n") for r in answered(own, read, answer, shift, least)]
        return pd.DataFrame(rows, columns=["block", "n", "bin", "data", "known"])

    return requests.groupBy("bin").applyInPandas(run, ANSWERS)


def counts(requests: DataFrame, least: int = 0) -> DataFrame:
    """Counts, each with a last bit that is set if other blocks have the n-gram too."""
    return exchange(requests, lambda v, n: unsqueezed(v, np.uint32).reshape(-1, 1).astype(np.int64), lambda s, asked: s[:, 0].astype(np.uint64) << np.uint64(1) | (asked > 1), least=least)


def values_of(replies: pd.DataFrame, n: int, kind: type) -> np.ndarray:
    """Answers on order n, for the sorted distinct keys that were asked for."""
    own = replies[replies["n"] == n].sort_values("bin")["data"]
    return np.concatenate([unsqueezed(d, kind) for d in own]) if len(own) else np.zeros(0, kind)


class Model:
    """What a block knows of the model: counts of n-grams of up to `orders` words by where they end, whether other blocks have them, all training tokens and distinct ones."""

    def __init__(self, block: Block, replies: pd.DataFrame, tokens: int, distinct: int, least: int, orders: int = 3):
        self.block, self.total, self.least = block, tokens + distinct + 1, least
        self.at, self.count, self.shared, self.often = {1: np.arange(len(block.seq)), 2: np.flatnonzero(block.place >= 1)}, {}, {}, {}
        for n in range(1, orders + 1):
            at = self.at[n]
            block.number_all(n, at)
            count, shared = counts_of(block, n, at, self.alone(n), replies)
            self.count[n], self.shared[n] = np.zeros(len(block.seq)), np.zeros(len(block.seq), bool)
            self.count[n][at], self.shared[n][at] = count, shared
            if n < 3:
                often = values_of(replies, n, np.uint64) >> np.uint64(1) >= least
                self.often[n] = np.cumsum(often) - 1, block.numbered[n][1][often]
            if n == 2:
                at = self.frequent(2)
                self.at[3] = at[self.count[2][at] < self.count[1][at - 1]]

    def alone(self, n: int) -> np.ndarray:
        """Whether the n-grams that end at at[n] are known to lie in this block alone, as pairs in them do. Those of one and two words are all asked for."""
        at = self.at[n]
        return ~(self.shared[2][at - 1] & self.shared[2][at]) if n == 3 else np.zeros(len(at), bool)

    def frequent(self, d: int) -> np.ndarray:
        """Tokens whose context of d words occurs `least` times or more."""
        at = np.flatnonzero(self.block.place >= d)
        return at[self.count[d][at - 1] >= self.least]

    def place_of(self, d: int, at: np.ndarray) -> np.ndarray:
        """The places of the contexts of d (1 or 2) words before the tokens `at` among the block's frequent n-grams of d words."""
        return self.often[d][0][self.block.numbered[d][0][at - 1]]

    def root(self, left_out: bool = False) -> np.ndarray:
        c = self.count[1]
        return np.maximum(c, 1) / max(1, self.total - 1) if left_out else (c + 1) / self.total

    def near(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens with a context of d (1 or 2) words that is to be tested, and how often the context, and the token after it, occur."""
        at = self.frequent(1) if d == 1 else self.at[3]
        return at, self.count[d][at - 1], self.count[d + 1][at] if d + 1 in self.count else np.zeros(len(at))


def mixed(context, own, strength, below: np.ndarray, left_out: bool = False) -> np.ndarray:
    """Probability of tokens after contexts that occur `context` times, `own` times with the token, mixed with `below`."""
    one = float(left_out)
    weight = strength * context
    return (np.maximum(own - one, 0) + weight * below) / np.maximum(context - one + weight, 1e-12)


def counts_of(block: Block, n: int, at: np.ndarray, alone: np.ndarray, replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the n-grams that end at the tokens `at`, and whether other blocks may have them: from the answers, or, where they are `alone` in this block, from it."""
    count, shared = np.zeros(len(at)), ~alone
    told = values_of(replies, n, np.uint64)[block.grams(n, at[shared])[0]] if shared.any() else np.zeros(0, np.uint64)
    count[shared], count[alone] = told >> np.uint64(1), block.counts_here(n, at[alone])
    shared[shared] = (told & np.uint64(1)).astype(bool)
    return count, shared


def gained(block: Block, which: np.ndarray, n: int, at: np.ndarray, context: np.ndarray, own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each of n contexts, numbered by `which` before the tokens `at`: how many training tokens occur twice or more after it, and what these gain, for each strength."""
    used = np.flatnonzero((own >= 2) & block.train[block.owner_of(at)])
    which, context, own, below = (x[used] for x in (which, context, own, below))
    logs = np.log(below)
    sums = (np.bincount(which, np.rint(SCALE * (np.log(mixed(context, own, s, below, True)) - logs)), n) for s in STRENGTHS)
    return np.stack([np.bincount(which, minlength=n), *sums], 1).astype(np.int64)


def retained(sums: np.ndarray, count: np.ndarray, gain: float) -> np.ndarray:
    """Verdicts on contexts by their sums of gained() and their counts: 0, or 1 and the number of the best strength. A
    training token that occurs once after its context gains what the context's count tells: left out, nothing is left of it."""
    c = np.maximum(count, 1).astype(np.float64)
    once = np.stack([np.rint(SCALE * np.log(s * c / (c - 1 + s * c))) for s in STRENGTHS], 1).astype(np.int64)
    total = sums[:, 1:] + (count - sums[:, 0])[:, None] * once
    return np.where((sums[:, 0] > 0) & (total.max(1) > gain * SCALE), 1 + total.argmax(1), 0).astype(np.uint8)


def gains(block: Block, d: int, at: np.ndarray, context: np.ndarray, own: np.ndarray, below: np.ndarray, cut: int) -> list[tuple]:
    """Requests for verdicts on the contexts of d words before the tokens `at`, with their gains here, and, where there are any, their counts."""
    which, distinct = block.grams(d, at - 1)
    sums, count = gained(block, which, len(distinct), at, context, own, below), np.zeros(len(distinct), np.int64)
    count[which] = context
    return list(dealt(block.number, d, distinct, np.column_stack([sums, count, sums[:, 0] > 0]), cut, sparse))


def judged(requests: DataFrame, gain: float) -> DataFrame:
    """Verdicts on the contexts that gains() asks for."""
    width = len(STRENGTHS) + 3
    return exchange(requests, lambda v, n: dense(v, n, width), lambda s, asked: retained(s[:, :-2], s[:, -2] // np.maximum(s[:, -1], 1), gain), VERDICT)


def near_gains(m: Model, d: int, at: np.ndarray, context: np.ndarray, own: np.ndarray, below: np.ndarray, cut: int) -> list[tuple]:
    """Gains here of contexts of one or two words. The ranges know which of these are frequent in the block, so no keys are sent, and nothing where there are none."""
    keys = m.often[d][1]
    sums = gained(m.block, m.place_of(d, at), len(keys), at, context, own, below)
    return [(i, m.block.number, d, None, sparse(sums[x])) for i, x in ranges_of(keys, cut) if sums[x, 0].any()]


def near_judged(held: DataFrame, requests: DataFrame, gain: float) -> DataFrame:
    """Verdicts on all contexts of one or two words that are held, for each block on its own."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for tag, own in left.groupby("n"):
            d, count = int(tag) - HELD, unsqueezed(own.loc[own["block"] < 0, "data"].iloc[0], np.uint64).astype(np.int64)
            own = own[own["block"] >= 0]
            places = {b: np.cumsum(unsqueezed(v, np.uint32), dtype=np.int64) for b, v in zip(own["block"], own["data"], strict=True)}
            sums, asked = np.zeros((len(count), 1 + len(STRENGTHS)), np.int64), right[right["n"] == d]
            for b, v in zip(asked["block"], asked["data"], strict=True):
                sums[places[b]] += dense(v, len(places[b]), sums.shape[1])
            verdicts = retained(sums, count, gain)
            rows += [(b, VERDICT + d, own["bin"].iloc[0], squeezed(verdicts[x]), 0) for b, x in places.items()]
        return pd.DataFrame(rows, columns=["block", "n", "bin", "data", "known"])

    return held.groupBy("bin").cogroup(requests.groupBy("bin")).applyInPandas(run, ANSWERS)


def strengths(block: Block, d: int, at: np.ndarray, replies: pd.DataFrame) -> np.ndarray:
    """The smoothing strength of the state before each of the tokens `at`, 0 where the context is none."""
    return np.append(0.0, STRENGTHS)[values_of(replies, VERDICT + d, np.uint8)[block.grams(d, at - 1)[0]]]


def carried_on(block: Block, d: int, at: np.ndarray, p: np.ndarray, q: np.ndarray, context: np.ndarray, alone: np.ndarray, cut: int, window: int) -> list[tuple]:
    """Rows for the tokens that may have a state of d words: requests for the counts of it, where `context` has none (-1),
    and of what follows it, where that is not `alone` in the block, and the tokens themselves, with the words before them."""
    keep = block.place_of(at) >= d
    at, p, q, context, alone = (x[keep] for x in (at, p, q, context, alone))
    if not len(at):
        return []
    # Whether a token is carried on, and what is asked, depends on its n-gram alone, so these are all occurrences of each.
    asks = block.asked(d, at[context < 0] - 1, cut) + block.asked(d + 1, at[~alone], cut)
    b, spots = block.windows(at, (d // window + 1) * window)
    parts = (b.lengths.astype(np.uint32), b.vocab, b.seq, b.train.astype(np.uint8), b.docs.astype(np.uint32), b.begin.astype(np.uint32), spots.astype(np.uint32), p, q, (context + 1).astype(np.uint64), alone.astype(np.uint8))
    packed = [squeezed(x) for x in parts]
    return [*asks, (0, block.number, CARRIED, None, b"".join(len(x).to_bytes(8, "little") + x for x in packed))]


def carried(number: int, data: bytes) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block of the tokens that were carried on, their places in it, both probabilities, counts of contexts (-1: none yet) and what is alone."""
    parts, at = [], 0
    for kind in (np.uint32, np.uint64, np.uint32, np.uint8, np.uint32, np.uint32, np.uint32, np.float64, np.float64, np.uint64, np.uint8):
        size = int.from_bytes(data[at : at + 8], "little")
        parts.append(unsqueezed(data[at + 8 : at + 8 + size], kind))
        at += 8 + size
    lengths, vocab, seq, train, docs, begin, spots, p, q, context, alone = parts
    return Block(number, lengths.astype(np.int64), vocab, seq, train.astype(bool), docs.astype(np.int64), begin.astype(np.int64)), spots.astype(np.int64), p, q, context.astype(np.float64) - 1, alone.astype(bool)


def bucketed(df: DataFrame, buckets: int, name: str, path: str, by: str = "block") -> DataFrame:
    """The frame as a table in the shared folder, dealt by block (or range): joins by it don't shuffle it again."""
    spark = df.sparkSession
    with settings(spark, **{CLEAN: "true"}):
        df.write.mode("append").bucketBy(buckets, by).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


#: Tables beside that of the blocks: answers as the ranges give them, and by block; levels, in turn.
TABLES = ("held", "near", "a", "b")


def scored(docs: DataFrame, training: Column, least: int = 4, gain: float = 2.0, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learned from the rows where `training` is true. buckets: of the table of blocks, as many as shuffle partitions by default."""
    spark = docs.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{work_dir(spark)}/trialforge/{name}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        bucketed(encoded(docs, training, id_col, text_col), buckets, name, path)
        return _scored(spark.table(name), name, path, buckets, docs.schema[id_col].dataType.simpleString(), least, gain, id_col, window)
    finally:
        for x in ("", *(f"_{k}" for k in TABLES)):
            spark.sql(f"DROP TABLE IF EXISTS {name}{x}")
            dropped(spark, f"{path}{x}")


def _scored(blocks: DataFrame, name: str, path: str, buckets: int, kind: str, least: int, gain: float, id_col: str, window: int) -> DataFrame:
    tokens, size = (int(v or 0) for v in blocks.agg(F.sum("tokens"), F.sum("size")).first())
    cut = max(6, int(np.ceil(np.log2(max(1, 2 * size) / ENTRIES))))
    ask_columns, done = ["bin", "block", "n", "keys", "data"], "doc int, id string, train boolean, n_tokens long, n_known long, base_score double, score double"
    done_columns = [c.split()[0] for c in done.split(", ")]

    def framed(out: list[tuple], frame: pd.DataFrame | None, block: int, schema: str) -> pd.DataFrame:
        """Rows of ask_columns and a frame of done_columns as one; columns that rows lack are null, and of a kind that nulls of every type are made from."""
        parts = [x for x in (pd.DataFrame(out, columns=ask_columns), None if frame is None else frame.assign(block=block)) if x is not None]
        rows = pd.concat([x for x in parts if len(x)] or parts[:1])
        return pd.DataFrame({c: rows[c] if c in rows else pd.Series(None, rows.index, object) for c in (x.split()[0] for x in schema.split(", "))})

    def met(replies: DataFrame, work, schema: str, state: DataFrame | None = None) -> DataFrame:
        """work(block, ids or what of it is carried on, its replies) of all blocks, or those of `state`; it gives rows of ask_columns and, if it scores, a frame of done_columns."""

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = [framed(*work(Block.of(row), row["carried"] if "carried" in row else json.loads(row["ids"]), right), row["block"], schema) for _, row in left.iterrows()]
            return pd.concat(out) if len(out) > 1 else out[0] if out else framed([], None, 0, schema)

        left = blocks if state is None else blocks.join(state.select("block", F.col("data").alias("carried")), "block")
        return left.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, schema)

    def met_again(state: DataFrame, replies: DataFrame, work, schema: str) -> DataFrame:
        """The same of the blocks that are carried on."""

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return framed([], None, 0, schema)
            number = int(left["block"].iloc[0])
            return framed(*work(*carried(number, left["data"].iloc[0]), right), number, schema)

        return state.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, schema)

    def forget(*tables: str) -> None:
        for x in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}_{x}")
            dropped(spark, f"{path}_{x}")

    def kept(df: DataFrame, k: int) -> DataFrame:
        """The scores of a level as one of two tables in turn: the other one is what it was made from."""
        turn = "ab"[k % 2]
        forget(turn)
        return bucketed(df, buckets, f"{name}_{turn}", f"{path}_{turn}")

    def delivered(df: DataFrame) -> DataFrame:
        """Answers dealt by block, once, whichever steps read them, and added to one table, which meets the blocks without an exchange."""
        return bucketed(df.select("block", "n", "bin", "data").repartition(buckets, "block"), buckets, f"{name}_near", f"{path}_near")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for _, row in x.iterrows():
                b = Block.of(row)
                b.number_all(1, at := np.arange(len(b.seq)))
                yield pd.DataFrame(b.asked(1, at, cut) + b.asked(2, np.flatnonzero(b.place >= 1), cut), columns=ask_columns)
        released()

    spark = blocks.sparkSession
    held = bucketed(counts(blocks.mapInPandas(first, ASKS), least), buckets, f"{name}_held", f"{path}_held", "bin")
    distinct = int(held.where("n = 1").agg(F.sum("known")).first()[0] or 0)
    near = delivered(held.where(F.col("n") < HELD))

    def third(b: Block, ids: list, replies: pd.DataFrame) -> tuple:
        m = Model(b, replies, tokens, distinct, least, orders=2)
        return b.asked(3, m.at[3][~m.alone(3)], cut), None

    near = delivered(counts(met(near, third, ASKS)))

    def test(b: Block, ids: list, replies: pd.DataFrame) -> tuple:
        m, rows = Model(b, replies, tokens, distinct, least), []
        below = m.root(left_out=True)
        for d in (1, 2):
            at, context, own = m.near(d)
            rows += near_gains(m, d, at, context, own, below[at], cut)
            below[at] = mixed(context, own, STRENGTHS[1], below[at], True)
        return rows, None

    def score(b: Block, ids: list, replies: pd.DataFrame) -> tuple:
        m = Model(b, replies, tokens, distinct, least)
        p, q = m.root(), m.root(left_out=True)
        sum_of = lambda v: np.bincount(b.owner, v, b.n)
        base, last = np.log10(p), np.zeros(0, np.int64)
        for d in (1, 2):
            at, context, own = m.near(d)
            s = np.append(0.0, STRENGTHS)[values_of(replies, VERDICT + d, np.uint8)[m.place_of(d, at)]]
            at, context, own, s = (x[s > 0] for x in (at, context, own, s))
            p[at], q[at] = mixed(context, own, s, p[at]), mixed(context, own, s, q[at], True)
            last = at[own < context]
        # How often contexts of three words occur follows from what is known: a word that is always followed by one is a pair with it.
        last = last[b.place[last] >= 3]
        always = m.count[2][last - 1] >= m.count[1][last - 2]
        context, shared = (np.where(always, x[2][last - 2], x[3][last - 1]) for x in (m.count, m.shared))
        alone, often = ~(shared & m.shared[3][last]), context >= least
        last, context, alone = last[often], context[often], alone[often]
        frame = pd.DataFrame({"doc": np.arange(b.n), "id": pd.Series(ids, dtype=object), "train": b.train, "n_tokens": b.lengths, "n_known": sum_of(m.count[1] > 0).astype(np.int64), "base_score": sum_of(base), "score": sum_of(np.log10(p))})
        return carried_on(b, 3, last, p[last], q[last], context, alone, cut, window), frame

    both = ASKS + ", " + done
    near = delivered(near_judged(held.where(F.col("n") >= HELD), met(near, test, ASKS), gain))
    forget("held")
    out = kept(met(near, score, both), 0)
    forget("near")
    scores, depth = stored(out.where("n is null").select("block", *done_columns), "texts"), 3
    more = []
    while not (state := out.where("keys is null and n is not null").select(*near.columns)).isEmpty():
        replies, counts_path = stored_at(counts(out.where("keys is not null").select(*ask_columns)).select(*near.columns), "counts")

        def longer(b: Block, at: np.ndarray, p: np.ndarray, q: np.ndarray, context: np.ndarray, alone: np.ndarray, replies: pd.DataFrame, d: int = depth) -> tuple:
            """The tokens carried on whose context is frequent, its count and that of the token after it, whether other blocks have that, and probabilities."""
            new = context < 0
            context[new] = counts_of(b, d, at[new] - 1, np.zeros(new.sum(), bool), replies)[0]
            own, shared = counts_of(b, d + 1, at, alone, replies)
            often = context >= least
            return tuple(x[often] for x in (at, context, own, shared, p, q))

        def test_longer(b: Block, *state, d: int = depth, longer=longer) -> tuple:
            at, context, own, _, _, q = longer(b, *state)
            return gains(b, d, at, context, own, q, cut), None

        def score_longer(b: Block, *state, d: int = depth, longer=longer, full: Block | None = None) -> tuple:
            at, context, own, shared, p, q = longer(b, *state)
            place, seen = (lambda at: at) if full is None else (lambda at: full.starts[b.docs[b.owner_of(at)]] + b.place_of(at)), (at, own, shared)
            s = strengths(b, d, at, state[-1])
            at, context, own, shared, p, q, s = (x[s > 0] for x in (at, context, own, shared, p, q, s))
            now, docs = mixed(context, own, s, p), b.docs[b.owner_of(at)]
            moved, which = np.unique(docs, return_inverse=True)
            frame = pd.DataFrame({"doc": moved, "score": np.bincount(which, np.log10(now) - np.log10(p), len(moved))})
            q = mixed(context, own, s, q, True)
            at, shared, now, q = (x[own < context] for x in (at, shared, now, q))
            # The context of d + 1 words ends at the token before, and was counted there if that token was carried on too.
            before = np.minimum(np.searchsorted(seen[0], at - 1), max(0, len(seen[0]) - 1))
            met = seen[0][before] == at - 1
            context, alone = np.where(met, seen[1][before], -1.0), ~shared | (met & ~seen[2][before])
            often = ~met | (context >= least)
            at, now, q, context, alone = (x[often] for x in (at, now, q, context, alone))
            return carried_on(b if full is None else full, d + 1, place(at), now, q, context, alone, cut, window), frame

        def refilled(full: Block, data: bytes, replies: pd.DataFrame, score_longer=score_longer) -> tuple:
            """The same, with the words before the tokens taken from the whole block again: those carried on are used up."""
            return score_longer(*carried(full.number, data), replies, full=full)

        states, states_path = stored_at(judged(met_again(state, replies, test_longer, ASKS), gain).select(*near.columns), "states")
        replies = replies.union(states)
        again = met(replies, refilled, both, state) if (depth + 1) % window == 0 else met_again(state, replies, score_longer, both)
        out = kept(again, depth)
        dropped(spark, counts_path, states_path)
        more.append(stored(out.where("n is null").select("block", "doc", F.col("score").alias("change")), "changes"))
        depth += 1
    if more:
        changes = more[0]
        for x in more[1:]:
            changes = changes.union(x)
        changes = changes.groupBy("block", "doc").agg(F.sum("change").alias("change"))
        scores = scores.join(changes, ["block", "doc"], "left").withColumn("score", F.col("score") + F.coalesce("change", F.lit(0.0)))
    return scores.select(F.col("id").cast(kind).alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
