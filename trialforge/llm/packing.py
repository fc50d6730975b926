"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of documents, each document its token ids and one end id. Windows of `window` sequences are
filled by going round the queues: a queue's credit for a window is its target share of the window, it spends whole
tokens only, and what is left of its credit (its deficit) is carried to the next window. So after any number of
windows a queue has spent its exact credit, rounded, and the point where each window's turn begins in each queue has a
closed form (Schedule). Every partition computes it alike for its own documents, with the tokens that lie before it in
each queue: deficits are carried across windows and across partitions without a sequential pass. A queue that runs dry
leaves its share to the others in proportion. The windows, end to end, are cut every `length` tokens; only the last
sequence can be short.

Targets default to the sources' own shares of all tokens, so that no queue runs dry before the end.

Edge cases: null text counts as empty (the end id alone); null sources form one queue; repeated rows are packed each;
an empty table gives no rows. With more sources than `max_queues`, those with a target and the largest half of
`max_queues` keep queues of their own; only the rest share queues, by hash, and within such a queue whole partitions of one
source follow another. Other columns are not read.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialforge.llm._common import as_text, held, pieces_of, raw_text, released, stored, words_in

#: Bytes of text handled at once, units remembered by a worker (about 30 bytes each), and units that are encoded together.
AT_ONCE, REMEMBERED, TOGETHER = 8_000_000, 1_000_000, 20_000
#: Characters for which normal forms, lower case and classes are plain: ASCII and the letters of Latin-1.
PLAIN = "^[\\x00-\\x7FÀ-ÖØ-öø-ÿ]*$"
#: The vocabulary's splitting pattern for lower-cased words of these, and its mark of a word's end.
UNIT = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"
WORD_END = "</w>"


class WordEncoder:
    """Ids of whole texts by a vocabulary that drops white space, in arrays.

    Texts are split at ASCII white space, and distinct words of plain characters into the units that the vocabulary
    encodes apart; other words, and those that hold a special string, stay whole. Units are encoded many at a time and remembered,
    the ones used most if there are too many, and texts put together from them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        # Units are normal, in lower case and split already: what is left of the library's work is bytes and merges.
        split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.merger = Tokenizer.from_str(json.dumps({**spec, "normalizer": None, "pre_tokenizer": split, "added_tokens": []}))
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for w, i in spec["model"]["vocab"].items() if w.endswith(WORD_END)]] = True
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.mark = self.tokenizer.token_to_id(self.specials[0]) if self.specials else None
        self.known, self.uses = pa.array([], pa.large_string()), np.zeros(0, np.int64)
        self.ids = pa.LargeListArray.from_arrays(pa.array([0], pa.int64()), pa.array([], pa.from_numpy_dtype(self.kind)))

    def library(self, texts: list[str], merger: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and how many each has."""
        ids = [e.ids for e in (self.merger if merger else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), self.kind), np.fromiter(map(len, ids), np.int64, len(ids))

    def of_plain(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units with a space between them: each ends with the one id that marks a word's end."""
        ids = self.library([" ".join(units)], merger=True)[0]
        stops = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(stops, prepend=0)) if len(stops) == len(units) and stops[-1] == len(ids) else self.library(units)

    def of_others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of any characters, with a special string between them, whose id stands between theirs."""
        if not self.specials:
            return self.library(words)
        ids = self.library([self.specials[0].join(words)])[0]
        marks = ids == self.mark
        at = np.flatnonzero(marks)
        return (ids[~marks], np.diff(at - np.arange(len(at)), prepend=0, append=len(ids) - len(at))) if len(at) == len(words) - 1 else self.library(words)

    def is_plain(self, words: pa.Array) -> np.ndarray:
        out = pc.string_is_ascii(words).to_numpy(zero_copy_only=False).copy()
        rest = np.flatnonzero(~out)
        out[rest] = pc.match_substring_regex(words.take(pa.array(rest)), PLAIN).to_numpy(zero_copy_only=False)
        return out

    def is_special(self, words: pa.Array) -> np.ndarray:
        """Whether words hold a special string."""
        out = np.zeros(len(words), bool)
        for x in self.specials:
            out |= pc.match_substring(words, x).to_numpy(zero_copy_only=False)
        return out

    def learn(self, units: pa.Array) -> np.ndarray:
        """Places of the units among the known ones, after those that were not known are encoded."""
        at = pc.index_in(units, self.known)
        at, unknown = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        if len(unknown):
            new = units.take(pa.array(unknown))
            plain, special = self.is_plain(new), self.is_special(new)
            words, lists, free = [self.known], [self.ids], len(self.known)
            for mask, encode in ((plain & ~special, self.of_plain), (~plain & ~special, self.of_others), (special, self.library)):
                own = np.flatnonzero(mask)
                for a in range(0, len(own), TOGETHER):
                    some = own[a : a + TOGETHER]
                    words.append(part := new.take(pa.array(some)))
                    ids, sizes = encode(part.to_pylist())
                    lists.append(pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes))), pa.array(ids)))
                    at[unknown[some]] = free + np.arange(len(some))
                    free += len(some)
            self.known, self.ids = pa.concat_arrays(words), pa.concat_arrays(lists)
            self.uses = np.append(self.uses, np.zeros(len(new), np.int64))
        self.uses[at] += 1
        return at

    def trim(self) -> None:
        if len(self.known) > REMEMBERED:
            keep = pa.array(np.sort(np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2]))
            self.known, self.ids, self.uses = self.known.take(keep), self.ids.take(keep), self.uses[keep.to_numpy()] // 2

    def of_words(self, words: pa.Array) -> pa.Array:
        """The ids of each distinct word."""
        words = words.cast(pa.large_string())
        plain = pa.array(self.is_plain(words) & ~self.is_special(words))
        lower = pc.if_else(plain, pc.utf8_lower(words), words)
        mixed = pc.and_(plain, pc.invert(pc.ascii_is_alpha(words)))
        spaced = pc.if_else(plain, lower, pa.scalar("", pa.large_string()))
        spaced = pc.replace_with_mask(spaced, mixed, pc.ascii_rtrim_whitespace(pc.replace_substring_regex(lower.filter(mixed), UNIT, "\\1 ")))
        # What isn't plain is a unit of its own and may hold any character, so it is not split.
        split = pc.ascii_split_whitespace(spaced)
        starts, units = split.offsets.to_numpy().astype(np.int64), pc.replace_with_mask(split.values, self.at_starts(split, plain), words.filter(pc.invert(plain)))
        coded = units.dictionary_encode()
        self.trim()
        at = self.learn(coded.dictionary)
        ids = self.ids.take(pa.array(at[coded.indices.to_numpy()]))
        return pa.LargeListArray.from_arrays(pa.array(ids.offsets.to_numpy()[starts]), ids.values)

    @staticmethod
    def at_starts(split: pa.Array, plain: pa.Array) -> pa.Array:
        """Of the split values, the single ones that stand for words that aren't plain."""
        mask = np.zeros(len(split.values), bool)
        mask[split.offsets.to_numpy()[:-1][~plain.to_numpy(zero_copy_only=False)]] = True
        return pa.array(mask)

    def __call__(self, raw: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (bytes), one after the other, each followed by `end` if given, and where they begin (and, last, how many there are)."""
        try:
            text = as_text(raw.cast(pa.large_string()))
        except pa.ArrowInvalid:
            text = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())
        index, starts, words = words_in(text)
        ids = self.of_words(words).take(pa.array(index))
        flat, bounds = ids.values.to_numpy(), ids.offsets.to_numpy()[starts]
        if end is not None:
            flat = np.insert(flat, bounds[1:], self.kind.type(end))
            bounds = bounds + np.arange(len(bounds))
        return flat, bounds


def running(sums: DataFrame, lane: str = "lane") -> DataFrame:
    """lane, part, before: the tokens of a lane in earlier parts. Groups of 1,024 parts are added up first, so no task sees all parts of a lane."""
    far = sums.withColumn("far", F.shiftright("part", 10))
    inner = far.withColumn("inner", F.sum("n").over(Window.partitionBy(lane, "far").orderBy("part")) - F.col("n"))
    whole = far.groupBy(lane, "far").agg(F.sum("n").alias("m"))
    outer = whole.select(lane, "far", (F.sum("m").over(Window.partitionBy(lane).orderBy("far")) - F.col("m")).alias("outer"))
    return inner.join(outer, [lane, "far"]).select(lane, "part", (F.col("inner") + F.col("outer")).alias("before"))


def encoded(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", queue: Column | None = None) -> DataFrame:
    """part (the partition that encoded it), id, queue, start (tokens of its queue before it in its part), n, ids of every row; ids have 16 bits each if that is enough for the vocabulary, else 32."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(WordEncoder, vocabulary)
        part, totals = TaskContext.get().partitionId() if TaskContext.get() else 0, Counter()
        for x in batches:
            done = 0
            for raw in pieces_of(x.column("raw"), AT_ONCE):
                own = x.slice(done, len(raw))
                done += len(raw)
                flat, bounds = encoder(raw, end_id)
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer((bounds * encoder.kind.itemsize).astype(np.int64)), pa.py_buffer(flat)])
                n = np.diff(bounds)
                coded = own.column("queue").dictionary_encode()
                which, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                order = np.argsort(which, kind="stable")
                within = np.cumsum(n[order]) - n[order]
                sums = np.bincount(which, n, len(names)).astype(np.int64)
                first = np.cumsum(sums) - sums  # of each queue, in that order
                start = np.empty(len(n), np.int64)
                start[order] = within + (np.array([totals[q] for q in names], np.int64) - first)[which[order]]
                totals.update(dict(zip(names, sums.tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int64)), own.column("id"), own.column("queue"), pa.array(start), pa.array(n.astype(np.int64)), ids.cast(pa.binary())], ["part", "id", "queue", "start", "n", "ids"])
        released()

    rows = docs.select(F.col(id_col).alias("id"), queue.alias("queue"), raw_text(F.col(text_col)).alias("raw"))
    return rows.mapInArrow(run, f"part long, id {kind}, queue string, start long, n long, ids binary")


class Schedule:
    """Where each window's turn begins in each queue.

    A phase lasts until a queue runs dry; within it the tokens spent by a queue grow linearly with all tokens spent.
    """

    def __init__(self, totals: list[int], targets: list[float], window: int):
        t, w = np.array(totals, np.float64), np.array(targets, np.float64)
        self.totals, self.window_tokens = np.array(totals, np.int64), window
        starts, spent, rates = [], [], []
        at, done = 0.0, np.zeros(len(t))
        open_ = t > 0
        while open_.any():
            share = np.where(open_, w, 0.0)
            share = share / share.sum() if share.sum() > 0 else np.where(open_, t - done, 0) / (t - done)[open_].sum()
            lasts = np.where(share > 0, (t - done) / np.where(share > 0, share, 1), np.inf)
            length = lasts[open_].min()
            starts.append(at), spent.append(done), rates.append(share)
            at, done = at + length, np.where(lasts <= length * (1 + 1e-12), t, done + share * length)
            open_ = open_ & (done < t)
        self.starts, self.spent, self.rates = np.array(starts), np.array(spent).reshape(-1, len(t)), np.array(rates).reshape(-1, len(t))
        self.windows = max(1, -(-int(self.totals.sum()) // window))
        self.edge = lru_cache(4096)(self._edge)
        self.turn = lru_cache(4096)(self._turn)

    def _edge(self, w: int) -> np.ndarray:
        """Tokens that each queue has spent before window w."""
        if w >= self.windows:
            return self.totals
        at = float(w) * self.window_tokens
        p = max(0, int(np.searchsorted(self.starts, at, "right")) - 1)
        return np.minimum(np.rint(self.spent[p] + self.rates[p] * (at - self.starts[p])).astype(np.int64), self.totals)

    def _turn(self, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of window w: where each queue's part begins and ends in the queue, and where it begins in the packed stream."""
        low, high = self.edge(w), self.edge(w + 1)
        part = high - low
        return low, high, int(low.sum()) + np.cumsum(part) - part

    def window_of(self, queue: int, token: int) -> int:
        p = max(0, int(np.searchsorted(self.spent[:, queue], token, "right")) - 1)
        rate = self.rates[p, queue]
        w = min(self.windows - 1, int((self.starts[p] + ((token - self.spent[p, queue]) / rate if rate > 0 else 0)) // self.window_tokens))
        while w > 0 and self.edge(w)[queue] > token:
            w -= 1
        while w < self.windows - 1 and self.edge(w + 1)[queue] <= token:
            w += 1
        return w

    def pieces(self, queue: int, start: int, n: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """start in the document, tokens, sequence, offset of the pieces of a document that begins at `start` of its queue."""
        done, w = 0, self.window_of(queue, start)
        while done < n:
            low, high, place = self.turn(w)
            at = start + done
            take = min(n - done, int(high[queue]) - at)
            where = int(place[queue]) + at - int(low[queue])
            while take > 0:
                now = min(take, length - where % length)
                yield done, now, where // length, where % length
                done, where, take = done + now, where + now, take - now
            w += 1


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, length: int = 4096, window: int = 64, targets: dict[str, float] | None = None, max_queues: int = 512, id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source") -> DataFrame:
    """id, source, start, length, doc_tokens, sequence_id, offset and ids (binary, little-endian 32 bits each) of every piece.

    targets: wished share of tokens for each source; sources that it lacks get what share they have of all tokens.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    queue = F.coalesce(F.concat(F.lit("="), F.col(queue_col).cast("string")), F.lit(""))
    blocks = stored(encoded(docs, vocabulary, end_id, id_col, text_col, queue), "encoded", large_rows=True, rows=1_000)
    names = blocks.groupBy("queue").agg(F.sum("n").alias("n"))
    if names.limit(max_queues + 1).count() > max_queues:
        wanted = [f"={t}" if t is not None else "" for t in targets or {}]
        largest = names.where(~F.col("queue").isin(wanted)).orderBy(F.desc("n"), "queue").limit(max_queues // 2).collect()
        own = F.col("queue").isin([*wanted, *(r["queue"] for r in largest)])
        shared = F.concat(F.lit("#"), F.pmod(F.xxhash64("queue"), F.lit(max_queues - max_queues // 2)).cast("string"))
        blocks = blocks.withColumn("lane", F.when(own, F.col("queue")).otherwise(shared))
        # Queues that share a lane follow one another within a part.
        sums = blocks.groupBy("part", "lane", "queue").agg(F.sum("n").alias("n"))
        inner = F.sum("n").over(Window.partitionBy("part", "lane").orderBy("queue")) - F.col("n")
        shift = sums.select("part", "queue", inner.alias("inner"))
        blocks = stored(blocks.join(shift, ["part", "queue"]).select("part", "id", "queue", "lane", (F.col("start") + F.col("inner")).alias("start"), "n", "ids"), "lanes")
    else:
        blocks = blocks.withColumn("lane", F.col("queue"))
    sums = blocks.groupBy("lane", "part").agg(F.sum("n").alias("n"))
    before = stored(running(sums), "offsets")  # one row for each lane and partition
    lanes = sorted((r["lane"], r["n"]) for r in sums.groupBy("lane").agg(F.sum("n").alias("n")).collect())  # max_queues rows and one for each target at most
    total = sum(n for _, n in lanes)
    wished = [n / total if name.startswith("#") else (targets or {}).get(name[1:] if name else None, n / total) for name, n in lanes]
    number, totals = {name: i for i, (name, _) in enumerate(lanes)}, [n for _, n in lanes]
    width = held(WordEncoder, vocabulary).kind.itemsize

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        schedule = Schedule(totals, wished, window * length)
        for x in batches:
            out = []
            for id_, queue, lane, first, n, ids in zip(x["id"], x["queue"], x["lane"], x["at"], x["n"], x["ids"], strict=True):
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                source = queue[1:] if queue else None
                out += [(id_, source, s, k, n, q, o, wide[4 * s : 4 * (s + k)]) for s, k, q, o in schedule.pieces(number[lane], first, n, length)]
            yield pd.DataFrame(out, columns=["id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
        released()

    rows = blocks.join(before, ["lane", "part"]).select("id", "queue", "lane", (F.col("before") + F.col("start")).alias("at"), "n", "ids")
    out = rows.mapInPandas(place, f"id {kind}, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("id", id_col) if lanes else spark.createDataFrame([], out.schema).withColumnRenamed("id", id_col)
