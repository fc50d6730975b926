"""Row pattern A (D+ U+)+ P over ordered rows, by a reverse scan with monotonic stacks.

A is any row with a number; D has a lower, U a higher number than the row before; P has at least A's number, the goal.
D, U and P must follow the row before within a gap, and have flags of their own. D and U exclude each other, so a body
(D+ U+)+ is told by its end alone. Three endings:

* "optional", P?: the longest body, then P if the next row is one.
* "greedy", P: the longest body that a P follows, as backtracking finds it, so the last P.
* "reluctant", (D+ U+?)+? P: the shortest body that a P follows, so the first P.

Rows are scanned from the last to the first. The rows that may be P (they follow a U) stand on two stacks that a break,
a row that is neither D nor U, empties: suffix-maximum records, on which bisection finds the last row that reaches a
goal, and next-greater-or-equal candidates, on which bisection finds the first. So each start costs a logarithm.

Rows are dealt by key and order into ranges of about RANGE_ROWS rows, so a key of any size is many tasks. A range answers
all starts whose run of D and U ends inside it, and hands on its edges: the rows before its first break and after its
last one. A window over the edges (a row for each range and end) tells which edges one run joins; the starts of an
edge are answered where it is, from it and the edges that its run goes on in. A run over m ranges is sent to each of
them, since each match's digest has to read all its letters. Matches are numbered in their range; the counts of the
ranges before are joined on for keys that began in an earlier one. No key goes to one task, nothing to the driver.

Edge cases: rows with a null key or a null first order column are dropped, and so are repeated rows (equal in all
columns); a null number fits no letter, and a non-finite one or one beyond a long counts as null; null flags are false;
null ids come first in the order and are null in the result; rows that share key and order are taken in the order of
number and flags; a key with one row has no match; an empty table gives no rows. Columns with other names only tell
whether rows are repeated.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trialforge.llm._common import released, stored

RANGE_ROWS = 400_000
ENDINGS = ("optional", "greedy", "reluctant")
#: Bits of a row's code: 1 it is D, 2 it is U, 4 it may be P but for the goal, 8 its id is null, 16 its number is null.
D, U, READY, NO_ID, NO_NUMBER = 1, 2, 4, 8, 16
PIECE = "struct<ids: binary, numbers: binary, codes: binary>"
MATCH = "key {key}, part int, no long, first_id long, last_id long, n_rows long, total long, sha binary, carried boolean"
EDGE = (
    "struct<rows: long, found: long, head: boolean, tail: boolean, whole: boolean, first_at: long, first_number: long, first_move: boolean, first_close: boolean,"
    f" last_at: long, last_number: long, front: {PIECE}, back: {PIECE}>"
)
LETTER = np.frombuffer(b"?DU?", np.uint8)
#: Digests of strings up to this length are remembered, and how many.
SHORT, MEMORY = 48, 50_000


def reverse_scan(codes: list[int], numbers: list[int], ending: str, begin: int = 0, stop: int | None = None) -> tuple[list[int], list[int], list[bool]]:
    """First row, last row, and whether the last one is P, of the match at each start in [begin, stop) that has one; latest start first."""
    firsts, lasts, ended = [], [], []
    high, high_at = [], []  # suffix-maximum records, the last row first: numbers rise
    near, near_at = [], []  # next-greater-or-equal candidates, the nearest row last: numbers, negated, rise
    end, after = -1, 0  # the run's last U, and the code of the row after the present one
    stop = len(codes) if stop is None else stop
    for i in range(len(codes) - 1, begin - 1, -1):
        code = codes[i]
        if after & D and end > i + 1 and i < stop and not code & NO_NUMBER:
            if ending == "reluctant":
                k = bisect_right(near, -numbers[i]) - 1
                at = near_at[k] if k >= 0 else -1
            else:
                k = bisect_left(high, numbers[i])
                at = high_at[k] if k < len(high) else -1
            if ending == "optional":
                firsts.append(i)
                lasts.append(end + 1 if at == end + 1 else end)
                ended.append(at == end + 1)
            elif at >= 0:
                firsts.append(i)
                lasts.append(at)
                ended.append(True)
        if code & U:
            if end < 0:
                end = i
            if after & READY:
                goal = numbers[i + 1]
                if not high or goal > high[-1]:
                    high.append(goal)
                    high_at.append(i + 1)
                while near and -near[-1] <= goal:
                    near.pop()
                    near_at.pop()
                near.append(-goal)
                near_at.append(i + 1)
        elif not code & D:
            if high:
                high, high_at, near, near_at = [], [], [], []
            end = -1
        after = code
    return firsts, lasts, ended


_digests: dict[bytes, bytes] = {}


def digest(text: bytes) -> bytes:
    """SHA-256; those of short strings are remembered."""
    if len(text) > SHORT:
        return hashlib.sha256(text).digest()
    if (found := _digests.get(text)) is None:
        if len(_digests) >= MEMORY:
            _digests.clear()
        found = _digests[text] = hashlib.sha256(text).digest()
    return found


def matches(codes: np.ndarray, numbers: np.ndarray, ending: str, stop: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """First row, last row, sum of numbers and digest of the letters of each match that starts before `stop`, earliest first."""
    first, last, ended = reverse_scan(codes.tolist(), numbers.tolist(), ending, 0, stop)
    first.reverse(), last.reverse(), ended.reverse()
    letters = LETTER[codes & 3].tobytes()
    shas = [digest(b"A" + letters[a + 1 : b] + b"P" if p else b"A" + letters[a + 1 : b + 1]) for a, b, p in zip(first, last, ended, strict=True)]
    first, last = np.array(first, np.int64), np.array(last, np.int64)
    total = np.append(0, np.cumsum(numbers))
    return first, last, total[last + 1] - total[first], shas


def coded(same: np.ndarray, at: np.ndarray, numbers: np.ndarray, no_number: np.ndarray, no_id: np.ndarray, move: np.ndarray, close: np.ndarray, gap_us: int) -> np.ndarray:
    """Codes of consecutive rows. What the first row is depends on rows not seen here: it gets none of D, U and READY."""
    near = (same[1:] == same[:-1]) & (at[1:] - at[:-1] <= gap_us) & ~no_number[1:]
    moves = near & move[1:] & ~no_number[:-1]
    codes = (no_id * NO_ID + no_number * NO_NUMBER).astype(np.uint8)
    codes[1:] += (moves & (numbers[1:] < numbers[:-1])) * np.uint8(D) + (moves & (numbers[1:] > numbers[:-1])) * np.uint8(U) + (near & close[1:]) * np.uint8(READY)
    return codes


def column_of(rows: pa.Table, name: str, null: int | bool) -> tuple[np.ndarray, np.ndarray]:
    """A column with another value for null, and where it is null."""
    column = rows.column(name)
    return pc.fill_null(column, null).to_numpy(), column.is_null().to_numpy()


def match_batch(keys: pa.Array, part: int, no: np.ndarray, found: tuple, ids: np.ndarray, codes: np.ndarray, carried: np.ndarray) -> pa.RecordBatch:
    """Rows of matches; keys holds a key for each."""
    first, last, total, shas = found
    ids_of = lambda spots: pa.array(ids[spots], mask=(codes[spots] & NO_ID).astype(bool))
    columns = [keys, pa.array(np.full(len(first), part, np.int32)), pa.array(no), ids_of(first), ids_of(last), pa.array(last - first + 1), pa.array(total), pa.array(shas, pa.binary()), pa.array(carried)]
    return pa.RecordBatch.from_arrays(columns, ["key", "part", "no", "first_id", "last_id", "n_rows", "total", "sha", "carried"])


def scanned(rows: DataFrame, gap_us: int, ending: str) -> DataFrame:
    """Matches that are settled inside their range (edge is null), and the edges of each range. rows: key, at, id, number, move, close, in ranges and in order."""
    schema = MATCH.format(key=dict(rows.dtypes)["key"]) + f", edge {EDGE}"
    edge_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        rows, part = pa.Table.from_batches(found).combine_chunks(), TaskContext.get().partitionId()
        keys, n = rows.column("key").chunk(0), rows.num_rows
        same, at = keys.dictionary_encode().indices.to_numpy(), rows.column("at").to_numpy()
        (ids, no_id), (numbers, no_number) = column_of(rows, "id", 0), column_of(rows, "number", 0)
        move, close = column_of(rows, "move", False)[0], column_of(rows, "close", False)[0]
        codes = coded(same, at, numbers, no_number, no_id, move, close, gap_us)
        breaks = np.flatnonzero(codes & (D | U) == 0)
        new = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
        after, before = int(new[1]) if len(new) > 1 else n, int(new[-1])  # where the first key ends, and the last one begins
        settled = matches(codes, numbers, ending, int(breaks[-1]))  # starts from the last break on may go on in the next range
        first = settled[0]
        no = np.arange(1, len(first) + 1) - np.searchsorted(first, new)[np.searchsorted(new, first, "right") - 1]
        batch = match_batch(keys.take(pa.array(first)), part, no, settled, ids, codes, first < after)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(len(first), edge_schema.field("edge").type)], edge_schema.names)

        def piece(a: int, b: int) -> dict:
            return {"ids": ids[a:b].tobytes(), "numbers": numbers[a:b].tobytes(), "codes": codes[a:b].tobytes()}

        def edge(a: int, b: int) -> dict:
            own = breaks[(breaks > a) & (breaks < b)]
            head, tail, whole = a == 0, b == n, not len(own)
            ends = {"first_at": at[a], "first_number": None if no_number[a] else numbers[a], "first_move": move[a], "first_close": close[a], "last_at": at[b - 1], "last_number": None if no_number[b - 1] else numbers[b - 1]}
            ends = {k: v if v is None else v.item() for k, v in ends.items()}
            front = piece(a, b if whole else int(own[0]) + 1) if head else None
            back = piece(a if whole else int(own[-1]), b) if tail and not (whole and head) else None
            found = int(np.searchsorted(first, b) - np.searchsorted(first, a))
            return {"key": keys[a].as_py(), "part": part, "edge": {"rows": b - a, "found": found, "head": head, "tail": tail, "whole": whole, "front": front, "back": back} | ends}

        yield pa.RecordBatch.from_pylist([edge(a, b) for a, b in sorted({(0, after), (before, n)})], edge_schema)
        released()

    return rows.mapInArrow(run, schema)


def continued(edges: DataFrame, gap_us: int) -> DataFrame:
    """Edges in the order of their key, with what the first row is after the range before, and which run they are of. A run's number rises where an edge has a break, so that what follows an edge's last break has its `chain`, and what comes up to its first one the `chain` of the edge before."""
    ordered = Window.partitionBy("key").orderBy("part")
    near = F.coalesce((F.col("first_at") - F.lag("last_at").over(ordered) <= gap_us) & F.col("first_number").isNotNull(), F.lit(False))
    before = F.lag("last_number").over(ordered)
    letter = F.when(near & F.col("first_move"), F.when(F.col("first_number") < before, D).when(F.col("first_number") > before, U))
    out = edges.withColumn("letter", F.coalesce(letter, F.lit(0))).withColumn("first_code", F.col("letter") + F.when(near & F.col("first_close"), READY).otherwise(0))
    out = out.withColumn("chain", F.sum(F.when(~F.col("whole") | (F.col("letter") == 0), 1).otherwise(0)).over(ordered))
    return out.withColumn("head_chain", F.lag("chain").over(ordered))


def stitched(edges: DataFrame, ending: str) -> DataFrame:
    """Matches that start after the last break of a range. edges: of continued(), stored."""
    rest = edges.where("head and head_chain is not null").groupBy("key", F.col("head_chain").alias("chain")).agg(F.sort_array(F.collect_list(F.struct("part", "first_code", "front"))).alias("rest"))
    starts = edges.where("tail").select("key", "chain", "part", "found", F.coalesce("back", "front").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.select(["part", "found", "own", "rest"]).to_pylist()):
                pieces = [(row["own"], 0), *((x["front"], x["first_code"]) for x in row["rest"] or [] if x["part"] > row["part"])]
                ids, numbers = (np.frombuffer(b"".join(x[c] for x, _ in pieces), np.int64) for c in ("ids", "numbers"))
                codes = [np.frombuffer(x["codes"], np.uint8).copy() for x, _ in pieces]
                for c, (_, first) in zip(codes, pieces, strict=True):
                    c[0] |= first
                stop, codes = len(codes[0]), np.concatenate(codes)
                found = matches(codes, numbers, ending, stop)
                n = len(found[0])
                keys = batch.column("key").take(pa.array(np.full(n, k)))
                yield match_batch(keys, row["part"], row["found"] + np.arange(1, n + 1), found, ids, codes, np.ones(n, bool))
        released()

    return starts.join(rest.hint("merge"), ["key", "chain"], "left").mapInArrow(run, MATCH.format(key=dict(edges.dtypes)["key"]))


def micros(rows: DataFrame, at: str) -> Column:
    """A timestamp in microseconds; one without a zone as it stands, whatever the session's zone."""
    if dict(rows.dtypes)[at] == "timestamp_ntz":
        seconds = F.unix_date(F.to_date(at)).cast("long") * 86_400 + F.hour(at) * 3600 + F.minute(at) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), F.col(at)) * 1_000_000).cast("long")
    return F.unix_micros(F.col(at).cast("timestamp"))


def zigzags(rows: DataFrame, key: str, at: str, row_id: str, number: Column, move: Column, close: Column, gap_us: int = 1_800_000_000, ending: str = "optional") -> DataFrame:
    """key, match_no, first_id, last_id, n_rows, total, labels_sha256 of every match, found from each start apart.

    at: the first order column, a timestamp; row_id: the second, a number. number: Column of longs; move, close: whether
    a row may be D or U, and P.
    """
    if ending not in ENDINGS:
        raise ValueError(f"ending must be one of {ENDINGS}")
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    own = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).distinct()
    own = own.select(F.col(key).alias("key"), micros(rows, at).alias("at"), F.col(row_id).cast("long").alias("id"), number.alias("number"), move.alias("move"), close.alias("close"))
    own = own.repartitionByRange(n, "key", "at", "id").sortWithinPartitions("key", "at", "id", "number", "move", "close")
    told = stored(scanned(own, gap_us, ending), "matches")
    edges = stored(continued(told.where("edge is not null").select("key", "part", "edge.*"), gap_us), "edges", large_rows=True)
    more = stored(stitched(edges, ending), "joined", large_rows=True)
    counted = edges.select("key", "part", "found").join(more.groupBy("key", "part").agg(F.count("*").alias("joined")).hint("merge"), ["key", "part"], "left")
    before = F.sum(F.col("found") + F.coalesce("joined", F.lit(0))).over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stored(counted.select("key", "part", before.alias("before")).where("before > 0"), "offsets")
    settled = told.where("edge is null").drop("edge")
    carried = settled.where("carried").unionByName(more).join(offsets.hint("merge"), ["key", "part"], "left").withColumn("no", F.col("no") + F.coalesce("before", F.lit(0))).drop("before")
    out = settled.where("not carried").unionByName(carried)
    return out.select(F.col("key").alias(key), F.col("no").alias("match_no"), "first_id", "last_id", "n_rows", "total", F.lower(F.hex("sha")).alias("labels_sha256"))


def cents(value: Column) -> Column:
    """floor(100 * value + 0.5) as a long; null for null, non-finite values and those beyond a long."""
    x = F.floor(value.cast("double") * 100 + 0.5)
    return F.when(F.abs(value.cast("double") * 100) < 2.0**62, x)
