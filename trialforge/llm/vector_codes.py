"""Vectors compressed to one code for each part, by integer codebooks and partial-distance search.

Components become floor(scale * x); vectors are cut into equal consecutive parts, and each part position has a codebook
that starts as the parts of the smallest ids. A round assigns every part to its nearest entry and moves each entry to
the floor of its parts' mean. nearest() searches as named: dimensions in descending variance over the codebook,
distances as integers, and masks over all (part, entry) pairs at once that drop an entry when its partial distance
strictly exceeds the best complete distance known so far; ties stay, and the lowest index wins.

What reaches the driver, and goes to the tasks again, is the codebooks and the sums of a round: entries * components
numbers, however many vectors there are. Rounds read a stored table of integers and sum before the shuffle.

Edge cases: rows are dropped whose vector is null, holds a null or non-finite component, or one with 28 bits or more
before scaling back (its squared distances would not fit a long), or has another length than the vector of the smallest
id. Empty vectors have codes of zeros. A null id is coded, but begins no codebook unless all ids are null; of rows that
share an id the smallest vector begins. With fewer ids than entries a codebook is shorter. Null labels are one group. A
length that is not a multiple of `parts` is an error. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.llm._common import released, stored

#: Integers of components have fewer bits than this.
BITS = 28
ROWS_AT_ONCE = 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows x (n, width) the index of the nearest entry of book (entries, width), and its squared distance."""
    n, width = x.shape
    if not n or not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-book.var(axis=0), kind="stable")
    distance = np.subtract.outer(x[:, order[0]], book[:, order[0]]) ** 2
    lead = distance.argmin(axis=1)
    best = ((x - book[lead]) ** 2).sum(axis=1)
    row, entry = np.nonzero(distance <= best[:, None])
    distance = distance[row, entry]
    for d in order[1:]:
        distance = distance + (x[row, d] - book[entry, d]) ** 2
        alive = distance <= best[row]
        row, entry, distance = row[alive], entry[alive], distance[alive]
        # The entry that leads by now is measured in full: a lower bound for what follows.
        lead = first_of(row, distance)
        best = np.minimum(best, ((x - book[entry[lead]]) ** 2).sum(axis=1))
    lead = first_of(row, distance)
    return entry[lead], distance[lead]


def first_of(row: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """For each row, the place of its first least distance. Rows are in order, each of 0, 1, ... at least once."""
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    spots = np.flatnonzero(distance == np.minimum.reduceat(distance, starts)[row])
    return spots[np.append(True, row[spots][1:] != row[spots][:-1])]


def matrices(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Where a block of the batch's rows begins, and its vectors as (rows, parts, width)."""
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, books.shape[0], books.shape[2])
    for a in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield a, flat[a : a + ROWS_AT_ONCE]


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label, x (array of int) of the vectors without a null, non-finite or too large component."""
    v = F.col(vector_col)
    fits = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(F.floor(e.cast("double") * scale).cast("double")) < 2.0**BITS))
    rows = vectors.where(v.isNotNull() & F.coalesce(fits, F.lit(False)))
    return rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(v, lambda e: F.floor(e.cast("double") * scale).cast("int")).alias("x"))


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors of the smallest ids. rows: stored, of one length."""
    some = rows.where("id is not null")
    ids = [r["id"] for r in some.select("id").distinct().orderBy("id").limit(entries).collect()]
    found = some.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("x").alias("x")).orderBy("id").collect() if ids else rows.orderBy("x").limit(entries).collect()
    return np.array([r["x"] for r in found], np.int64).reshape(len(found), parts, -1).transpose(1, 0, 2)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry at the floor of its parts' mean; entries that nothing is assigned to stay."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, x in matrices(batch, books):
                for p in range(parts):
                    code = nearest(x[:, p], books[p])[0]
                    order = np.argsort(code, kind="stable")
                    starts = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
                    used = code[order][starts]
                    total[p, used] += np.add.reduceat(x[order, p], starts, axis=0)
                    count[p, used] += np.diff(np.append(starts, len(code)))
        released()
        p, e = np.nonzero(count)
        spot = np.repeat(p * entries + e, width)
        dim = np.tile(np.arange(width), len(p))
        yield pa.RecordBatch.from_pydict({"entry": spot, "dim": dim, "n": np.repeat(count[p, e], width), "total": total[p, e].ravel()}, pa.schema([("entry", pa.int64()), ("dim", pa.int64()), ("n", pa.int64()), ("total", pa.int64())]))

    if not width:
        return books
    out = books.copy().reshape(parts * entries, width)
    told = rows.select("x").mapInArrow(sums, "entry long, dim long, n long, total long")
    for r in told.groupBy("entry", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["entry"], r["dim"]] = int(r["total"]) // r["n"]
    return out.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and place, with commas between them."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code, error of every row."""
    parts = books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            for a, x in matrices(batch, books):
                for p in range(parts):
                    code, distance = nearest(x[:, p], books[p])
                    codes[a : a + len(x), p] = code
                    error[a : a + len(x)] += distance
            text = codes.tobytes().hex()
            w = 2 * parts
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([text[w * i : w * i + w] for i in range(batch.num_rows)], pa.string()), pa.array(error)], ["id", "label", "code", "error"])
        released()

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """id, label, code (two hex digits a part), error, label_error of every vector that has a code, and the codebooks (parts, entries, width)."""
    if entries > 256:
        raise ValueError("a code has two hex digits")
    rows = stored(integers(vectors, id_col, vector_col, label_col, scale), "integers")
    least = rows.agg(F.coalesce(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "x")))["x"], F.min("x")).alias("x")).first()["x"]
    if least is None:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), np.zeros((parts, 0, 0), np.int64)
    if len(least) % parts:
        raise ValueError(f"vectors of {len(least)} components cannot be cut into {parts} equal parts")
    rows = rows.where(F.size("x") == len(least))
    books = first_books(rows, parts, entries)
    for _ in range(rounds):
        books = moved(rows, books)
    told = stored(coded(rows, books), "codes")
    by_label = stored(told.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "_label")
    return told.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left").select("id", "label", "code", "error", "label_error"), books
