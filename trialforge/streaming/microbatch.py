"""Micro-batching, rate limits and incremental work over streams, with batch twins that give the same rows.

The streams are Structured Streaming queries over file sources; windows are by event time, so that a run can be repeated.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from time import sleep as pause

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from trialforge.operators import prefix
from trialforge.operators.matching import chunked


def flushes(requests: DataFrame, key: str, window_us: int, max_batch: int, time: str = "ts_us", order: str = "request_id") -> DataFrame:
    """requests with slot and batch: a batch is flushed when it is full, or when its window (of event time) ends."""
    rows = requests.withColumn("slot", F.expr(f"{time} div {window_us}"))
    n = F.row_number().over(Window.partitionBy(key, "slot").orderBy(time, order))
    return rows.withColumn("batch", F.floor((n - 1) / max_batch).cast("long"))


def flush_log(batched: DataFrame, key: str) -> DataFrame:
    """key, slot, batch, size of each flush."""
    return batched.groupBy(key, "slot", "batch").agg(F.count("*").alias("size"))


def flush_stats(log: DataFrame, key: str) -> DataFrame:
    """key: flushes, requests, mean, smallest and largest size, percent of requests in batches of two or more."""
    return log.groupBy(key).agg(F.count("*").alias("flushes"), F.sum("size").alias("requests"), F.avg("size").alias("mean_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), (100 * F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0)) / F.sum("size")).alias("batched_pct"))


def countdown(time, window_us: int):
    """Microseconds to the next flush."""
    return F.lit(window_us) - F.pmod(time, F.lit(window_us))


def windowed_counts(events: DataFrame, key: str, window: str, late: str, time: str = "ts") -> DataFrame:
    """key, start, n, total of each event-time window; on a stream, rows later than `late` are left out."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.unix_micros("w.start").alias("start_us"), "n", "total")


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs handle(batch, id) over all that is there, remembering what was done in `checkpoint`; an id handled again after a failure is the same batch."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@dataclass
class Limits:
    """Requests and tokens per minute. A bucket holds a minute's worth and refills steadily."""

    rpm: float
    tpm: float

    def scaled(self, rpm: float) -> Limits:
        """Limits for another rpm, tokens in proportion."""
        return Limits(rpm, self.tpm * rpm / self.rpm)


def _waits(limits: Limits, state: tuple[float, float, float] | None, rows: pd.DataFrame) -> tuple[list[float], tuple[float, float, float]]:
    """Seconds each request waits, in order; state: requests and tokens left, and the time they hold for."""
    out = []
    r, t, now = state or (limits.rpm, limits.tpm, float(rows["at"].iloc[0]))
    for at, tokens in zip(rows["at"], rows["tokens"], strict=True):
        at, tokens = max(float(at), now), min(float(tokens), limits.tpm)
        r, t, now = min(limits.rpm, r + (at - now) * limits.rpm / 60), min(limits.tpm, t + (at - now) * limits.tpm / 60), at
        wait = max(0.0, (1 - r) * 60 / limits.rpm, (tokens - t) * 60 / limits.tpm)
        r, t, now = min(limits.rpm, r + wait * limits.rpm / 60) - 1, min(limits.tpm, t + wait * limits.tpm / 60) - tokens, now + wait
        out.append(now)
    return out, (r, t, now)


def _parts(frames: Iterable[pd.DataFrame], by: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Rows of frames that are sorted by `by`, frame by frame: each with one value of `by` only."""
    for x in frames:
        new = pd.Series(False, x.index)
        for c in by:
            new |= ~((x[c] == x[c].shift()) | (x[c].isna() & x[c].shift().isna()))
        for _, own in x.groupby(new.cumsum(), sort=False):
            yield tuple(None if pd.isna(v) else v for v in own[by].iloc[0]), own


def _passage(limits: Limits, rows: Iterable[tuple[float, float]], at0: float, state: list[list[float]] | None = None) -> list[list[float]]:
    """What requests make of any state before them. A state is three times since at0: of the last grant, and when the
    requests and the tokens would be full again. Each after the rows is the largest of a time and the three before, each
    with a wait added: rows of four numbers. A bucket holds a minute, so a request of cost c, which takes b = 60 c / limit
    seconds to fill, is granted when its bucket would be full in 60 - b seconds."""
    none = float("-inf")
    last, full, tokens_full = state or ([none, 0.0, none, none], [none, none, 0.0, none], [none, none, none, 0.0])
    b, least = 60 / limits.rpm, max(0.0, 60 / limits.rpm - 60)
    for at, tokens in rows:
        c = min(tokens, limits.tpm) * 60 / limits.tpm
        for j in range(4):
            begun = max(last[j], at - at0) if j == 0 else last[j]
            granted = max(begun + least, full[j] + b - 60, tokens_full[j] + c - 60)
            last[j], full[j], tokens_full[j] = granted, max(full[j], granted) + b, max(tokens_full[j], granted) + c
    return [last, full, tokens_full]


def _entries(limits: Limits, ranges: pd.DataFrame) -> list[tuple[float, float, float]]:
    """_waits()' state before each range of a key, in order; ranges: at0 and the passage through each, one after the other."""
    out, state = [], None
    for at0, passage in zip(ranges["at0"], ranges["passage"], strict=True):
        since = [0.0, *([float("-inf")] * 3 if state is None else [x - at0 for x in state])]
        if state is None:
            out.append((limits.rpm, limits.tpm, at0))
        else:
            last, full, tokens_full = state
            out.append((limits.rpm - max(0.0, full - last) * limits.rpm / 60, limits.tpm - max(0.0, tokens_full - last) * limits.tpm / 60, last))
        state = [at0 + max(m + v for m, v in zip(passage[4 * i : 4 * i + 4], since, strict=True)) for i in range(3)]
    return out


def rate_limited(requests: DataFrame, limits: Limits, key: str = "key") -> DataFrame:
    """key, request_id, at, granted_at, waited: token buckets per key over requests (key, request_id, at in seconds, tokens), in order of at and request_id.

    Keys of many requests are cut into ranges of time. A first pass tells what each range makes of any state before it
    (_passage), and these few rows, one after the other, tell the state that each range begins with; so ranges are folded
    apart from each other. Rows go through Python batch by batch: no worker holds a range.
    """
    kind = requests.schema[key].dataType.simpleString()
    cut = prefix.ranged(requests.select(key, "request_id", "at", "tokens"), "at", [key])
    by = [key, "_range"]
    laid_out = lambda df: df.repartition(*by).sortWithinPartitions(*by, "at", "request_id")

    def passages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at0, state = None, 0.0, None
        told = lambda: pd.DataFrame({key: [now[0]], "_range": [now[1]], "at0": [at0], "passage": [[x for row in state for x in row]]})
        for group, x in _parts(frames, by):
            if group != now:
                if now is not None:
                    yield told()
                now, at0, state = group, float(x["at"].iloc[0]), None
            state = _passage(limits, zip(x["at"].tolist(), x["tokens"].tolist(), strict=True), at0, state)
        if now is not None:
            yield told()

    def entries(ranges: pd.DataFrame) -> pd.DataFrame:
        ranges = ranges.sort_values("_range")
        return pd.DataFrame({key: ranges[key], "_range": ranges["_range"], "entry": [list(e) for e in _entries(limits, ranges)]})

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for group, x in _parts(frames, by):
            if group != now:
                entry = x["entry"].iloc[0]
                now, state = group, None if entry is None else tuple(entry)
            granted, state = _waits(limits, state, x)
            yield pd.DataFrame({key: x[key], "request_id": x["request_id"], "at": x["at"], "granted_at": granted, "waited": [g - a for g, a in zip(granted, x["at"], strict=True)]})

    told = laid_out(cut.where("_cut")).mapInPandas(passages, f"{key} {kind}, _range int, at0 double, passage array<double>")
    begins = told.groupBy(key).applyInPandas(entries, f"{key} {kind}, _range int, entry array<double>")  # RANGES rows of a key at most
    begins = begins.select(F.col(key).alias("_lane0"), F.col("_range").alias("_r"), "entry")
    rows = cut.join(begins, prefix.same_lane([key]) & (F.col("_range") == F.col("_r")), "left").select(*by, "request_id", "at", "tokens", "entry")
    return laid_out(rows).mapInPandas(fold, f"{key} {kind}, request_id long, at double, granted_at double, waited double")


def rate_limited_stream(requests: DataFrame, limits: Limits, key: str = "key") -> DataFrame:
    """The same on a stream: a key's bucket is its state, kept from one micro-batch to the next."""
    kind = requests.schema[key].dataType.simpleString()

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(frames)).sort_values(["at", "request_id"], kind="stable")
        granted, after = _waits(limits, state.get if state.exists else None, x)
        state.update(after)
        yield pd.DataFrame({key: x[key], "request_id": x["request_id"], "at": x["at"], "granted_at": granted, "waited": [g - a for g, a in zip(granted, x["at"], strict=True)]})

    return requests.select(key, "request_id", "at", "tokens").groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, request_id long, at double, granted_at double, waited double", "r double, t double, now double", "append", "NoTimeout")


class Group:
    """Named streams that start in order and stop in reverse."""

    def __init__(self, spark: SparkSession):
        self.spark, self.queries = spark, {}

    def start(self, name: str, begin: Callable[[], StreamingQuery]) -> StreamingQuery:
        if name in self.queries:
            raise ValueError(f"there is a stream named {name}")
        self.queries[name] = begin()
        return self.queries[name]

    def stop(self) -> list[str]:
        order = list(reversed(self.queries))
        for name in order:
            self.queries.pop(name).stop()
        return order


def longest_delays(retries: int, base: float) -> list[float]:
    """Upper ends of the delays before each retry: they double; a delay is drawn evenly from 0 to its end."""
    return [base * 2**k for k in range(retries)]


def retried(call: Callable[[], list], retries: int, base: float, retryable: tuple[type[Exception], ...], draw: Callable[[float, float], float] = random.uniform, sleep: Callable[[float], None] = pause) -> tuple[list | None, Exception | None, int]:
    """What call() gives, or the exception it ended with, and the number of attempts. Only retryable exceptions are tried again."""
    ends = longest_delays(retries, base)
    for attempt in range(retries + 1):
        try:
            return call(), None, attempt + 1
        except retryable as e:
            if attempt == retries:
                return None, e, attempt + 1
            sleep(draw(0.0, ends[attempt]))
        except Exception as e:  # noqa: BLE001  (any other failure of the handler is the batch's at once)
            return None, e, attempt + 1
    raise AssertionError


def handled(rows: DataFrame, handler: Callable[[list], list], columns: list[str], out: str = "result", retries: int = 0, base: float = 1.0, retryable: tuple[type[Exception], ...] = (Exception,)) -> DataFrame:
    """rows of batches (key, slot, batch) put through a handler of lists, with `attempts`; an exception that is left after
    all retries, or results of another number, fails the whole batch."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(columns[-1], kind="stable")
        results, failure, attempts = retried(lambda: handler(x[columns[0]].tolist()), retries, base, retryable)
        error = f"{type(failure).__name__}: {failure}" if failure else None if len(results) == len(x) else f"{len(results)} results for {len(x)} items"
        return x.assign(**{out: [None] * len(x) if error else [str(r) for r in results], "error": error, "attempts": attempts})

    return rows.groupBy("key", "slot", "batch").applyInPandas(run, f"{schema}, {out} string, error string, attempts int")


def retry_log(log: DataFrame, failures, retries: int, base: float) -> DataFrame:
    """log of batches with attempts, exhausted and longest_wait (seconds), where a batch fails `failures` times before it succeeds."""
    waited = F.least(failures, F.lit(retries))
    return log.withColumn("attempts", waited + 1).withColumn("exhausted", failures > retries).withColumn("longest_wait", base * (F.pow(F.lit(2.0), waited) - 1))


def retry_stats(retried_log: DataFrame, key: str) -> DataFrame:
    """key: retries, exhausted batches, longest total wait."""
    return retried_log.groupBy(key).agg(F.sum(F.col("attempts") - 1).alias("retries"), F.count_if("exhausted").alias("exhausted"), F.sum("longest_wait").alias("longest_wait"))


def providers(responses: DataFrame, order: str) -> DataFrame:
    """One row of each provider and model: requests, tokens and cost so far, the limit that its first response told (later ones don't change it), and its last state.

    responses: provider, model, tokens, cost, told_limit (null if a response tells none), state.
    """
    first = F.min_by(F.col("told_limit"), F.when(F.col("told_limit").isNotNull(), F.col(order)))
    return responses.groupBy("provider", "model").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), first.alias("limit_rpm"), F.max_by("state", order).alias("state"))


def by_provider(requests: DataFrame, provider: str, order: list, size: int) -> DataFrame:
    """provider, chunk, n, first, last: the calls that a flush makes of collected requests, `size` of one provider at most in each."""
    numbered = chunked(requests, order, size, [provider])
    return numbered.groupBy(provider, "chunk").agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
