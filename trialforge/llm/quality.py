"""Quality rules: gradient-boosted trees over document statistics.

measured() takes the statistics of whole texts. fit() grows trees on a bounded sample of labelled rows (the `sample`
parameter, taken by the hash of the id, so it does not depend on the row order), by histograms, with monotonic
constraints on chosen features. The trees are flattened into numpy node arrays, and scoring walks all rows of a batch
down all trees at once.

Edge cases: null or empty text has no words and all statistics are 0; it fails the base rule. Without labels of both
kinds no trees are grown and the base rule alone decides. Labels without a document, and documents without a label, do
no harm; of several labels of one id the largest counts. Repeated rows each get a row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.llm._common import as_text, chunks, mix64, raw_text, released, unheld, words_in

WINDOW = 8
AT_ONCE = 4_000_000
SYMBOLS = b"#*$%&|<>"
#: Statistics that the model sees, and the direction in which the probability of good quality may go with each (0: any).
#: variety is log(distinct words) / log(words), stutter_share the share of words that are the word before once more.
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0, "digit_share": 0, "stutter_share": -1, "variety": 1, "punct_share": 0, "line_words": 0, "non_ascii_share": 0}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
NOT_SYMBOL = bytes(set(range(256)) - set(SYMBOLS))
NOT_UPPER, NOT_DIGIT = bytes(set(range(256)) - set(range(65, 91))), bytes(set(range(256)) - set(range(48, 58)))
NOT_PUNCT = bytes(set(range(256)) - set(b".,;:!?"))
NOT_ASCII, CONTINUING = bytes(range(128)), bytes(range(128, 192))


def repeated_words(ids: np.ndarray, owner: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """For each of n texts, the words in windows that occur twice or more in it. ids: of words, texts end to end."""
    out = np.zeros(n, np.int64)
    if len(ids) < window:
        return out
    h = np.zeros(len(ids) - window + 1, np.uint64)
    words = mix64(ids.astype(np.uint64) + np.uint64(1))
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(h)]
    at = np.flatnonzero(owner[: len(h)] == owner[window - 1 :])
    keys = mix64(h[at] ^ mix64(owner[at].astype(np.uint64) + np.uint64(7)))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return out
    spot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    starts = at[twice[spot] == keys]
    change = np.bincount(starts, minlength=len(ids) + 1) - np.bincount(starts + window, minlength=len(ids) + 1)
    return np.bincount(owner[np.cumsum(change[:-1]) > 0], minlength=n)


def lines_of(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that an earlier line equals."""
    lines, seen, dup = text.split(b"\n"), set(), 0
    for x in lines:
        if x in seen:
            dup += 1
        elif x and not x.isspace():
            seen.add(x)
    return len(seen) + dup, dup


def statistics(raw: list[bytes]) -> pd.DataFrame:
    """Base columns of the contract and FEATURES, of each text."""
    parts = []
    for part in chunks(raw, AT_ONCE):
        texts = raw[part]
        ids, starts, words = words_in(as_text(pa.array(texts, pa.large_binary())))
        n = np.diff(starts)
        owner = np.repeat(np.arange(len(texts)), n)
        # Distinct words of each text: a text's number and a word's, sorted.
        pairs = np.sort(owner * max(1, len(words)) + ids)
        distinct = np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])] // max(1, len(words)), minlength=len(texts)) if len(pairs) else np.zeros(len(texts), np.int64)
        letters, other = pc.binary_length(words).to_numpy().copy(), np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False))
        letters[other] = [len(w.translate(None, CONTINUING)) for w in words.take(pa.array(other)).cast(pa.large_binary()).to_pylist()]
        word_chars = np.bincount(owner, letters[ids], len(texts)).astype(np.int64)
        again = np.bincount(owner[1:][(ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])], minlength=len(texts))
        count = lambda others: np.fromiter((len(t.translate(None, others)) for t in texts), np.int64, len(texts))
        lines = np.array([lines_of(t) for t in texts]).reshape(-1, 2)
        symbols, size, some, d = count(NOT_SYMBOL), np.fromiter(map(len, texts), np.int64, len(texts)), np.maximum(1, n), np.maximum(1, word_chars)
        repeat = repeated_words(ids, owner, len(texts))
        x = {"n_words": n, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": lines[:, 1], "n_repeat_words": repeat, "log_words": np.log1p(n), "mean_word": word_chars / some, "symbol_share": symbols / d, "dup_line_share": lines[:, 1] / np.maximum(1, lines[:, 0]), "repeat_share": repeat / some}
        x |= {"upper_share": count(NOT_UPPER) / d, "digit_share": count(NOT_DIGIT) / d, "stutter_share": again / some, "variety": np.log1p(distinct) / np.log1p(some), "punct_share": count(NOT_PUNCT) / d, "line_words": np.log1p(n / np.maximum(1, lines[:, 0])), "non_ascii_share": count(NOT_ASCII) / np.maximum(1, size)}
        parts.append(pd.DataFrame(x))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in [*BASE, *FEATURES]})


@dataclass
class Trees:
    """Flattened forest: node k of tree t goes left if x[feature] <= threshold, to child[k] or child[k] + 1; leaves have feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                down = self.child[t, node] + (x[rows, f] > self.threshold[t, node])
                node = np.where(f < 0, node, down)
            out += self.value[t, node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, reg: float = 2.0, least: float = 1.0) -> Trees:
    """Boosted trees for the log loss by histogram splits. A split on a constrained feature is only taken if its two
    leaves are in that order, and the midpoint then bounds all leaves below it."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    size = 2 ** (depth + 1) - 1
    feature, threshold, child, value = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size), np.int64), np.zeros((trees, size))
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        free, todo = 1, [(0, np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            k, rows, d, low, high = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            leaf = float(np.clip(gs / (hs + reg), low, high))
            best = (1e-6, -1, 0, 0.0, 0.0)
            for j in range(x.shape[1]) if d < depth else ():
                gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(edges[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(edges[j]) + 1))[:-1]
                if not len(gl):
                    continue
                gr, hr = gs - gl, hs - hl
                left, right = np.clip(gl / (hl + reg), low, high), np.clip(gr / (hr + reg), low, high)
                # The drop in the second-order loss with these leaf values.
                gain = gl * left - (hl + reg) * left**2 / 2 + gr * right - (hr + reg) * right**2 / 2 - (gs * leaf - (hs + reg) * leaf**2 / 2)
                gain[(hl < least) | (hr < least) | (signs[j] * (right - left) < 0)] = -1
                if (i := int(np.argmax(gain))) is not None and gain[i] > best[0]:
                    best = (gain[i], j, i, left[i], right[i])
            if best[1] < 0:
                value[t, k] = rate * leaf
                margin[rows] += rate * leaf
                continue
            _, j, i, left, right = best
            feature[t, k], threshold[t, k], child[t, k] = j, edges[j][i], free
            goes = binned[rows, j] > i
            mid = (left + right) / 2
            l_bound, r_bound = ((low, mid), (mid, high)) if signs[j] > 0 else ((mid, high), (low, mid)) if signs[j] < 0 else ((low, high), (low, high))
            todo += [(free, rows[~goes], d + 1, *l_bound), (free + 1, rows[goes], d + 1, *r_bound)]
            free += 2
    return Trees(feature, threshold, child, value, depth, base)


def measured(score: Trees | None = None, features: bool = False):
    """A column function from texts as bytes to a struct of their statistics, base_failed, the model's probability `good` (null without a model) and, if asked for, the features."""
    @F.pandas_udf(", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, good double" + ", features array<double>" * features)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        unheld()
        for x in batches:
            s = statistics(x.tolist())
            f = s[list(FEATURES)].to_numpy(np.float64)
            out = s[list(BASE)].astype(np.int64)
            out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
            out["good"] = score.probability(f) if score else np.full(len(f), np.nan)
            if features:
                out["features"] = list(f)
            yield out
        released()

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees | None:
    """Trees from at most `sample` labelled documents: those with the smallest hashes of their ids."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"))
    stats = rows.select("id", measured(features=True)(raw_text(F.col("text"))).alias("s")).join(F.broadcast(chosen), "id")
    known = stats.select("id", F.col("s.features").alias("features"), "y").toPandas().sort_values("id", kind="stable")
    y = (known["y"].to_numpy() > 0).astype(np.float64)
    if len(y) < 20 or y.min() == y.max():
        return None
    return grow(np.stack(known["features"].to_numpy()), y, list(FEATURES.values()))


def judged(docs: DataFrame, labels: DataFrame, cut: float = 0.5, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (the row's columns), stats (its statistics), kept: not base_failed, and a probability of good quality of `cut` or more."""
    trees = fit(docs, labels, sample, id_col, text_col)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), measured(trees)(raw_text(F.col(text_col))).alias("stats"))
    return out.withColumn("kept", ~F.col("stats.base_failed") & (F.lit(trees is None) | (F.col("stats.good") >= cut)))
