"""Language identification by hyperdimensional profiles.

Each letter has a random bipolar vector, made from its code point and a seed. A trigram's vector binds (multiplies) its
letters' vectors, each permuted by its place; a text's vector bundles (adds) the vectors of its trigrams. A language's
prototype is the sum of the bundles of all its training texts, of unit length, centred on the mean over languages, so
that what all languages share does not count. A text's language is the prototype with the largest cosine.

Binding and bundling are exact for whole texts: a text is reduced to counts of its trigrams first, and the counts are
multiplied with the matrix of trigram vectors. Training sums counts per language and trigram on the executors, and then
bundles; what reaches the driver is one bundle of DIMENSIONS numbers for each language, whatever the input's size. Each
letter of any script has a vector of its own; a trigram is its three code points, 21 bits each.

Edge cases: null text, or text without a letter, is "und" with score 0; training rows without a text or label are left
out; without any training row every text is "und"; a column of more than MAX_LANGUAGES values is no column of languages
and is refused. Repeated rows count and are answered each. Other columns are not
read. Ties between languages go to the smaller name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialforge.llm._common import chunks, mix64, raw_text, released, unheld

DIMENSIONS = 1024
AT_ONCE = 2_000_000
#: Languages at most; prototypes of this many are broadcast (MAX_LANGUAGES * DIMENSIONS * 4 bytes).
MAX_LANGUAGES = 20_000
BITS = 21


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point its letter in lower case, 0 if it is none."""
    return np.fromiter((ord(ch.lower()[0]) if (ch := chr(c)).isalpha() else 0 for c in range(0x110000)), np.int32, 0x110000)


def letter_vectors(points: np.ndarray, seed: int) -> np.ndarray:
    """A row of +1 and -1 for each letter; what stands between words (0) has one too."""
    cells = points.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS) + np.arange(DIMENSIONS, dtype=np.uint64) + (np.uint64(seed) << np.uint64(40))
    return np.where(mix64(cells) >> np.uint64(63), 1, -1).astype(np.int8)


def trigram_vectors(codes: np.ndarray, seed: int) -> np.ndarray:
    """One row of +1 and -1 for each packed trigram: first letter permuted twice, second once."""
    parts = np.stack([codes >> 2 * BITS, codes >> BITS & (1 << BITS) - 1, codes & (1 << BITS) - 1])
    points, which = np.unique(parts, return_inverse=True)
    v, (a, b, c) = letter_vectors(points, seed), which.reshape(parts.shape)
    return np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]


def trigram_counts(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, packed trigram and count. Runs of what is no letter are one gap, and so are both ends."""
    texts = [b" " + x + b" " for x in raw]
    points = [np.frombuffer(x.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in points])
    own = letters()[np.concatenate(points)] if points else np.zeros(0, np.int32)
    stays = np.append(True, (own[1:] != 0) | (own[:-1] != 0) | (owner[1:] != owner[:-1])) if len(own) else np.zeros(0, bool)
    own, owner = own[stays], owner[stays]
    if len(own) < 3:
        return (np.zeros(0, np.int64),) * 3
    # Letters are numbered within these texts, so that text and trigram fit into 64 bits.
    met = np.zeros(0x110000, bool)
    met[own] = True
    known = np.flatnonzero(met)
    number = np.cumsum(met, dtype=np.int64)[own] - 1
    m, whole = len(known), owner[2:] == owner[:-2]
    packed = (number[:-2] * m + number[1:-1]) * m + number[2:]
    keys = np.sort(owner[2:][whole] * m**3 + packed[whole])
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    text, code = np.divmod(keys[first], m**3)
    return text, known[code // m**2] << 2 * BITS | known[code // m % m] << BITS | known[code % m], np.diff(np.append(first, len(keys)))


def has_letter(raw: pd.Series) -> pd.Series:
    """Whether a text, as bytes, has a letter: the texts that are not "und" where there are languages."""
    table = letters()
    return pd.Series([bool(table[np.frombuffer(x.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)].any()) for x in raw], dtype=bool)


def parts_of(raw: list[bytes]) -> Iterator[slice]:
    """Slices of a bounded size in bytes and in texts."""
    for part in chunks(raw, AT_ONCE):
        yield from (slice(a, min(a + 1024, part.stop)) for a in range(part.start, part.stop, 1024))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (unit rows) from all rows of docs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unheld()
        for x in batches:
            raw, lang = x["raw"].tolist(), x["lang"].to_numpy()
            for part in parts_of(raw):
                owner, codes, n = trigram_counts(raw[part])
                if len(owner):
                    yield pd.DataFrame({"lang": lang[part][owner], "code": codes, "n": n}).groupby(["lang", "code"], as_index=False)["n"].sum()
        released()

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), raw_text(F.col(text_col)).alias("raw"))
    counts = rows.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for x in batches:
            for lang, own in x.groupby("lang"):
                for a in range(0, len(own), 4096):
                    some = own.iloc[a : a + 4096]
                    sums[lang] = sums.get(lang, 0.0) + some["n"].to_numpy(np.float64) @ trigram_vectors(some["code"].to_numpy(), seed).astype(np.float64)
        yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    bundles = counts.mapInPandas(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    found = bundles.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("v")).select("lang", F.col("v.v").alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = sorted((r["lang"], r["v"]) for r in found)
    if not found:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    unit = np.array([v for _, v in found])
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    if len(unit) > 1:
        unit = unit - unit.mean(0)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    return [k for k, _ in found], unit.astype(np.float32)


def predicted(languages: list[str], prototypes: np.ndarray, seed: int = 7):
    """A column function from texts as bytes to a struct of lang_pred, score (the best cosine, 0 at least) and margin (to the second best)."""

    @F.pandas_udf("lang_pred string, score double, margin double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            raw = x.tolist()
            pred, score, margin = np.array(["und"] * len(raw), object), np.zeros(len(raw)), np.zeros(len(raw))
            for part in parts_of(raw) if languages else ():
                owner, codes, n = trigram_counts(raw[part])
                m = part.stop - part.start
                seen, bundle = np.zeros(m, bool), np.zeros((m, DIMENSIONS), np.float32)
                distinct, column = np.unique(codes, return_inverse=True)
                for a in range(0, len(distinct), 2048):
                    take = (column >= a) & (column < a + 2048)
                    table = np.zeros((m, min(2048, len(distinct) - a)), np.float32)
                    table[owner[take], column[take] - a] = n[take]
                    bundle += table @ trigram_vectors(distinct[a : a + 2048], seed).astype(np.float32)
                seen[owner[codes != 0]] = True  # a trigram of gaps alone has no letter
                cosine = bundle @ prototypes.T / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-9)
                top = np.sort(cosine, axis=1)
                pred[part] = np.where(seen, np.array(languages, object)[cosine.argmax(1)], "und")
                score[part] = np.where(seen, np.clip(top[:, -1], 0, 1), 0)
                margin[part] = np.where(seen, top[:, -1] - top[:, -2], 0) if top.shape[1] > 1 else 0
            yield pd.DataFrame({"lang_pred": pred, "score": score, "margin": margin})
        released()

    return run


def identified(docs: DataFrame, training: Column | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """row (the row's columns) and told (lang_pred, score, margin) of all rows of docs, learned from the rows where `training` is true (or all)."""
    model = train(docs if training is None else docs.where(training), text_col, lang_col)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), predicted(*model)(raw_text(F.col(text_col))).alias("told"))
