"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are laid end to end in one array of symbols. In each round every pre-token finds the lowest
rank among its neighbouring pairs, and all its pairs of that rank merge at once, from the left where they overlap.
A merge's product only takes part in merges of a higher rank, so this gives what merging one pair after another
gives. Pre-tokens without a known pair leave; the symbols they have left are their tokens.

Edge cases: null text counts as empty (0 bytes, 0 tokens); empty tables give empty results; repeated rows give a row
each; a null id stays null; other columns are not read. Strings of special tokens inside texts are one token each, as
the library has it. No text is cut, whatever its length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.llm._common import as_text, chunks, held, pieces_of, raw_text, released

#: The white space and the splitting pattern that the vocabulary's library uses.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

NONE = np.int64(1 << 40)
#: Pieces remembered by a worker (about 30 bytes each), and bytes of text handled at once.
REMEMBERED, AT_ONCE = 800_000, 6_000_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class MergeTable:
    """Pairs of symbols with rank and product, by binary search over packed pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in merges]
        letters = byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.specials = [x["content"] for x in spec.get("added_tokens", [])]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        product = np.array([vocab[p[0] + p[1]] for p in pairs], dtype=np.int64)
        packed = (left << 20) | right
        order = np.argsort(packed, kind="stable")
        self.packed, self.rank, self.product = packed[order], order.astype(np.int64), product[order]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is no such pair) and place of each pair."""
        packed = (left << 20) | right
        at = np.minimum(np.searchsorted(self.packed, packed), len(self.packed) - 1)
        return np.where(self.packed[at] == packed, self.rank[at], NONE), at


def merged_lengths(table: MergeTable, tokens: list[bytes]) -> np.ndarray:
    """How many symbols each pre-token has after all merges."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    out = sizes.copy()
    symbols = table.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
    owner = np.repeat(np.arange(len(tokens)), sizes)
    rank, at = table.look_up(symbols, np.append(symbols[1:], 0))
    rank[np.append(owner[1:] != owner[:-1], True)] = NONE
    while len(symbols):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        spans = np.diff(np.append(starts, len(symbols)))
        lowest = np.repeat(np.minimum.reduceat(rank, starts), spans)
        out[owner[starts]] = spans
        alive = lowest < NONE
        site = alive & (rank == lowest)
        # Of neighbouring sites, every second one merges: the first, the third and so on of a run.
        place = np.arange(len(site))
        if (site[1:] & site[:-1]).any():
            run_start = np.maximum.accumulate(np.where(site & ~np.append(False, site[:-1]), place, 0))
            site &= (place - run_start) % 2 == 0
        spots = np.flatnonzero(site)
        symbols[spots] = table.product[at[spots]]
        rank[spots] = rank[spots + 1]  # NONE if the merge ends its pre-token
        alive[spots + 1] = False
        stale = np.zeros(len(site), bool)
        open_end = spots[np.append(owner[1:] == owner[:-1], False)[spots + 1]]  # a pair follows that may be new
        stale[open_end] = True
        back = spots[spots > 0] - 1
        stale[back[owner[back] == owner[back + 1]]] = True
        symbols, owner, rank, at, stale = symbols[alive], owner[alive], rank[alive], at[alive], stale[alive]
        fresh = np.flatnonzero(stale)
        if len(fresh):
            rank[fresh], at[fresh] = table.look_up(symbols[fresh], symbols[fresh + 1])
    return out


class Counter:
    """Counts of whole texts.

    A text falls apart at its single spaces, each space going with what follows, and the distinct pieces are counted apart
    and remembered, those used most if there are too many. That is exact unless a space stands between two white
    characters (or one and the end): there the pattern looks across pieces, and the text is matched as a whole. So is one
    with a special string.
    """

    def __init__(self, path: str, pattern: str = PATTERN):
        self.table, self.pattern = MergeTable(path), regex.compile(pattern)
        self.special = re.compile("|".join(map(re.escape, self.table.specials))) if self.table.specials else None
        self.across = rf"[{SPACE}] (?:[{SPACE}]|\z)"
        self.known, self.sizes, self.uses = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def measured(self, pieces: list[str]) -> np.ndarray:
        """The tokens of each piece, all merged together."""
        found = [self.pattern.findall(x) for x in pieces]
        tokens = list(set().union(*found))
        size = dict(zip(tokens, merged_lengths(self.table, [x.encode("utf-8", "surrogatepass") for x in tokens]).tolist(), strict=True)) if tokens else {}
        return np.fromiter((sum(map(size.__getitem__, x)) for x in found), np.int64, len(found))

    def sizes_of(self, pieces: pa.Array) -> np.ndarray:
        """The tokens of distinct pieces, those that are not known measured and remembered."""
        at = pc.index_in(pieces, self.known)
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            some = pieces.take(pa.array(new))
            at[new] = len(self.known) + np.arange(len(new))
            self.sizes = np.append(self.sizes, self.measured(some.to_pylist()))
            self.known, self.uses = pa.concat_arrays([self.known, some]), np.append(self.uses, np.zeros(len(new), np.int64))
        self.uses[at] += 1
        return self.sizes[at]

    def trim(self) -> None:
        if len(self.known) > REMEMBERED:
            keep = np.sort(np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2])
            self.known, self.sizes, self.uses = self.known.take(pa.array(keep)), self.sizes[keep], self.uses[keep] // 2

    def in_pieces(self, text: pa.Array) -> np.ndarray:
        """Counts of texts that fall apart at each space."""
        split = pc.split_pattern(text, " ")
        starts, values = split.offsets.to_numpy().astype(np.int64), split.values
        first = np.zeros(len(values), bool)
        first[starts[:-1]] = True
        out = np.zeros(len(values), np.int64)
        for mask, space in ((first, ""), (~first, " ")):
            coded = values.filter(pa.array(mask)).dictionary_encode()
            pieces = pc.binary_join_element_wise(pa.scalar(space, pa.large_string()), coded.dictionary, pa.scalar("", pa.large_string()))
            out[mask] = self.sizes_of(pieces)[coded.indices.to_numpy()] if len(coded) else 0
        return np.diff(np.append(0, np.cumsum(out))[starts])

    def whole(self, texts: list[str]) -> list[int]:
        """Counts of texts, each matched as a whole between its special strings."""
        parts = [self.special.split(x) if self.special else [x] for x in texts]
        sizes = iter(self.measured([y for x in parts for y in x]).tolist())
        return [len(x) - 1 + sum(next(sizes) for _ in x) for x in parts]

    def __call__(self, raw: pa.Array) -> np.ndarray:
        """The tokens of each text (bytes)."""
        out = []
        for part in pieces_of(raw, AT_ONCE):
            self.trim()
            try:
                text = as_text(part.cast(pa.large_string()))
            except pa.ArrowInvalid:
                text = pa.array([x.decode("utf-8", "replace") for x in part.to_pylist()], pa.large_string())
            slow = pc.match_substring_regex(text, self.across).to_numpy(zero_copy_only=False).copy()
            for x in self.table.specials:
                slow |= pc.match_substring(text, x).to_numpy(zero_copy_only=False)
            counts = np.zeros(len(text), np.int64)
            if not slow.all():
                counts[~slow] = self.in_pieces(text.filter(pa.array(~slow)))
            odd = text.filter(pa.array(slow)).to_pylist()
            counts[slow] = [n for k in chunks(odd, AT_ONCE) for n in self.whole(odd[k])]
            out.append(counts)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of df: id, n_bytes, n_tokens, over_limit. `vocabulary` is the path of a byte-level BPE file on every executor."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(Counter, vocabulary)
        for x in batches:
            raw = x.column("raw")
            yield pa.RecordBatch.from_arrays([x.column("id"), pc.binary_length(raw).cast(pa.int64()), pa.array(counter(raw))], ["id", "n_bytes", "n_tokens"])
        released()

    rows = df.select(F.col(id_col).alias("id"), raw_text(F.col(text_col)).alias("raw"))
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
