"""SentencePiece encoding and decoding by a max-plus scan over chunks.

A document is cut into chunks. A chunk gives a matrix of best scores from each state at its entry to each state at its
exit; matrices combine associatively (maximum of sums), the best states at all boundaries follow from their products,
and each chunk is then traced back by itself between the states it got.

Unigram vocabularies (scanned): a state is how far the piece that crosses the boundary reaches into the next chunk, and
scores are those of the pieces.

Merge-based (BPE) vocabularies (encoded): the pieces that merging by rank gives are the ones of which each two
neighbours, encoded together, stay as they are. So a state is the piece at the boundary, and a step from one piece to the
next scores 0 if the two stay and minus infinity otherwise; the one path above minus infinity is the encoding. Where no
piece spans two neighbouring characters, every path has a border and nothing merges across: such a cut has one state, its
matrices are single zeros, and a document falls apart into segments there. Each distinct segment is traced once, many
at a time in arrays, and remembered up to a bound; only segments longer than LONG are cut again, with matrices over all
pieces that can lie across the cut. Whether two pieces stay is found by merging the two, once for each pair.

A document of more than PART characters is cut into chunks that are rows of their own, dealt over all tasks. A chunk gives
its matrix over the pieces across its two cuts: what lies before its first border tells which entries lead on, what lies
after its last one which exits are reached, and between borders there is one way; a chunk without borders is searched
through, for all entries at once. Products of GROUPED matrices at a time go up a tree, the states at the cuts come down
it again, and every chunk is traced by itself between its two states.

Edge cases: null text counts as empty and has no ids; repeated rows are encoded each; an empty table gives no rows;
texts of any length and segments of any length are encoded whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from trialforge.llm._common import held, mix64, pieces_of, raw_text, released, stored

SPACE = "▁"
#: Segments remembered by a worker, bytes of text at once, characters of a chunk, and of a segment that is cut.
REMEMBERED, AT_ONCE, CHUNK, LONG = 1_000_000, 2_000_000, 65_536, 64
#: Characters of a chunk of a document, matrices that are combined by one task, and bytes of chunks in a batch.
PART, GROUPED, BATCH_BYTES = 16_384, 64, 4_000_000
BASE = 0x9E3779B97F4A7C15
UNIT_ = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2**64."""
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of all substrings of an array of characters, from one pass over it."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.upto = np.zeros(n + 1, np.uint64)
        np.cumsum((mix64(points.astype(np.uint64) + np.uint64(1)) | np.uint64(1)) * powers(BASE, n), out=self.upto[1:])
        self.back = powers(UNIT_, n + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.upto[stop] - self.upto[start]) * self.back[start] + (stop - start).astype(np.uint64))


class Table:
    """Numbers by sorted 64-bit keys; -1 for what is not in it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.values = np.insert(self.keys, at, keys[order]), np.insert(self.values, at, values[order])

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)


class Pairs:
    """Whether two pieces, encoded together, stay as they are. Characters that are no piece merge with nothing."""

    def __init__(self, names: list[str], scores: dict[str, float]):
        self.names, self.scores, self.number = names, scores, {p: i for i, p in enumerate(names)}
        self.known, self.fresh = Table(np.zeros(0, np.int64), np.zeros(0, np.int64)), {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: the best-scored neighbours merge, the first ones of equals, until none do."""
        out = list(text)
        while True:
            best, at = None, -1
            for k in range(len(out) - 1):
                score = self.scores.get(out[k] + out[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return out
            out[at : at + 2] = [out[at] + out[at + 1]]

    def stay(self, a: str, b: str) -> bool:
        return self.merged(a + b) == [a, b]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For numbers of pieces."""
        keys = a * len(self.names) + b
        out = self.known.look_up(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            distinct, which = np.unique(keys[new], return_inverse=True)
            for k in distinct.tolist():
                if k not in self.fresh:
                    x, y = divmod(k, len(self.names))
                    self.fresh[k] = int(self.stay(self.names[x], self.names[y]))
            out[new] = np.fromiter((self.fresh[k] for k in distinct.tolist()), np.int64, len(distinct))[which]
        return out > 0

    def settle(self, bound: int) -> None:
        """Puts fresh pairs into the sorted table, or begins anew where there are too many."""
        keys, values = (np.fromiter(x, np.int64, len(self.fresh)) for x in (self.fresh.keys(), self.fresh.values()))
        if len(self.known.keys) > bound:
            self.known = Table(keys[:0], values[:0])
        self.known.add(keys, values)
        self.fresh = {}


class MergePieces:
    """Encoding and decoding with a merge-based model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        names = {i: model.id_to_piece(i) for i in every}
        scores = {p: model.get_score(i) for i, p in names.items() if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.bytes = pa.array([bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else names[i].replace(SPACE, " ").encode() for i in every], pa.large_binary())
        byte_ids = {int(names[i][3:5], 16): i for i in every if model.is_byte(i)}
        self.of_byte = np.array([byte_ids[b] for b in range(256)])
        self.kind = np.dtype("<u2" if len(every) <= 1 << 16 else "<u4")
        # Pieces by number; the last one stands for a character that is none and spans no border.
        pieces = sorted(scores)
        self.pairs, self.width, self.none = Pairs(pieces, scores), max(map(len, pieces)), len(pieces)
        self.id_of = np.array([model.piece_to_id(p) for p in pieces] + [0])
        points = [np.array([ord(c) for c in p]) for p in pieces]
        ends = np.cumsum([len(p) for p in points])
        hashes, starts = Hashes(np.concatenate(points)), ends - [len(p) for p in points]
        self.table = Table(hashes.of(starts, ends), np.arange(len(pieces)))
        heads = np.concatenate([np.stack([np.full(len(p), s), s + np.arange(1, len(p) + 1)]) for s, p in zip(starts, points, strict=True)], axis=1)
        self.prefixes = Table(*np.unique(hashes.of(*heads), return_index=True))
        # Characters of pieces by class, 0 for all others, and which of them ever stand side by side in a piece.
        letters = np.unique(np.concatenate(points))
        if not all(chr(c) in scores for c in letters):
            raise ValueError("a character of the pieces is no piece itself")
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[letters] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros((len(letters) + 1,) * 2, bool)
        for p in points:
            self.beside[self.class_of[p[:-1]], self.class_of[p[1:]]] = True
        self.stays: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.known, self.starts, self.flat = Table(np.zeros(0, np.uint64), np.zeros(0, np.int64)), np.zeros(1, np.int64), np.zeros(0, self.kind)

    def candidates(self, points: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, length and number of every piece in the characters; a piece does not reach further than `room`."""
        hashes, alive = Hashes(points), np.arange(len(points))
        out = []
        for n in range(1, self.width + 1):
            alive = alive[room[alive] >= n]
            keys = hashes.of(alive, alive + n)
            number = self.table.look_up(keys)
            if n == 1:
                number = np.where(number < 0, self.none, number)
            met = number >= 0
            out.append((alive[met], np.full(int(met.sum()), n), number[met]))
            alive = alive[self.prefixes.look_up(keys) >= 0]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def traced(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of segments, one after the other, and how many each has. starts: where they begin (and, last, the end).

        Of the pieces that end at a character, the one that stays beside the last piece before it is the last piece of
        the encoding up to there. Segments are walked along side by side.
        """
        size = np.diff(starts)
        place = np.arange(len(points)) - np.repeat(starts[:-1], size)
        room = np.repeat(size, size) - place
        at, n, number = self.candidates(points, room)
        end = at + n - 1
        order = np.lexsort((n, place[end]))
        at, n, number, end = at[order], n[order], number[order], end[order]
        last, length = np.full(len(points), -1, np.int64), np.zeros(len(points), np.int64)
        steps = np.searchsorted(place[end], np.arange(int(size.max(initial=0)) + 1))
        for a, b in zip(steps, steps[1:], strict=False):
            x, m, c, e = at[a:b], n[a:b], number[a:b], end[a:b]
            before = np.where(place[x] > 0, last[np.maximum(x - 1, 0)], self.none)
            free = (before == self.none) | (c == self.none)
            good = np.zeros(b - a, bool)
            good[free & (before >= 0)] = True
            ask = np.flatnonzero(~free & (before >= 0))
            good[ask] = self.pairs(before[ask], c[ask])
            last[e[good]], length[e[good]] = c[good], m[good]
        # Back from the ends, all segments at once.
        marks, spot = np.zeros(len(points), bool), starts[1:][size > 0] - 1
        floor = starts[:-1][size > 0]
        while len(spot):
            marks[spot] = True
            spot = spot - length[spot]
            going = spot >= floor
            spot, floor = spot[going], floor[going]
        count = np.add.reduceat(np.append(marks, False), np.minimum(starts[:-1], len(points))) if len(size) else size
        return last[marks], np.where(size > 0, count, 0)

    def loose(self, points: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The characters that are no piece, in order: those without a class."""
        return points[self.class_of[points] == 0] if (number == self.none).any() else points[:0]

    def across(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Begin and end of the pieces that hold the character before the cut: the states there."""
        out = []
        for s in range(max(0, cut - self.width), cut):
            out += [(s, e) for e in range(cut, min(len(text), s + self.width) + 1) if text[s:e] in self.pairs.scores or e == s + 1]
        return out

    def reached(self, text: str, entry: tuple[int, int], stop: int) -> list[dict[int, int]]:
        """From an entry state: for each place, the pieces that can end there (their begin) and the begin of the piece before each."""
        known = self.stays = self.stays if len(self.stays) < REMEMBERED // 10 else {}

        def stay(a: str, b: str) -> bool:
            if (a, b) not in known:
                known[a, b] = not a or self.pairs.stay(a, b)
            return known[a, b]

        out: list[dict[int, int]] = [{} for _ in range(len(text) + 1)]
        out[entry[1]][entry[0]] = -1
        for at in range(entry[1], stop):
            for begin in out[at]:
                for e in range(at + 1, min(len(text), at + self.width) + 1):
                    if (text[at:e] in self.pairs.scores or e == at + 1) and stay(text[begin:at], text[at:e]):
                        out[e][at] = begin
        return out

    def scan(self, text: str, chunk: int = LONG) -> list[str]:
        """The pieces of a long segment, chunk by chunk."""
        cuts = [*range(chunk, len(text) - self.width, chunk), len(text)]
        states = [[(0, 0)], *(self.across(text, c) for c in cuts[:-1]), [(s, e) for s, e in self.across(text, len(text)) if e == len(text)]]
        matrices, windows = [], []
        for k, cut in enumerate(cuts):
            low, high = min(s for s, _ in states[k]), min(len(text), cut + self.width)
            window = text[low:high]
            found = [self.reached(window, (s - low, e - low), min(cut, len(text)) - low) for s, e in states[k]]
            # An exit is reached as a piece that ends at its end and begins before the cut.
            matrices.append(np.array([[0.0 if s - low in f[e - low] and s - low < cut - low else -np.inf for s, e in states[k + 1]] for f in found]))
            windows.append((low, found))
        path = best_states(matrices)
        out = []
        for k, (low, found) in enumerate(windows):
            entry, (s, e) = states[k][path[k]], states[k + 1][path[k + 1]]
            own, f = [], found[path[k]]
            s, e = s - low, e - low
            while e > entry[1] - low:
                own.append(text[s + low : e + low])
                s, e = f[e][s], s
            out += own[::-1]
        return out

    def leads(self, text: str, entries: list[tuple[int, int]], stop: int) -> list[dict[int, int]]:
        """For each place: the begin of the pieces that can end there, with a bit for each entry state that leads to them. Pieces begin before `stop`."""
        known = self.stays = self.stays if len(self.stays) < REMEMBERED // 10 else {}
        out: list[dict[int, int]] = [{} for _ in range(len(text) + 1)]
        for i, (s, e) in enumerate(entries):
            out[e][s] = out[e].get(s, 0) | 1 << i
        for at in range(min((e for _, e in entries), default=stop), stop):
            for begin, bits in out[at].items():
                for e in range(at + 1, min(len(text), at + self.width) + 1):
                    if text[at:e] in self.pairs.scores or e == at + 1:
                        key = (text[begin:at], text[at:e])
                        if key not in known:
                            known[key] = not key[0] or self.pairs.stay(*key)
                        if known[key]:
                            out[e][at] = out[e].get(at, 0) | bits
        return out

    def way(self, text: str, entry: tuple[int, int], stop: int, leave: tuple[int, int] | None = None) -> list[str]:
        """The pieces from an entry state to the exit state, or to whatever piece ends at `stop`."""
        found = self.reached(text, entry, stop)
        s, e = leave if leave is not None else (next(iter(found[stop])), stop)
        own = []
        while e > entry[1]:
            own.append(text[s:e])
            s, e = found[e][s], s
        return own[::-1]

    def frame(self, text: str, before: int, size: int, first: bool, last: bool) -> tuple[list, list, np.ndarray, int, int]:
        """Of a chunk, text[before : before + size], with what lies around it: states at its entry and exit, its characters, and its first and last border (the first one is beyond the last one if no two frame anything)."""
        stop = before + size
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.class_of[points]
        borders = np.flatnonzero(np.append(first, ~self.beside[kinds[:-1], kinds[1:]]))
        entries = [(0, 0)] if first else self.across(text, before)
        exits = [(s, e) for s, e in self.across(text, stop) if not last or e == stop]
        a, b = borders[borders >= before], borders[borders < stop]
        return entries, exits, points, int(a[0]) if len(a) else stop, int(b[-1]) if len(b) else -1

    def matrix(self, text: str, before: int, size: int, first: bool, last: bool) -> np.ndarray:
        """Best scores from each entry state of a chunk to each exit state: 0, or minus infinity where no way leads."""
        entries, exits, _, low, high = self.frame(text, before, size, first, last)
        stop = before + size
        if low <= high:
            heads = 0
            for bits in self.leads(text[:low], entries, low)[low].values():
                heads |= bits
            tails = self.leads(text[high:], [(0, 0)], stop - high)
            good = np.array([[heads >> i & 1 and tails[e - high].get(s - high, 0) for s, e in exits] for i in range(len(entries))], bool)
        else:
            found = self.leads(text, entries, stop)
            good = np.array([[found[e].get(s, 0) >> i & 1 for s, e in exits] for i in range(len(entries))], bool)
        return np.where(good.reshape(len(entries), len(exits)), 0.0, -np.inf)

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            out += [int(self.id_of[self.pairs.number[p]])] if p in self.pairs.number else self.of_byte[list(p.encode("utf-8", "surrogatepass"))].tolist()
        return out

    def traced_chunks(self, chunks: list[tuple[str, int, int, bool, bool, int, int]]) -> list[tuple[np.ndarray, int, int]]:
        """Ids of each chunk (matrix()'s arguments, and the numbers of its entry and exit state), and where its pieces begin and end in its text. What lies between borders is encoded for all chunks at once."""
        framed, inner = [], []
        for text, before, size, first, last, entry, leave in chunks:
            entries, exits, points, low, high = self.frame(text, before, size, first, last)
            framed.append((text, entries[entry], exits[leave], low, high, before + size))
            inner.append(points[low:high] if low <= high else points[:0])
        ids, bounds = self.encode_points(np.concatenate(inner), np.append(0, np.cumsum([len(x) for x in inner]))) if inner else (None, None)
        out = []
        for k, (text, entry, leave, low, high, stop) in enumerate(framed):
            if low <= high:
                head = self.way(text[:low], entry, low)
                tail = self.way(text[high:], (0, 0), stop - high, (leave[0] - high, leave[1] - high))
                own = np.concatenate([self.ids_of(head), ids[bounds[k] : bounds[k + 1]], self.ids_of(tail)]).astype(self.kind)
            else:
                own = np.array(self.ids_of(self.way(text, entry, stop, leave)), self.kind)
            out.append((own, entry[1], leave[1]))
        return out

    def learn(self, points: np.ndarray, starts: np.ndarray, stops: np.ndarray, keys: np.ndarray) -> None:
        """Traces new segments and remembers their ids."""
        size = stops - starts
        long = size > LONG
        spots = np.repeat(starts[~long] - np.cumsum(size[~long]) + size[~long], size[~long]) + np.arange(int(size[~long].sum()))
        number, count = self.traced(points[spots], np.append(0, np.cumsum(size[~long])))
        # Characters that are no piece are ids of their bytes; a segment of one is that character alone.
        ids, counts = self.id_of[number], np.empty(len(starts), np.int64)
        counts[~long] = count
        parts, keep = [], number != self.none
        if not keep.all():
            chars = self.loose(points[spots], number)
            parts = [self.of_byte[list(chr(c).encode("utf-8", "surrogatepass"))] for c in chars]
            wide = np.ones(len(number), np.int64)
            wide[~keep] = [len(x) for x in parts]
            out = np.repeat(ids, wide)
            first = np.cumsum(wide) - wide
            for f, x in zip(first[~keep], parts, strict=True):
                out[f : f + len(x)] = x
            owner = np.repeat(np.arange(len(count)), count)
            counts[~long] = np.bincount(owner, wide, len(count)).astype(np.int64)
            ids = out
        lists = [ids]
        for k in np.flatnonzero(long):
            text = "".join(map(chr, points[starts[k] : stops[k]]))
            own = np.concatenate([self.id_of[[self.pairs.number[p]]] if p in self.pairs.number else self.of_byte[list(p.encode("utf-8", "surrogatepass"))] for p in self.scan(text)])
            lists.append(own)
            counts[k] = len(own)
        order = np.append(np.flatnonzero(~long), np.flatnonzero(long))
        begin = len(self.flat) + np.cumsum(counts[order]) - counts[order]
        free = len(self.starts) - 1
        self.flat = np.append(self.flat, np.concatenate(lists).astype(self.kind))
        self.starts = np.append(self.starts, begin + counts[order])
        self.known.add(keys[order], free + np.arange(len(order)))

    def encode(self, raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (bytes), one after the other, and where they begin (and, last, how many there are)."""
        texts = [(" " + x.decode("utf-8", "replace")).replace(" ", SPACE) if x else "" for x in raw.to_pylist()]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.encode_points(points, np.append(0, np.cumsum([len(t) for t in texts])))

    def encode_points(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for characters that are texts, or parts of texts between borders, from each bound to the next."""
        if not len(points):
            return np.zeros(0, self.kind), bounds
        kinds = self.class_of[points]
        cut = np.append(True, ~self.beside[kinds[:-1], kinds[1:]])
        cut[bounds[:-1][bounds[:-1] < len(points)]] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(points))
        keys, first, which = np.unique(Hashes(points).of(starts, stops), return_index=True, return_inverse=True)
        if len(self.known.keys) > REMEMBERED:
            self.forget()
        new = np.flatnonzero(self.known.look_up(keys) < 0)
        if len(new):
            self.learn(points, starts[first[new]], stops[first[new]], keys[new])
        self.pairs.settle(2 * REMEMBERED)
        number = self.known.look_up(keys)
        begin, size = self.starts[number], self.starts[number + 1] - self.starts[number]
        n = size[which]
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(begin[which] - upto + n, n) + np.arange(int(upto[-1]))]
        return ids, np.append(0, upto)[np.searchsorted(starts, bounds)]

    def spelled(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of ids, end to end, and where those of each text begin; a text begins with the space that the model puts first."""
        if not len(ids):
            return memoryview(b""), np.zeros(len(bounds), np.int64)
        taken = self.bytes.take(pa.array(ids.astype(np.int64)))
        _, ends, data = taken.buffers()
        return memoryview(data or b""), np.frombuffer(ends, np.int64)[: len(ids) + 1][bounds]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids; the space that the model put first is taken away."""
        back, at = self.spelled(ids, np.array([0, len(ids)]))
        return bytes(back[at[0] : at[1]]).removeprefix(b" ")


def best_states(matrices: list[np.ndarray]) -> list[int]:
    """The states at the entry of each chunk and at the end of the best path; the first chunk has one entry."""
    forward = [np.zeros(1)]
    for m in matrices:
        forward.append((forward[-1][:, None] + m).max(0))
    states = [int(np.argmax(forward[-1]))]
    for f, m in zip(reversed(forward[:-1]), reversed(matrices), strict=True):
        states.append(int(np.argmax(f + m[:, states[-1]])))
    return states[::-1]


def cut_documents(docs: DataFrame, model: str, id_col: str, text_col: str) -> DataFrame:
    """id, row (a number of its own for each text), place, text, before, size, last, clean: chunks of the texts of more than PART characters, each with what a piece can reach into on both sides. clean: the text is UTF-8."""
    kind, part = docs.schema[id_col].dataType.simpleString(), PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, number = held(MergePieces, model).width, TaskContext.get().partitionId() << 40
        names = ["id", "row", "place", "text", "before", "size", "last", "clean"]

        def batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([ids.take(pa.array([0] * len(rows))), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

        for x in batches:
            for k, raw in enumerate(x.column("raw")):
                raw = raw.as_py()
                text = " " + raw.decode("utf-8", "replace")
                clean, number, rows, held_bytes = len(text.encode()) == len(raw) + 1 and text[1:].encode() == raw, number + 1, [], 0
                cuts = [*range(0, max(1, len(text) - width), part), len(text)]
                for place, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    low = max(0, a - width)
                    rows.append((number, place, text[low : b + width], a - low, b - a, b == len(text), clean))
                    held_bytes += 4 * part
                    if held_bytes > BATCH_BYTES:
                        yield batch(x.column("id").slice(k, 1), rows)
                        rows, held_bytes = [], 0
                if rows:
                    yield batch(x.column("id").slice(k, 1), rows)

    rows = docs.where(F.char_length(text_col) > part).select(F.col(id_col).alias("id"), raw_text(F.col(text_col)).alias("raw"))
    return rows.mapInArrow(run, f"id {kind}, row long, place int, text string, before int, size int, last boolean, clean boolean")


def chunk_matrices(chunks: DataFrame, model: str) -> DataFrame:
    """row, place, entries, m: the transfer matrix of each chunk, by rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = held(MergePieces, model)
        for x in batches:
            found = [pieces.matrix(t.replace(" ", SPACE), b, n, p == 0, z) for t, b, n, p, z in zip(x["text"], x["before"], x["size"], x["place"], x["last"], strict=True)]
            yield pd.DataFrame({"row": x["row"], "place": x["place"], "entries": [len(m) for m in found], "m": [m.tobytes() for m in found]})

    return chunks.mapInPandas(run, "row long, place int, entries int, m binary")


def matrices_in(x: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(m, np.float64).reshape(n, -1) for n, m in zip(x["entries"], x["m"], strict=True)]


def in_groups(level: DataFrame, above: DataFrame | None = None) -> GroupedData:
    """A level's rows by row and group of places, with the states of the level above if given. The rows are few bytes and long work, so they keep all the tasks that the cluster's setting asks for."""
    rows = level.withColumn("part", F.floor(F.col("place") / GROUPED).cast("int"))
    if above is not None:
        rows = rows.join(above.select("row", F.col("place").alias("part"), "entry", "leave"), ["row", "part"])
    return rows.repartition(int(level.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "part").groupBy("row", "part")


def products(level: DataFrame) -> DataFrame:
    """The matrices of GROUPED neighbouring places of each row as one, with the group's number as place."""

    def product(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        m = reduce(combine, matrices_in(x.sort_values("place")))
        return pd.DataFrame({"row": [key[0]], "place": [key[1]], "entries": [len(m)], "m": [m.tobytes()]})

    return in_groups(level).applyInPandas(product, "row long, place int, entries int, m binary")


def boundary_path(level: DataFrame, above: DataFrame | None) -> DataFrame:
    """row, place, entry, leave: the states at the cuts of each place, between those of its group above; at the top, from the start to the best end."""

    def path(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("place")
        matrices = matrices_in(x)
        start, end = (int(x["entry"].iloc[0]), int(x["leave"].iloc[0])) if "entry" in x else (0, None)
        matrices[0] = matrices[0][start : start + 1]
        states = best_states(matrices if end is None else [*matrices[:-1], matrices[-1][:, end : end + 1]])
        states[0] = start
        states[-1] = states[-1] if end is None else end
        return pd.DataFrame({"row": key[0], "place": x["place"], "entry": states[:-1], "leave": states[1:]})

    return in_groups(level, above).applyInPandas(path, "row long, place int, entry int, leave int")


def chunk_states(matrices: DataFrame) -> DataFrame:
    """row, place, entry, leave of every chunk, by products up a tree and paths down it. matrices: stored."""
    levels = [matrices]
    while (levels[-1].agg(F.max("place")).first()[0] or 0) >= GROUPED:
        levels.append(stored(products(levels[-1]), "products"))
    states = None
    for level in reversed(levels):
        states = stored(boundary_path(level, states), "states")
    return states


def encoded_chunks(chunks: DataFrame, model: str) -> DataFrame:
    """id, row, place, ids, same (decoding gives the chunk back) of every chunk. chunks: of cut_documents(), stored."""
    kind = chunks.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held(MergePieces, model)
        for x in batches:
            rows = x.select(["text", "before", "size", "place", "last", "entry", "leave", "clean"]).to_pylist()
            found = pieces.traced_chunks([(r["text"].replace(" ", SPACE), r["before"], r["size"], r["place"] == 0, r["last"], r["entry"], r["leave"]) for r in rows])
            same = [r["clean"] and bytes(pieces.spelled(ids, np.array([0, len(ids)]))[0]) == r["text"][a:b].encode() for r, (ids, a, b) in zip(rows, found, strict=True)]
            ids = [ids.astype("<u4").tobytes() for ids, _, _ in found]
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("id", "row", "place")), pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], ["id", "row", "place", "ids", "same"])
        released()

    states = chunk_states(stored(chunk_matrices(chunks, model), "matrices"))
    return chunks.join(states, ["row", "place"]).select("id", "row", "place", "text", "before", "size", "last", "clean", "entry", "leave").mapInArrow(run, f"id {kind}, row long, place int, ids binary, same boolean")


def put_together(chunks: DataFrame) -> DataFrame:
    """id, n_tokens, ids, round_trip of every row, from its chunks: a row's value is one, however long."""
    kind = chunks.schema["id"].dataType.simpleString()

    def whole(x: pa.Table) -> pa.Table:
        x = x.sort_by("place")
        ids = b"".join(x.column("ids").to_pylist())
        return pa.table({"id": x.column("id").slice(0, 1), "n_tokens": pa.array([len(ids) // 4], pa.int64()), "ids": pa.array([ids], pa.binary()), "round_trip": [all(x.column("same").to_pylist())]})

    return chunks.groupBy("row").applyInArrow(whole, f"id {kind}, n_tokens long, ids binary, round_trip boolean")


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (binary, little-endian 32 bits each), round_trip (decoding gives the text back) of every row, by a merge-based model."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held(MergePieces, model)
        for x in batches:
            done = 0
            for raw in pieces_of(x.column("raw"), AT_ONCE):
                own, done = x.column("id").slice(done, len(raw)), done + len(raw)
                ids, bounds = pieces.encode(raw)
                back, at = pieces.spelled(ids, bounds)
                same = [bytes(back[a + 1 : b]) == t if b > a else not t for a, b, t in zip(at.tolist(), at[1:].tolist(), raw.to_pylist(), strict=False)]
                wide = ids.astype("<u4")
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer((4 * bounds).astype(np.int64)), pa.py_buffer(wide)])
                yield pa.RecordBatch.from_arrays([own, pa.array(np.diff(bounds).astype(np.int64)), data.cast(pa.binary()), pa.array(same, pa.bool_())], ["id", "n_tokens", "ids", "round_trip"])
        released()

    chunks = stored(cut_documents(docs, model, id_col, text_col).repartition("row", "place"), "parts")
    short = docs.where(F.coalesce(F.char_length(text_col), F.lit(0)) <= PART)
    rows = short.select(F.col(id_col).alias("id"), raw_text(F.col(text_col)).alias("raw"))
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, round_trip boolean")
    if not chunks.isEmpty():
        out = out.unionByName(put_together(stored(encoded_chunks(chunks, model), "traced", large_rows=True)))
    return out.withColumnRenamed("id", id_col)


class Lattice:
    """Pieces with scores; a character that is no piece costs `unknown`."""

    def __init__(self, scores: dict[str, float], unknown: float | None = None):
        self.scores, self.width = scores, max(map(len, scores), default=1)
        self.unknown = unknown if unknown is not None else min(scores.values(), default=0.0) - 10

    def steps(self, text: str, at: int) -> Iterator[tuple[int, float]]:
        """Length and score of the pieces that begin at `at`."""
        for n in range(1, min(self.width, len(text) - at) + 1):
            s = self.scores.get(text[at : at + n])
            if s is not None or n == 1:
                yield n, self.unknown if s is None else s

    def best(self, text: str, length: int, entries: int) -> np.ndarray:
        """Best scores [entry state, place]: places run to the chunk's end and `width` - 1 beyond. text: the chunk and what follows it."""
        out = np.full((entries, length + self.width), -np.inf)
        out[np.arange(entries), np.arange(entries)] = 0.0
        for at in range(length):
            if (column := out[:, at]).max() > -np.inf:
                for n, s in self.steps(text, at):
                    np.maximum(out[:, at + n], column + s, out=out[:, at + n])
        return out

    def transfer(self, text: str, length: int) -> np.ndarray:
        """Matrix [entry state, exit state] of a chunk: the first `length` characters of text, which goes on at least as far as a piece can reach (or to the end)."""
        return self.best(text, length, min(self.width, length + 1) if length < self.width else self.width)[:, length : length + self.width]

    def trace(self, text: str, length: int, entry: int, leave: int) -> list[str]:
        """Pieces from the entry state to the exit state, ties to the longer last piece."""
        score = np.full(length + self.width, -np.inf)
        back = np.zeros(length + self.width, np.int64)
        score[entry] = 0.0
        for at in range(entry, length):
            if score[at] > -np.inf:
                for n, s in self.steps(text, at):
                    if score[at] + s > score[at + n]:
                        score[at + n], back[at + n] = score[at] + s, n
        out, at = [], length + leave
        while at > entry:
            out.append(text[at - back[at] : at])
            at -= back[at]
        return out[::-1]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each chunk's entry, and 0 at the end, of the best whole path."""
    forward = [np.where(np.arange(matrices[0].shape[0]) == 0, 0.0, -np.inf)]
    for m in matrices:
        forward.append((forward[-1][:, None] + m).max(0))
    states = [0]
    for f, m in zip(reversed(forward[:-1]), reversed(matrices), strict=True):
        states.append(int(np.argmax(f + m[:, states[-1]])))
    return states[::-1]


def scanned(docs: DataFrame, scores: dict[str, float], chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, place (chunk number), pieces: the best segmentation of every row by a unigram vocabulary.

    Chunks are rows of their own, so a giant document is worked on by many tasks; only its matrices (width squared
    numbers for each chunk) meet.
    """
    lattice = Lattice(scores)
    width, kind = lattice.width, docs.schema[id_col].dataType.simpleString()
    if chunk < width:
        raise ValueError("chunks must be as long as the longest piece")
    text = F.regexp_replace(F.concat(F.lit(SPACE), F.coalesce(F.col(text_col), F.lit(""))), " ", SPACE)
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text.alias("text")).where(F.char_length("text") > 1)
    places = F.posexplode(F.sequence(F.lit(1), F.char_length("text"), F.lit(chunk))).alias("place", "at")
    # A last chunk shorter than a piece could be skipped by one: it is joined to the one before it.
    cut = rows.select("id", "row", "text", F.char_length("text").alias("size"), places).where((F.col("at") == 1) | (F.col("size") - F.col("at") + 1 >= width))
    last = F.col("size") - F.col("at") + 1 < chunk + width
    length = F.when(last, F.col("size") - F.col("at") + 1).otherwise(chunk)
    cut = stored(cut.select("id", "row", "place", F.expr(f"substring(text, at, {chunk + 2 * width})").alias("text"), length.cast("int").alias("length")), "chunks", large_rows=True)

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"row": x["row"], "place": x["place"], "m": [square(lattice.transfer(t, n), width).tobytes() for t, n in zip(x["text"], x["length"], strict=True)]})

    def states(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("place")
        s = boundary_states([np.frombuffer(m, np.float64).reshape(width, width) for m in x["m"]])
        return pd.DataFrame({"row": x["row"], "place": x["place"], "entry": s[:-1], "leave": s[1:]})

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"id": x["id"], "row": x["row"], "place": x["place"], "pieces": [lattice.trace(*v) for v in zip(x["text"], x["length"], x["entry"], x["leave"], strict=True)]})

    found = cut.mapInPandas(matrices, "row long, place int, m binary").groupBy("row").applyInPandas(states, "row long, place int, entry int, leave int")
    out = cut.join(found, ["row", "place"]).select("id", "row", "place", "text", "length", "entry", "leave").mapInPandas(pieces, f"id {kind}, row long, place int, pieces array<string>")
    return out.withColumnRenamed("id", id_col)


def square(m: np.ndarray, width: int) -> np.ndarray:
    out = np.full((width, width), -np.inf)
    out[: m.shape[0], : m.shape[1]] = m
    return out
