"""Pieces against the library, the scan against one pass over the whole text."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import TEXTS
from tests.llm.test_counts_packing import ODD
from trialforge.llm import queries
from trialforge.llm import sentence_pieces as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
PIECES = S.MergePieces(MODEL)


def encoded(texts, pieces=PIECES):
    ids, bounds = pieces.encode(pa.array([t.encode() for t in texts], pa.binary()))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_encoder_equals_library(small):
    texts = ODD + ["  a  b \n c", "▁x ▁▁y", "<s>x</s>", "=" * 500, "a" * 3000, "ab" * 700, " " * 300, "thethethe" * 40 + "é" * 90] + [r["text"] for r in small.collect()]
    got = encoded(texts)
    assert got == LIBRARY.encode(texts)
    assert [PIECES.decode(np.array(g, int)).decode() for g in got] == [t.replace("▁", " ") for t in texts]


LETTERS = [*"aabtehinsor .,\n\t01239-=_éüñ中の\x00\x1c\U0001f600▁", "the", "  ", "ing", "tion", "====", "<0x0A>", "</s>"]


@given(st.lists(st.lists(st.sampled_from(LETTERS), max_size=60).map("".join), max_size=6))
@settings(max_examples=200, deadline=None)
def test_encoder_on_odd_texts(texts):
    assert encoded(texts) == LIBRARY.encode(texts)


@pytest.mark.parametrize("chunk", [17, 23, 64])
def test_scan_of_long_segments(chunk):
    """Matrices over the pieces at each cut, their products, and tracing chunk by chunk give what merging the whole gives."""
    rng = random.Random(chunk)
    for _ in range(25):
        text = "".join(rng.choice(["a", "the", "ing", "er", "on", "b", "tion", "at"]) for _ in range(rng.randrange(10, 120)))
        assert PIECES.scan(text, chunk) == PIECES.pairs.merged(text)


def test_memory_is_bounded(monkeypatch, small):
    monkeypatch.setattr(S, "REMEMBERED", 50)
    pieces, texts = S.MergePieces(MODEL), ODD + [r["text"] or "" for r in small.limit(20).collect()]
    for t in texts + texts:
        assert encoded([t], pieces) == [LIBRARY.encode(t)]
    assert len(pieces.known.keys) < 50_000


def test_op8_query(spark, sf, small):
    texts = {r["doc_id"]: r["text"] or "" for r in small.collect()}
    rows = queries.op8_sentence_pieces(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = LIBRARY.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        assert r["round_trip"] == (LIBRARY.decode(want) == texts[r["doc_id"]])


def test_encoded_edges(edge, none):
    rows = S.encoded(edge, MODEL).collect()
    assert len(rows) == len(TEXTS) and all(r["round_trip"] for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert S.encoded(none, MODEL).count() == 0


def chunked_ids(text, part):
    """Matrices of chunks, their best path, and each chunk traced by itself, without Spark."""
    whole, width = " " + text, PIECES.width
    cuts = [*range(0, max(1, len(whole) - width), part), len(whole)]
    chunks = [(whole[max(0, a - width) : b + width].replace(" ", S.SPACE), min(a, width), b - a, a == 0, b == len(whole)) for a, b in zip(cuts, cuts[1:])]
    states = S.best_states([PIECES.matrix(*c) for c in chunks])
    return np.concatenate([ids for ids, _, _ in PIECES.traced_chunks([(*c, *s) for c, s in zip(chunks, zip(states, states[1:]))])]).tolist()


@given(st.lists(st.sampled_from(LETTERS), min_size=1, max_size=120).map("".join), st.integers(20, 60))
@settings(max_examples=150, deadline=None)
def test_chunks_of_odd_texts(text, part):
    assert chunked_ids(text, part) == LIBRARY.encode(text)


@pytest.mark.parametrize("part, grouped", [(40, 2), (97, 64), (300, 3)])
def test_documents_in_chunks(spark, monkeypatch, small, part, grouped):
    monkeypatch.setattr(S, "PART", part)
    monkeypatch.setattr(S, "GROUPED", grouped)
    rng = random.Random(part)
    texts = [r["text"] for r in small.limit(25).collect()] + [None, "", "x" * part, "x" * (part + 1), "thethe" * 200, "ab" * 150 + "é中🙂" * 60, "▁" * 90 + " " * 90, "".join(rng.choice(LETTERS) for _ in range(900))]
    texts = [t and t[:3000] for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in S.encoded(df, MODEL).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = LIBRARY.encode(t or "")
        assert np.frombuffer(rows[i]["ids"], "<u4").tolist() == want and rows[i]["n_tokens"] == len(want)
        assert rows[i]["round_trip"] == (LIBRARY.decode(want) == (t or ""))


def test_query_goes_by_matrices(spark, sf, monkeypatch, small):
    """Long documents of the query come through their chunks' matrices: without them it fails."""
    assert small.where("char_length(text) > 16384").count() > 0
    chunks = S.cut_documents(small, MODEL, "doc_id", "text")
    assert chunks.groupBy("row").count().where("count > 1").count() == small.where("char_length(text) > 16384").count()
    assert S.chunk_matrices(chunks, MODEL).where("entries > 1").count() > 0

    def broken(*_):
        raise RuntimeError("no matrix")

    monkeypatch.setattr(S, "chunk_matrices", broken)
    with pytest.raises(RuntimeError, match="no matrix"):
        queries.op8_sentence_pieces(spark, sf)


def test_giant_document_over_tasks(spark, small):
    text = " ".join(r["text"] or "" for r in small.collect())
    text = (text * (1 + 8_000_000 // len(text)))[:8_000_000]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    chunks = S.cut_documents(df, MODEL, "doc_id", "text").repartition(4, "row", "place")
    assert chunks.select("place").distinct().count() == -(-len(text) // S.PART)
    row = S.encoded(df, MODEL).first()
    assert row["ids"] == np.array(LIBRARY.encode(text), "<u4").tobytes() and row["round_trip"]


def vocabulary(rng):
    words = ["▁", "▁a", "ab", "b", "abc", "c", "▁ab", "bca", "a", "cab▁", "aaaa"]
    return {w: -rng.random() * 5 - len(w) * 0.1 for w in words}


def whole_score(scores, text):
    lattice = S.Lattice(scores)
    best = [0.0] + [-np.inf] * len(text)
    for at in range(len(text)):
        for n, s in lattice.steps(text, at):
            best[at + n] = max(best[at + n], best[at] + s)
    return best[-1]


@pytest.mark.parametrize("chunk", [5, 7, 64])
def test_scan(spark, chunk):
    rng = random.Random(chunk)
    scores = vocabulary(rng)
    rows = [(i, "".join(rng.choice("abc xé") for _ in range(rng.choice([1, 4, 5, 6, 30, 200])))) for i in range(40)] + [(90, None), (91, "")]
    got = {}
    for r in S.scanned(spark.createDataFrame(rows, "doc_id long, text string"), scores, chunk).orderBy("doc_id", "place").collect():
        got.setdefault(r["doc_id"], []).extend(r["pieces"])
    lattice = S.Lattice(scores)
    for i, t in rows:
        if t:
            text = ("▁" + t).replace(" ", "▁")
            assert "".join(got[i]) == text
            assert sum(scores.get(p, lattice.unknown) for p in got[i]) == pytest.approx(whole_score(scores, text))
    assert 90 not in got and 91 not in got


def test_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((4, 4)) < 0.3, -np.inf, rng.random((4, 4))) for _ in range(3))
    assert np.allclose(S.combine(S.combine(a, b), c), S.combine(a, S.combine(b, c)))
