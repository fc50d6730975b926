"""Token counts and packing against the library and exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import TEXTS
from trialforge.llm import packing, queries, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORDS)
ODD = ["", " ", "  ", " a", "a ", "a  b   c", "\n\n a\n\nb  ", "a \n b\t c", "aaaaaaa" * 50, "don't 12ab34 ½ Ⅷ", "x<|endoftext|> y  <|endoftext|>", "\x00\x1f\x1d a\x85b", "é́\U0001f600 ́", "  中文 の", "ab" * 700 + "aaa" * 77]


BYTE_LIBRARY = Tokenizer.from_file(BYTES)


def library_counts(texts):
    return [len(x.ids) for x in BYTE_LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_counter_equals_library(small):
    texts = ODD + [r["text"] or "" for r in small.select("text").collect()]
    assert counted(token_counts.Counter(BYTES), texts) == library_counts(texts)


def counted(counter, texts):
    return counter(pa.array([t.encode() for t in texts], pa.binary())).tolist()


COUNTER = token_counts.Counter(BYTES)
SPACED = [*"aZ'stredm019 .,<|>\n\t\x0b\x1c\x85\xa0é\u0301中の\u2003\u3000\U0001f600½", "  ", " \n", "\n ", "<|endoftext|>", " the"]


@given(st.lists(st.lists(st.sampled_from(SPACED), max_size=30).map("".join), max_size=8))
@settings(max_examples=150, deadline=None)
def test_counter_on_odd_texts(texts):
    assert counted(COUNTER, texts) == library_counts(texts)


def test_counter_forgets(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 2)
    monkeypatch.setattr(token_counts, "AT_ONCE", 5)
    counter = token_counts.Counter(BYTES)
    assert counted(counter, ODD + ODD) == library_counts(ODD) * 2


def test_count_tokens_edges(edge, none):
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(edge, BYTES).collect())
    texts = [t or "" for _, t in TEXTS]
    want = sorted((-1 if i is None else i, len(t.encode()), n, n > 1024) for (i, _), t, n in zip(TEXTS, texts, library_counts(texts), strict=True))
    assert got == want
    assert token_counts.count_tokens(none, BYTES).count() == 0


def test_word_encoder_equals_library(small):
    texts = ODD + [r["text"] or "" for r in small.select("text").limit(60).collect()]
    assert encoded(packing.WordEncoder(WORDS), texts) == library_ids(texts)


def library_ids(texts):
    return [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def encoded(encoder, texts):
    flat, bounds = encoder(pa.array([t.encode() for t in texts]))
    return [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


LETTERS = [*"äÄßÿŸØø×÷ªºµ²abzAZ'stremvdl019 .,;<|>&#\n\t\x0b\x00\x1c\x1f\x85\xa0é\u0301ΣςİıßКч中の 　\U0001f600½Ⅷ\u0345", "<|endoftext|>", "<|startoftext|>", "</w>", "'S", "'RE", "  "]


@given(st.lists(st.lists(st.sampled_from(LETTERS), max_size=30).map("".join), max_size=8))
@settings(max_examples=150, deadline=None)
def test_word_encoder_on_odd_texts(texts):
    assert encoded(SHARED, texts) == library_ids(texts)


SHARED = packing.WordEncoder(WORDS)


def test_word_encoder_forgets(monkeypatch, small):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    monkeypatch.setattr(packing, "TOGETHER", 7)
    texts = ODD + [r["text"] or "" for r in small.select("text").limit(30).collect()]
    encoder = packing.WordEncoder(WORDS)
    for t in texts:
        assert encoded(encoder, [t]) == library_ids([t])


def test_word_encoder_on_broken_bytes():
    flat, _ = packing.WordEncoder(WORDS)(pa.array([b"ab \xff\xc3 cd"]))
    assert flat.tolist() == library_ids([b"ab \xff\xc3 cd".decode("utf-8", "replace")])[0]


def test_offsets_of_many_parts(spark):
    rows = [(lane, part, 1 + part % 5) for lane in "ab" for part in range(0, 5000, 3)]
    got = {(r["lane"], r["part"]): r["before"] for r in packing.running(spark.createDataFrame(rows, "lane string, part long, n long")).collect()}
    at = defaultdict(int)
    for lane, part, n in rows:
        assert got[lane, part] == at[lane]
        at[lane] += n


def check_packed(rows, wanted, length):
    """Every id of every document lies in one piece; sequences are gapless and full but the last."""
    places, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    full = []
    for s in sorted(places):
        at = 0
        for o, n in sorted(places[s]):
            assert o == at and n > 0
            at += n
        full.append(at)
    assert all(n == length for n in full[:-1]) and list(places) and max(places) == len(full) - 1
    for i, texts in wanted.items():
        parts = sorted(docs[i], key=lambda r: (r["doc_tokens"], r["start"]))
        assert sum(r["length"] for r in parts) == sum(len(t) for t in texts)
        if len(texts) == 1:
            assert np.array_equal(np.concatenate([np.frombuffer(r["ids"], "<u4") for r in parts]), texts[0])


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def test_pack_edges(edge, none):
    rows = packing.pack(edge, WORDS, length=512, window=2).collect()
    wanted = defaultdict(list)
    for i, t in TEXTS:
        wanted[i].append(ids_of(t))
    check_packed(rows, wanted, 512)
    assert packing.pack(none, WORDS).count() == 0


@pytest.mark.parametrize("targets", [None, {"src1": 0.9, "src2": 0.1}])
def test_pack_small(small, targets):
    rows = packing.pack(small, WORDS, length=256, window=4, targets=targets).collect()
    check_packed(rows, {r["doc_id"]: [ids_of(r["text"])] for r in small.collect()}, 256)


def test_pack_with_few_queues(small):
    rows = packing.pack(small, WORDS, length=256, window=4, max_queues=3).collect()
    check_packed(rows, {r["doc_id"]: [ids_of(r["text"])] for r in small.collect()}, 256)


def test_targets_hold_with_few_queues(spark):
    """Sources with targets follow them, and are not mixed with others, when there are more sources than queues."""
    rows = [(i, f"some words of source {i % 6} and {i}", str(i % 6) if i % 6 else None) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)

    def shares(**more):
        out = defaultdict(int)
        for r in packing.pack(df, WORDS, length=64, window=10, **more).collect():
            out[r["source"], r["sequence_id"] // 10] += r["length"]
        return out

    for targets in ({"1": 0.9}, {None: 0.7, "4": 0.2}):
        few, many = shares(max_queues=3, targets=targets), shares(targets=targets)
        for w in range(8):
            assert all(abs(few[s, w] - many[s, w]) <= 2 for s in targets)


def test_schedule_keeps_proportions():
    totals, targets = [5000, 90_000, 20_000], [0.5, 0.3, 0.2]
    s = packing.Schedule(totals, targets, 1000)
    for w in range(10):  # until the first queue runs dry
        assert np.abs(s.edge(w) - w * 1000 * np.array(targets)).max() <= 0.5
    assert list(s.edge(s.windows)) == totals
    natural = packing.Schedule(totals, [t / sum(totals) for t in totals], 1000)
    parts = np.array([natural.edge(w + 1) - natural.edge(w) for w in range(natural.windows - 1)])
    assert np.abs(parts - 1000 * np.array(totals) / sum(totals)).max() <= 1


def test_op7_query(spark, sf, small):
    """Every piece of the query: its ids are those of its place in its document, and all is packed."""
    texts = {r["doc_id"]: np.array(ids_of(r["text"]), "<u4") for r in small.collect()}
    rows = queries.op7_packing(spark, sf).collect()
    for r in rows:
        part = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (r["ids_crc32"], r["doc_tokens"]) == (zlib.crc32(part.tobytes()), len(texts[r["doc_id"]]))
    assert sorted(i for r in rows for i in [(r["doc_id"], r["start"] + k) for k in range(r["length"])]) == sorted((d, k) for d, t in texts.items() for k in range(len(t)))
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 4096 for s, n in at.items() if s < max(at))


def test_op9_query(spark, sf, small):
    texts = [(r["doc_id"], r["text"] or "") for r in small.collect()]
    want = {i: (len(t.encode()), n, n > 1024) for (i, t), n in zip(texts, library_counts([t for _, t in texts]), strict=True)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op9_token_counts(spark, sf).collect()} == want
