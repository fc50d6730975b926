"""Language-model scores, languages, quality: brute force, held-out accuracy, edge cases."""

import collections
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import TEXTS
from trialforge.llm import language_id, quality, queries, suffix_tree


def tokens(t):
    return (t or "").encode().lower().split() + [b"\n"]


def brute_scores(rows, least=4, gain=2.0):
    """The suffix tree by dictionaries, contexts of any length. rows: id, text, train. Also the length of the longest state."""
    texts = [(tokens(t), train) for _, t, train in rows]
    count = collections.defaultdict(collections.Counter)

    def learn(n):
        for w, train in texts:
            for k in range(n - 1, len(w)):
                count[n][tuple(w[k - n + 1 : k + 1])] += train

    for n in (1, 2, 3):
        learn(n)
    total = sum(v for v in count[1].values())
    distinct = sum(v > 0 for v in count[1].values())
    space = total + distinct + 1
    mix = lambda c, x, s, below, one: (max(x - one, 0) + s * c * below) / max(c - one + s * c, 1e-12)
    around = lambda w, k, d: (count[d][tuple(w[k - d : k])], count[d + 1][tuple(w[k - d : k + 1])])
    open_ = lambda w, k, d: around(w, k, d)[1] < around(w, k, d)[0]  # noqa: E731  (the context is followed by other words too)
    states = {}

    def settle(sums):
        found = {s: suffix_tree.STRENGTHS[int(g.argmax())] for s, g in sums.items() if g.max() > gain * suffix_tree.SCALE}
        states.update(found)
        return found

    def gained(sums, w, k, d, below):
        c, x = around(w, k, d)
        sums[tuple(w[k - d : k])] += np.rint(suffix_tree.SCALE * (np.log([mix(c, x, s, below, 1) for s in suffix_tree.STRENGTHS]) - np.log(below)))
        return mix(c, x, suffix_tree.STRENGTHS[1], below, 1)

    sums = collections.defaultdict(lambda: np.zeros(3))
    for w, train in texts:
        for k in range(len(w)) if train else ():
            below = max(count[1][(w[k],)], 1) / max(1, space - 1)
            for d in (1, 2):
                if k >= d and count[d][tuple(w[k - d : k])] >= least and (d == 1 or open_(w, k, 1)):
                    below = gained(sums, w, k, d, below)
    new, d = settle(sums), 2
    while any(len(s) == d for s in new):
        d += 1
        learn(d + 1)
        sums = collections.defaultdict(lambda: np.zeros(3))
        for w, train in texts:
            for k in range(d, len(w)) if train else ():
                if count[d][tuple(w[k - d : k])] < least or tuple(w[k - d + 1 : k]) not in states or not open_(w, k, d - 1):
                    continue
                below = max(count[1][(w[k],)], 1) / max(1, space - 1)
                for e in range(1, d):
                    if (s := tuple(w[k - e : k])) in states:
                        below = mix(*around(w, k, e), states[s], below, 1)
                gained(sums, w, k, d, below)
        new = settle(sums)
    out = []
    for (i, _, train), (w, _) in zip(rows, texts, strict=True):
        base, score = 0.0, 0.0
        for k in range(len(w)):
            p = (count[1][(w[k],)] + 1) / space
            base += math.log10(p)
            for e in range(1, min(k, d) + 1):
                if (s := tuple(w[k - e : k])) in states:
                    p = mix(*around(w, k, e), states[s], p, 0)
                elif e >= 3:
                    break
            score += math.log10(p)
        out.append((i, not train, len(w), sum(count[1][(x,)] > 0 for x in w), total, base, score))
    return out, max(map(len, states), default=0)


def test_suffix_tree_brute_force(spark):
    import random

    rng = random.Random(2)
    follow = {f"a{k}": [f"a{rng.randrange(40)}" for _ in range(3)] for k in range(40)}
    rows = []
    for i in range(80):
        w = ["a0"]
        for _ in range(rng.randrange(0, 120)):
            w.append(rng.choice(follow.get(w[-1], ["a1"])) if rng.random() < 0.8 else f"b{rng.randrange(500)}")
        rows.append((i, " ".join(w), zlib.crc32(str(i).encode()) % 7 != 2))
    likely = [rng.choice([0.05, 0.95]) for _ in range(16)]  # of "u", after each four words
    for i in range(60):
        w = [rng.choice("uv") for _ in range(4)]
        for _ in range(100):
            w.append("u" if rng.random() < likely[sum((x == "u") << k for k, x in enumerate(w[-4:]))] else "v")
        rows.append((100 + i, " ".join(w), i % 9 > 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = sorted(tuple(r) for r in suffix_tree.scored(df.repartition(7), F.col("train")).collect())
    assert got == sorted(tuple(r) for r in suffix_tree.scored(df.coalesce(1), F.col("train"), window=2).collect())
    want, depth = brute_scores(rows)
    want.sort()
    assert depth >= 4  # contexts grow beyond three words where that helps
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held) + 10


def test_suffix_tree_sent_gains():
    """Contexts whose tokens all occur once after them send nothing, and are judged by their counts; others send a sum each, without keys."""
    rng = np.random.default_rng(3)
    seq = np.array([1, 2, 9, 3, 9, 4, 9, 5, 9, 6, 1, 2, 1, 2, 1, 2, 7, 8, 0], np.uint32)  # "9" is followed by other words each time, "1" by "2", "2" by "1" twice
    b = suffix_tree.Block(0, np.array([len(seq)]), rng.integers(0, 1 << 63, 10).astype(np.uint64), seq, np.array([True]), np.arange(1), np.zeros(1, np.int64))
    told = [(n, np.bincount(b.grams(n, at)[0])) for n, at in ((1, np.arange(len(seq))), (2, np.arange(1, len(seq))), (3, np.arange(2, len(seq))))]
    replies = pd.DataFrame([(n, 0, suffix_tree.squeezed(c.astype(np.uint64) << np.uint64(1) | np.uint64(1))) for n, c in told], columns=["n", "bin", "data"])
    m = suffix_tree.Model(b, replies, len(seq), 10, 4)
    at, context, own = m.near(1)
    below = m.root(left_out=True)[at]
    rows = suffix_tree.near_gains(m, 1, at, context, own, below, 0)
    assert len(m.often[1][1]) == 3 and [(r[:3], r[3]) for r in rows] == [((0, 0, 1), None)]
    sums = suffix_tree.dense(rows[0][4], 3, 4)
    assert sorted(sums[:, 0]) == [0, 2, 4]
    which = m.place_of(1, at)
    for s, strength in enumerate(suffix_tree.STRENGTHS):
        each = np.rint(suffix_tree.SCALE * (np.log(suffix_tree.mixed(context, own, strength, below, True)) - np.log(below)))
        once = np.rint(suffix_tree.SCALE * np.log(4 * strength / (3 + 4 * strength)))
        assert (np.bincount(which, each) == sums[:, 1 + s] + (4 - sums[:, 0]) * once).all()
    kept = suffix_tree.retained(sums, np.array([4, 4, 4]), 2.0) > 0
    assert kept[sums[:, 0] == 4].all() and not kept[sums[:, 0] == 0].any()
    assert not suffix_tree.near_gains(m, 1, at[own < 2], context[own < 2], own[own < 2], below[own < 2], 0)


def test_suffix_tree_order():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64)
    keys[::3] = keys[0] + np.arange(1000, dtype=np.uint64)[::-1]  # these differ in their last bits alone
    for k in (keys, np.repeat(keys, 2), keys[:1], keys[:0]):
        assert (suffix_tree.order_of(k) == np.argsort(k, kind="stable")).all()


def test_suffix_tree_edges(spark, edge, none):
    rows = suffix_tree.scored(edge, F.col("doc_id") != 8).collect()
    assert len(rows) == len(TEXTS) and all(np.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 7)} == {1}
    assert {r["held_out"] for r in rows if r["doc_id"] in (8, None)} == {True}
    untrained = suffix_tree.scored(edge.where("doc_id = 1"), F.lit(False)).first()
    assert (untrained["train_tokens"], untrained["n_known"], untrained["score"]) == (0, 0, 0)
    assert suffix_tree.scored(none, F.lit(True)).count() == 0


def test_op1_base(spark, small, sf):
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2) for r in small.collect()]
    want = {w[0]: w for w in brute_scores(rows)[0]}
    for r in queries.op1_suffix_tree(spark, sf).collect():
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[1:5]
        assert r["base_score"] == pytest.approx(w[5], rel=1e-9) and r["score"] == pytest.approx(w[6], rel=1e-9)


def test_op3_brute_force(spark, sf, small):
    """The query against bundles added up trigram by trigram."""
    docs = small.select("doc_id", "text", "lang").collect()
    vectors = {}

    def bundle(text):
        letters, out = [0], np.zeros(language_id.DIMENSIONS)
        for ch in text:
            c = ord(ch.lower()[0]) if ch.isalpha() else 0
            if c or letters[-1]:
                letters.append(c)
        if letters[-1]:
            letters.append(0)
        for t, n in collections.Counter(zip(letters, letters[1:], letters[2:], strict=False)).items():
            if t not in vectors:
                a, b, c = (language_id.letter_vectors(np.array([x]), 7)[0].astype(int) for x in t)
                vectors[t] = np.roll(a, 2) * np.roll(b, 1) * c
            out += n * vectors[t]
        return out, any(letters)

    own = {r["doc_id"]: bundle(r["text"] or "") for r in docs}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    names = sorted({r["lang"] for r in docs if r["lang"] and r["text"] is not None and not held(r["doc_id"])})
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sums = unit(np.array([sum(own[r["doc_id"]][0] for r in docs if r["lang"] == k and not held(r["doc_id"])) for k in names]))
    prototypes = unit(sums - sums.mean(0))
    rows = queries.op3_language_id(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        v, letters = own[r["doc_id"]]
        assert r["held_out"] == held(r["doc_id"])
        if not letters:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        cosine = prototypes @ v / np.linalg.norm(v)
        assert r["score"] == pytest.approx(max(0, cosine.max()), abs=1e-4) and cosine[names.index(r["lang_pred"])] >= cosine.max() - 1e-5


def test_language_accuracy(spark, sf, small):
    got = queries.op3_language_id(spark, sf).join(small.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, edge, none):
    out = {r["row"]["doc_id"]: r["told"] for r in language_id.identified(edge).collect()}
    assert out[2]["lang_pred"] == out[3]["lang_pred"] == out[7]["lang_pred"] == "und" and out[2]["score"] == 0
    assert out[1]["lang_pred"] == "en" and out[8]["lang_pred"] == "en"
    assert {r["told"]["lang_pred"] for r in language_id.identified(edge, F.lit(False)).collect()} == {"und"}
    assert language_id.identified(none).count() == 0


def test_bundles_are_sums_of_bound_letters():
    """Counts times trigram vectors, against the definition letter by letter, for letters of any script."""
    owner, codes, n = language_id.trigram_counts([b"Ab, c!", "Жщ 中文a\U00020000".encode()])
    for text, letters in enumerate(([0, ord("a"), ord("b"), 0, ord("c"), 0], [0, ord("ж"), ord("щ"), 0, ord("中"), ord("文"), ord("a"), 0x20000, 0])):
        got = n[owner == text] @ language_id.trigram_vectors(codes[owner == text], 7).astype(int)
        v = [language_id.letter_vectors(np.array([c]), 7)[0].astype(int) for c in letters]
        want = sum(np.roll(a, 2) * np.roll(b, 1) * c for a, b, c in zip(v, v[1:], v[2:], strict=False))
        assert np.array_equal(got, want)


def test_letters_do_not_share_vectors():
    v = language_id.letter_vectors(np.arange(0x400, 0x600), 7).astype(int)
    assert np.abs(v @ v.T - 1024 * np.eye(len(v))).max() < 7 * 32  # far letters are as good as orthogonal


def brute_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_statistics(small):
    texts = [t for _, t in TEXTS] + ["#*$ %&|<> é\né\né", "x " * 9, "a b c d e f g h a b c d e f g h", "\r\n\r\n a"] + [r["text"] for r in small.collect()]
    got = quality.statistics([(t or "").encode() for t in texts])[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].to_numpy()
    assert got.tolist() == [list(brute_statistics(t)) for t in texts]


def test_quality_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (99, 0), (4, None)], "doc_id long, quality int")
    rows = quality.judged(edge, labels).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        n, *_, repeat = brute_statistics(r["row"]["text"])
        assert r["kept"] == (not (n < 20 or 100 * repeat > 30 * n))  # too few labels for trees
    assert quality.judged(none, labels).count() == 0 and quality.judged(edge, labels.limit(0)).count() == len(TEXTS)


def test_quality_held_out(spark):
    """Five folds: bad documents that pass the base rule are found, and good ones stay, by models that have not seen them."""
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").orderBy("doc_id").select("doc_id", "text", "quality").toPandas()
    s = quality.statistics([(t or "").encode() for t in rows["text"]])
    passes = ~((s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])).to_numpy()
    x, y, fold = s[list(quality.FEATURES)].to_numpy(), rows["quality"].to_numpy(float), rows["doc_id"].to_numpy() % 5
    p = np.zeros(len(y))
    for k in range(5):
        p[fold == k] = quality.grow(x[fold != k], y[fold != k], list(quality.FEATURES.values())).probability(x[fold == k])
    bad, good = passes & (y == 0), passes & (y == 1)
    assert bad.sum() >= 20 and (p[bad] < 0.5).mean() >= 0.95 and (p[good] >= 0.5).mean() >= 0.99


def brute_features(t):
    """The model's features by their definitions, in the order of FEATURES."""
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, chars, symbols, dup, repeat = brute_statistics(t)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
    some, d = max(1, n), max(1, chars)
    again = sum(a == b for a, b in zip(w, w[1:], strict=False))
    share = lambda pattern, of: len(re.findall(pattern, t)) / of
    return [math.log1p(n), chars / some, symbols / d, dup / max(1, lines), repeat / some, share("[A-Z]", d), share("[0-9]", d), again / some, math.log1p(len(set(w))) / math.log1p(some), share("[.,;:!?]", d), math.log1p(n / max(1, lines)), sum(len(c.encode()) for c in t if ord(c) > 127) / max(1, len(t.encode()))]


def test_op6_brute_force(spark, sf, small):
    """The query against statistics and features by definition, and trees walked node by node."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    trees = quality.fit(small, labels)
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    rows = queries.op6_quality_rules(spark, sf).collect()
    assert len(rows) == small.count() and trees is not None
    for r in rows:
        n, chars, symbols, dup, repeat = brute_statistics(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        x, margin = brute_features(texts[r["doc_id"]]), trees.base
        for feature, threshold, child, value in zip(trees.feature, trees.threshold, trees.child, trees.value, strict=True):
            node = 0
            while feature[node] >= 0:
                node = child[node] + (x[feature[node]] > threshold[node] + 1e-12)
            margin += value[node]
        assert r["quality_score"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-6)
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n) and r["kept"] == (not r["base_failed"] and r["quality_score"] >= 0.5)


def test_monotone_trees():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] + 0.3 * rng.random(600) < 0.7) & (x[:, 1] > 0.2)).astype(float)
    trees = quality.grow(x, y, [-1, 0, 1])
    probe = np.repeat(rng.random((50, 3)), 20, axis=0)
    for j, sign in ((0, -1), (2, 1)):
        walk = probe.copy()
        walk[:, j] = np.tile(np.linspace(0, 1, 20), 50)
        steps = np.diff(trees.margin(walk).reshape(50, 20), axis=1)
        assert (sign * steps >= -1e-12).all()
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.95
