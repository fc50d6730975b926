"""URL templates and WARC archives: brute force, round trips, edge cases."""

import base64
import gzip
import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.helpers import assert_same, oracle_rows
from trialforge.llm import queries, url_templates, warc
from trialforge.llm._common import new_path

URLS = [(1, "http://A.Example.ORG/es/1?x"), (2, None), (3, "no scheme"), (4, "https://example.org"), (5, "https://example.org/en/12#f"), (6, "x://a.com/fr/9"), (6, "x://a.com/fr/9"), (7, "x://notexample.org/es/1"), (8, "x://b.com/de/"), (None, "x://a.net/q"), (9, "http://h/" + "d/" * 5000), (10, ""), (11, "http://u?//x/y"), (12, "http://Ä.org/\nz")]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(r), r, v) for v, r in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_edges(spark):
    df = spark.createDataFrame([(i, u, "h", "p", 1, "r") for i, u in URLS], "page_id long, url string, host string, path string, n int, rule string")
    got = url_templates.judged(df, queries.URL_RULES).collect()
    key = lambda x: str(x)
    assert sorted([(r["page_id"], r["host"], r["path"], r["rule"]) for r in got], key=key) == sorted([(i, *brute_url(u)[:3]) for i, u in URLS], key=key)
    want = {i: brute_url(u)[3] for i, u in URLS}
    assert all(r["verdict"] == (want[r["page_id"]] or r["verdict"]) and r["verdict"] in ("allow", "block") for r in got)
    assert url_templates.judged(df.limit(0), queries.URL_RULES).count() == 0


def test_url_query(spark, sf):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op4_url_templates(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = brute_url(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)


def test_templates_learn(spark):
    """Branches that differ in purity stay apart, alike ones merge, and rejection follows the labels."""
    rows = [(i, f"http://shop.x/{s}/{i}", s == "item" if i % 2 else None) for s in ("item", "ads") for i in range(60)]
    rows += [(i, f"http://blog.x/{s}/{i}.html", True if i % 2 else None) for s in ("en", "de", "fr") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    got = url_templates.judged(df, [], labels=F.col("good"))
    shop = {(r["template"], r["verdict"]) for r in got.where("host = 'shop.x'").collect()}
    assert shop == {("/item/{n}", "allow"), ("/ads/{n}", "block")}
    assert {r["template"] for r in got.where("host = 'blog.x'").collect()} == {"/*/{n}.html"}


def test_rare_branches_are_tested(spark):
    """Of many siblings, small ones with evidence of their own keep their name; only those too thin to test are pooled."""
    rows = [(i, f"http://{host}.x/{s}/{i}", label) for host, label in (("none", None), ("good", True)) for s in "ABCDEFGH" for i in range(400)]
    rows += [(i, f"http://{host}.x/{s}/{i}", label) for host in ("none", "good") for s, label in (("de", False), ("jobs", None), ("about", None)) for i in range(40)]
    rows += [(i, f"http://none.x/slug{'abcdefghijklmnopqrstuvwxyz'[i]}/{i}", None) for i in range(26)]
    got = url_templates.judged(spark.createDataFrame(rows, "page_id long, url string, good boolean"), [], labels=F.col("good"))
    told = {(r["host"], r["path"].split("/")[1], r["template"], r["verdict"]) for r in got.collect()}
    for host in ("none.x", "good.x"):
        assert {t[3] for t in told if t[:2] == (host, "de")} == {"block"}
        assert {t[3] for t in told if t[0] == host and t[1] != "de"} == {"allow"}
        assert (host, "de", "/de/{n}", "block") in told
    assert {t[2] for t in told if t[1].startswith("slug")} == {"/*/{n}"}


def brute_templates(pages, weight=4.0, prior=0.9, hosts=4.0):
    """(template, purity) of each (host, shaped) by recursion. pages: host, shaped, label."""
    paths = defaultdict(lambda: [0, 0, 0])
    for host, shape, label in pages:
        x = paths[host, shape]
        x[0] += 1
        x[1] += label is True
        x[2] += label is False

    def smooth(good, n, w, p):
        return (good + w * p) / (n + w)

    expect = {}
    for host, shape in paths:
        p = prior
        begin = lambda s: re.sub("/[^/]*/?$", "", s)
        for circle in (None, 0, 1, 2):
            same = lambda h: ".".join(h.split(".")[-circle:]) if circle else ""  # noqa: B023, E731
            fits = lambda s: s == shape if circle is not None else begin(s) == begin(shape) != ""  # noqa: B023, E731
            votes = [(g, b) for (h, s), (_, g, b) in paths.items() if g + b and fits(s) and same(h) == same(host)]
            p = smooth(sum(g / (g + b + weight) for g, b in votes), sum((g + b) / (g + b + weight) for g, b in votes), hosts, p)
        expect[host, shape] = p
    kind = lambda s: "end" if s is None else "empty" if s == "" else "number" if s == "{n}" else "hex" if s == "{h}" else "mixed" if "{" in s else "word"
    out = {}

    def grow(host, members, template, d):
        branches = defaultdict(list)
        for shape in members:
            seg = shape.split("/")
            if len(seg) <= d:
                out[host, shape] = template
            else:
                branches[seg[d]].append(shape)
        if sum(map(len, branches.values())) == 1:
            (shape,) = next(iter(branches.values()))
            out[host, shape] = template + "/" + "/".join(shape.split("/")[d:])
            return

        def sums(shapes):
            n, g, b = (sum(paths[host, s][k] for s in shapes) for k in range(3))
            follow = Counter()
            for s in shapes:
                follow[kind(s.split("/")[d + 1] if len(s.split("/")) > d + 1 else None)] += paths[host, s][0]
            return n, g, b, sum(paths[host, s][0] * expect[host, s] for s in shapes), follow

        n_all, g_all, b_all, e_all, f_all = sums([s for v in branches.values() for s in v])
        named = defaultdict(list)
        for own, shapes in branches.items():
            n, g, b, e, f = sums(shapes)
            wild = False
            if len(branches) > 1 and "{" not in own and own != "":
                pure, beside = smooth(g, g + b, weight, e / n), smooth(g_all - g, g_all - g + b_all - b, weight, (e_all - e) / (n_all - n))
                far = sum(abs(f[k] / n - f_all[k] / n_all) for k in f_all) / 2
                foreign = abs(e / n - (e_all - e) / (n_all - n)) > 0.25
                rare = len(branches) >= 8 and n < 0.02 * n_all and n < 16 and g + b < weight and not foreign
                wild = rare or (abs(pure - beside) <= 0.25 and far <= 0.15 + n**-0.5)
            named["*" if wild else own] += shapes
        for name, shapes in named.items():
            grow(host, shapes, f"{template}/{name}", d + 1)

    for host in {h for h, _ in paths}:
        grow(host, [s for h, s in paths if h == host], "", 1)
    totals = defaultdict(lambda: [0, 0, 0, 0.0])
    for key, (n, g, b) in paths.items():
        t = totals[key[0], out[key]]
        t[0], t[1], t[2], t[3] = t[0] + n, t[1] + g, t[2] + b, t[3] + n * expect[key]
    return {k: (out[k], smooth(t[1], t[1] + t[2], weight, t[3] / t[0])) for k in paths for t in [totals[k[0], out[k]]]}


def test_op4_brute_force(spark):
    """Every verdict and template of the query; some pages that no rule covers are rejected, and some are not."""
    sf = "/root/testdata/sf0.1"
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    told = {i: brute_url(u) for i, u in pages.items()}
    form = lambda path: re.sub("[0-9]+", "{n}", path)
    want = brute_templates([(h, form(p), None if v is None else v == "allow") for h, p, _, v in told.values()])
    rows = queries.op4_url_templates(spark, sf).collect()
    assert len(rows) == len(pages)
    free = Counter()
    for r in rows:
        host, path, _, verdict = told[r["page_id"]]
        template, purity = want[host, form(path)]
        assert r["template"] == template and r["purity"] == pytest.approx(purity, abs=1e-9)
        assert r["verdict"] == (verdict or ("block" if purity < 0.5 else "allow"))
        free[r["verdict"]] += verdict is None
    assert free["block"] >= 5 and free["allow"] >= 50


def test_templates_at_every_depth(spark):
    """Paths that part only deep down are still told apart, and wildcards form there."""
    deep = "d/" * 40
    rows = [(i, f"http://h.x/{deep}{s}/{i}", s != "bad") for s in (*"abcdef", "bad") for i in range(30)] + [(999, "http://g.x/" + "e/" * 5000, None)]
    got = url_templates.judged(spark.createDataFrame(rows, "page_id long, url string, good boolean"), [], labels=F.col("good"))
    told = {(r["template"], r["verdict"]) for r in got.where("host = 'h.x'").collect()}
    assert told == {(f"/{deep}*/{{n}}", "allow"), (f"/{deep}bad/{{n}}", "block")}
    assert got.where("host = 'g.x'").first()["template"] == "/" + "e/" * 5000


PAGES = [(3, "http://b.org/x", "<p>one</p>"), (1, "http://a.org/", "<p>one</p>"), (2, "http://a.org/?q", None), (7, None, ""), (4, "http://www.c.org:8080/é\r\nz", "ü" * 30_000), (5, "http://a.org/", "two\r\n\r\nWARC/1.1\r\n"), (5, "http://a.org/", "two\r\n\r\nWARC/1.1\r\n"), (None, "http://n/", "nothing"), (None, "http://n/", "<p>one</p>"), (9, "http://z/", "<p>Two</p>")]


def described(i, html):
    data = (html or "").encode()
    same = [j for j, _, h in PAGES if (h or "").encode() == data]
    first = min([j for j in same if j is not None], default=None)
    revisit = len(same) > 1 and i != first
    return i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, 1, "s", "k") for i, u, h in PAGES], "page_id long, url string, html string, id int, sha string, first string").repartition(3)


def test_warc_round_trip(spark, pages):
    directory, folder = warc.archive(pages)
    got = sorted([(r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(directory, folder).collect()], key=str)
    text = lambda x: None if x is None else str(x)
    want = sorted([(text(i), n, digest, kind, text(first)) for i, n, digest, kind, first in (described(i, h) for i, _, h in PAGES)], key=str)
    assert got == want
    found = warc.look_up(pages.select("url").union(pages.select("url")), directory, folder).collect()
    assert sorted([(r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found], key=str) == want
    empty, folder = warc.archive(pages.limit(0))
    assert warc.read_records(empty, folder).count() == warc.look_up(pages, empty, folder).count() == 0


def test_ids_as_text(spark):
    """Ids that are no numbers, with any characters, come back as they were."""
    rows = [("a b>", "http://x/1", "p"), ("\u00e9\r\n", "http://x/2", "p"), ("", "http://x/3", "q"), (None, "http://x/3", "q")]
    directory, folder = warc.archive(spark.createDataFrame(rows, "page_id string, url string, html string"))
    got = {(r["id"], r["record_type"], r["refers_to"]) for r in warc.read_records(directory, folder).collect()}
    assert got == {("a b>", "response", None), ("\u00e9\r\n", "revisit", "a b>"), ("", "response", None), (None, "revisit", "")}


def test_look_up_some(spark, monkeypatch):
    """Urls with many captures, in many blocks, and urls without any."""
    rows = [(i, f"http://h{max(0, i - 9000):04d}.org/", f"page {i % 7000}") for i in range(10_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    directory, folder = warc.archive(df)
    assert directory.count() >= 4
    for urls in (["http://h0000.org/", "https://h0500.org/#x", "http://h0999.org/", "http://none/"], ["http://none/", None], ["http://h0001.org/"]):
        asked = spark.createDataFrame([(u,) for u in urls], "url string")
        keys = {warc.capture_key(u or "") for u in urls}
        assert sorted(int(r["id"]) for r in warc.look_up(asked, directory, folder).collect()) == [i for i, u, _ in rows if warc.capture_key(u) in keys]


def test_lookup_and_members(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    monkeypatch.setattr(warc, "ROLL_BYTES", 300)
    folder = new_path(spark, "warc-test")
    manifest = warc.write_archives(pages, f"{folder}/archive")
    directory = warc.write_index(manifest, f"{folder}/index")
    index = warc.CaptureIndex(directory, folder)
    assert sorted(r[0] for r in index.fetch("https://a.org/#top")) == ["1", "5", "5"] and index.fetch("http://nowhere/") == []
    assert [r[2] for r in index.fetch("http://z/")] == [b"<p>Two</p>"]
    file, offset, length = index.captures("http://z/")[0]
    store, root = index.archive
    text = gzip.decompress(warc.read_range(store, f"{root}/{file}", offset, length))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"<p>Two</p>\r\n\r\n")


def test_lookup_is_a_binary_search(spark, monkeypatch):
    """A look-up by key reads a logarithm of the directory's lines, and finds every capture, over block edges too."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    rows = [(i, f"http://h{i // 3:03d}.org/{'é' * (i % 2)}", f"page {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = warc.CaptureIndex(*warc.archive(df))
    met, read = [], warc.SortedLines.__getitem__
    monkeypatch.setattr(warc.SortedLines, "__getitem__", lambda self, k: met.append(k) or read(self, k))
    for url in ("http://h000.org/", "http://h077.org/é", "http://h199.org/", "http://h200.org/", "http://a/"):
        met.clear()
        assert sorted(int(r[0]) for r in index.fetch(url)) == [i for i, u, _ in rows if u == url]
        assert len(met) <= 14
    assert len(index.directory) >= 300


def test_directory_in_parts(spark, monkeypatch):
    """Each range of keys has files of its own; look-ups go over their borders, and only names and sizes come to the driver."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    rows = [(i, f"http://h{i // 3:03d}.org/{'é' * (i % 2)}" if i % 5 else "http://hot.org/", f"page {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    directory, folder = warc.archive(df)
    monkeypatch.setattr(warc, "DIRECTORY_LINES", 10)
    parts = warc.SortedLines.write(directory, f"{folder}/index")
    assert len(parts) > 5 and sum(n for _, n in parts) == directory.count()
    lines = warc.SortedLines(f"{folder}/index", parts)
    every = [tuple(lines[k]) for k in range(len(lines))]
    assert [x[:2] for x in every] == sorted(x[:2] for x in every) and set(every) == {tuple(r) for r in directory.collect()}
    index = warc.CaptureIndex(directory, folder)
    for url in ("http://hot.org/", "http://h000.org/é", "http://h099.org/é", "http://z/"):
        assert sorted(int(r[0]) for r in index.fetch(url)) == [i for i, u, _ in rows if u == url]
    assert sorted(int(r["id"]) for r in warc.look_up(df.select("url"), directory, folder).collect()) == list(range(300))


def test_shared_segments_are_one_step(spark):
    """Two urls that share 1,000 segments, and one that ends on the way, are a few levels."""
    trap = "/".join(["again"] * 1000)
    rows = [(1, f"http://t.net/{trap}/x"), (2, f"http://t.net/{trap}/y"), (3, f"http://t.net/{'/'.join(['again'] * 500)}"), (4, "http://u.net/a/b/c"), (5, "http://u.net/a/b/d"), (6, "http://u.net/a/b")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("trap", "trap")
    out = {r["page_id"]: r["template"] for r in url_templates.judged(df, queries.URL_RULES).collect()}
    jobs = len(tracker.getJobIdsForGroup("trap"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    shallow = spark.createDataFrame([(i, u.replace("/again" * 1000, "/again" * 2).replace("/again" * 500, "/again")) for i, u in rows], "page_id long, url string")
    spark.sparkContext.setJobGroup("shallow", "shallow")
    few = {r["page_id"]: r["template"] for r in url_templates.judged(shallow, queries.URL_RULES).collect()}
    assert jobs <= len(tracker.getJobIdsForGroup("shallow"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {i: t.replace("/again" * 1000, "/again" * 2).replace("/again" * 500, "/again") for i, t in out.items()} == few


def test_min_bytes(spark, pages):
    directory, folder = warc.archive(pages, min_bytes=5)
    assert {r["record_type"] for r in warc.read_records(directory, folder).where("payload_bytes = 0").collect()} == {"response"}


def test_capture_key():
    assert warc.capture_key("https://WWW.Example.org:443/a?b#c") == "org,example,www)/a?b"
    assert warc.capture_key("http://u@a.org:81") == "org,a:81)/" and warc.capture_key("") == ")/"


def test_op10_equals_sql(spark, sf):
    assert_same(queries.op10_warc(spark, sf).toPandas(), oracle_rows(queries.ORACLE_SQL["op10_warc"], sf))
