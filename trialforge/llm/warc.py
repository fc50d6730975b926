"""WARC archives with a two-level capture index.

write_archives() writes one WARC/1.1 record per row, each a gzip member of its own, into files of the shared folder,
and returns a manifest of where each record lies. Files are named by task attempt, and only those that the stored
manifest names are read, so attempts of lost executors do no harm. Rows with equal payloads of `min_bytes` or more
become one response and revisits of it. Which is which is settled on digests alone; a revisit is written without its
payload, and a sieve of the repeated digests keeps unique payloads out of the shuffle: only one payload of each repeated
digest (and task) is moved.

write_index() sorts the captures by reversed-host key into compressed blocks of lines; a sparse directory holds the
first and last key of each block and its place, one line for BLOCK_LINES captures, in sorted files of their ranges of
keys; only those files' names and sizes go through the driver. look_up() takes
any number of urls: their keys are sorted and dealt into ranges, each range searches the directory by bisection, by
range reads, from where the last key was found; the blocks that were met are read once each, searched by bisection for
the keys that want them, and the records read in order of their place, neighbouring ones in one read. CaptureIndex does
the same for one url in the driver; read_records() reads all captures of an index without a search.

Edge cases: a null payload counts as empty, a null url as the empty url; a null id is written as an empty one and comes
back null, and never is a response that other rows refer to unless its whole group has none. Ids may be of any type
that has an order; they are written as text. Repeated rows are written each, and share their verdict. An empty table
makes no archive and gives no rows; urls without a capture give none. Other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.llm._common import new_path, raw_text, stored
from trialforge.llm.exact_dedup import Sieve

BLOCK_LINES = 3000
#: Lines of one file of the directory.
DIRECTORY_LINES = 100_000
ROLL_BYTES = 256_000_000
READ_BYTES, TASK_LINES = 8_000_000, 20_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def store_of(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The store that holds a URI or a plain path, and the path in it."""
    return arrow_fs.FileSystem.from_uri(uri) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri) else (arrow_fs.LocalFileSystem(), uri)


def capture_key(url: str) -> str:
    """Reversed host, comma-separated, then path and query: "org,example,www)/a?b". Fragments and schemes are dropped."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    at = min([i for c in "/?" if (i := rest.find(c)) >= 0], default=len(rest))
    host, path = rest[:at].lower().rsplit("@", 1)[-1], rest[at:]
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if colon and port not in ("80", "443") else "") + ")" + (path if path.startswith("/") else "/" + path)


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page: str | None, url: str, payload: bytes | None, size: int, sha1: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """One record, uncompressed. A revisit (no payload) has the HTTP headers of its payload of `size` bytes."""
    name = lambda x: f"<urn:page:{'' if x is None else 'x' + quote(x, safe='')}>"
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\r\n]+", " ", url)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest_text(sha1)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP headers and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, http, payload


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes all rows below folder; the stored manifest: id, key, file, offset, length (of the compressed record)."""
    own = raw_text(F.col(payload_col))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), own.alias("payload"), F.octet_length(own).cast("long").alias("size"), F.unhex(F.sha1(own)).alias("sha")).withColumn("fp", F.xxhash64("sha"))
    shared = stored(rows.where(F.col("size") >= min_bytes).groupBy("sha", "fp").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "fp", "first", F.lit(True).alias("shared")), "payloads")
    suspect = Sieve(shared.select("fp")).may_hold(F.col("fp"))
    none = F.lit(None)
    alone = rows.withColumn("suspect", suspect).where("not suspect").select("id", "url", "payload", "size", "sha", none.cast("string").alias("refers_to"))
    # What is left: rows without their payloads, their verdicts, and one payload of each digest.
    light = rows.select("id", "url", "size", "sha", "fp").withColumn("suspect", suspect).where("suspect").select("id", "url", "size", "sha").join(shared.select("sha", "first", "shared"), "sha", "left")
    again = F.coalesce("shared", F.lit(False)) & (F.col("size") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("first"))
    told = light.withColumn("revisit", again)
    payloads = rows.select("sha", "payload", "fp").withColumn("suspect", suspect).where("suspect").groupBy("sha").agg(F.first("payload").alias("payload"))
    revisits = told.where("revisit").select("id", "url", none.cast("binary").alias("payload"), "size", "sha", F.col("first").cast("string").alias("refers_to"))
    responses = told.where("not revisit").join(payloads, "sha").select("id", "url", "payload", "size", "sha", none.cast("string").alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        name, out, at, number = "", None, 0, 0
        try:
            for x in batches:
                lines = []
                for id_, url, payload, size, sha, first in zip(x["id"], x["url"], x["payload"], x["size"].tolist(), x["sha"], x["refers_to"], strict=True):
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(record(id_, url, payload, size, sha, first)) + packer.flush()
                    if out is None or at + len(data) > ROLL_BYTES and at:
                        if out is not None:
                            out.close()
                        name, at, number = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.gz", 0, number + 1
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(data)
                    lines.append((id_, capture_key(url), name, at, len(data)))
                    at += len(data)
                yield pd.DataFrame(lines, columns=["id", "key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    every = [x.withColumn("id", F.col("id").cast("string")) for x in (alone, revisits, responses)]
    return stored(every[0].unionByName(every[1]).unionByName(every[2]).mapInPandas(write, "id string, key string, file string, offset long, length long"), "manifest")


def write_index(manifest: DataFrame, folder: str) -> DataFrame:
    """Writes the blocks below folder; the stored directory: first, last (keys), file, offset, length, lines."""
    ordered = manifest.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        name = f"index-{context.partitionId():06d}-{context.taskAttemptId()}.cdx.z"
        out, at, lines, found = None, 0, [], []

        def block() -> None:
            nonlocal out, at
            if out is None:
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            data = zlib.compress("\n".join(lines).encode(), 6)
            out.write(data)
            found.append((json.loads(lines[0])[0], json.loads(lines[-1])[0], name, at, len(data), len(lines)))
            at += len(data)
            lines.clear()

        for x in batches:
            for row in zip(x["key"], x["file"], x["offset"].tolist(), x["length"].tolist(), strict=True):
                lines.append(json.dumps(row, ensure_ascii=False))
                if len(lines) == BLOCK_LINES:
                    block()
        if lines:
            block()
        if out is not None:
            out.close()
        yield pd.DataFrame(found, columns=["first", "last", "file", "offset", "length", "lines"])

    return stored(ordered.mapInPandas(write, "first string, last string, file string, offset long, length long, lines long"), "directory")


def read_range(store: arrow_fs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with store.open_input_file(path) as f:
        return f.read_at(length, offset)


def block_lines(data: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]


def described(data: bytes) -> tuple:
    """id, payload bytes, digest, type and what it refers to, of an uncompressed record."""
    fields, http, payload = parsed(data)
    page = lambda x: unquote(m[1]) if (m := re.fullmatch(r"<urn:page:x(.*)>", x)) else None
    revisit = fields["WARC-Type"] == "revisit"
    size = int(re.search(rb"Content-Length: (\d+)", http)[1]) if revisit else len(payload)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and digest != digest_text(hashlib.sha1(payload).digest()):
        raise ValueError("a payload does not match its digest")
    return page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], None if revisit else payload, size, digest, fields["WARC-Type"], page(fields["WARC-Refers-To"]) if revisit else None


RECORD = "id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"
PLACES = "key string, file string, offset long, length long"


def records_at(places: DataFrame, folder: str, tasks: int) -> DataFrame:
    """RECORD of the records at file, offset and length, in order of their place; neighbouring ones are read at once."""

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(f"{folder}/archive")
        for x in batches:
            rows, out, k = list(zip(x["file"], x["offset"].tolist(), x["length"].tolist(), strict=True)), [], 0
            while k < len(rows):
                file, begin, length = rows[k]
                end, last = begin + length, k + 1
                while last < len(rows) and rows[last][:2] == (file, end) and end - begin < READ_BYTES:
                    end, last = end + rows[last][2], last + 1
                data = memoryview(read_range(store, f"{root}/{file}", begin, end - begin))
                for _, offset, size in rows[k:last]:
                    out.append(described(zlib.decompress(data[offset - begin : offset - begin + size], 31)))
                k = last
                if sum(r[3] for r in out) > READ_BYTES:
                    yield frame(out)
                    out = []
            yield frame(out)

    dealt = places.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / (READ_BYTES // 4))).sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(records, RECORD)


def tasks_for(spark: SparkSession, lines: int) -> int:
    """Places are few bytes but stand for much reading: the number of tasks follows the captures, not the shuffled bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines // TASK_LINES)


def read_records(directory: DataFrame, folder: str) -> DataFrame:
    """RECORD of every capture in the index, without a search."""

    def captures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(f"{folder}/index")
        for x in batches:
            for file, offset, length in zip(x["file"], x["offset"].tolist(), x["length"].tolist(), strict=True):
                yield pd.DataFrame(block_lines(read_range(store, f"{root}/{file}", offset, length)), columns=["key", "file", "offset", "length"])

    tasks = tasks_for(directory.sparkSession, directory.agg(F.sum("lines")).first()[0] or 0)
    return records_at(directory.select("file", "offset", "length").repartition(tasks, "file", "offset").mapInPandas(captures, PLACES), folder, tasks)


def look_up(urls: DataFrame, directory: DataFrame, folder: str, url_col: str = "url") -> DataFrame:
    """RECORD of every capture of the urls, each capture once, found through the index."""
    spark, parts = urls.sparkSession, SortedLines.write(directory, f"{folder}/index")
    lines, count = directory.agg(F.sum("lines").alias("n")).first()["n"], sum(n for _, n in parts)

    @F.pandas_udf("string")
    def key_of(url: pd.Series) -> pd.Series:
        return url.map(capture_key)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines, at = SortedLines(f"{folder}/index", parts), 0
        for x in batches:
            out = []
            for key in x["key"]:
                at = lines.first_from(key, at)
                k = at
                while k < count and (line := lines[k])[0] <= key:
                    out.append((key, *line[2:5]))
                    k += 1
            yield pd.DataFrame(out, columns=["key", "file", "offset", "length"])

    def captures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(f"{folder}/index")
        at, rows, keys = None, [], []
        for x in batches:
            out = []
            for key, *place in zip(x["key"], x["file"], x["offset"].tolist(), x["length"].tolist(), strict=True):
                if place != at:
                    at, rows = place, block_lines(read_range(store, f"{root}/{place[0]}", *place[1:]))
                    keys = [r[0] for r in rows]
                out += rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
            yield pd.DataFrame(out, columns=["key", "file", "offset", "length"])

    tasks = tasks_for(spark, lines or 0)
    wanted = urls.select(F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url")).distinct().select(key_of("url").alias("key")).distinct()
    met = wanted.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInPandas(blocks, PLACES)
    # A key with many captures is many blocks, and each block is a task's work of its own.
    dealt = met.repartition(tasks, "file", "offset").sortWithinPartitions("file", "offset", "key")
    return records_at(dealt.mapInPandas(captures, PLACES), folder, tasks)


class SortedLines:
    """The directory as files of lines in the order of keys, and, for each, one of the places where its lines end; a line is two range reads. parts: the files' names and numbers of lines, in order."""

    def __init__(self, folder: str, parts: list[tuple[str, int]]):
        self.store, self.root = store_of(folder)
        self.names, self.upto = [x[0] for x in parts], [0]
        for _, lines in parts:
            self.upto.append(self.upto[-1] + lines)
        self.count, self.met, self.part, self.files = self.upto[-1], (-1, None), -1, None

    @staticmethod
    def write(directory: DataFrame, folder: str) -> list[tuple[str, int]]:
        """Writes the files below folder, each range of keys its own; their names and sizes, one for DIRECTORY_LINES lines, which each stand for BLOCK_LINES captures. Files of tasks that were repeated are not named."""
        spark, order = directory.sparkSession, ["first", "last", "file", "offset"]
        columns = directory.columns

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            store, root = store_of(folder)
            store.create_dir(root, recursive=True)
            name, end, count, lines, ends = f"directory-{uuid.uuid4().hex}", 0, 0, None, None
            for x in batches:
                if len(x) and lines is None:
                    lines, ends = (store.open_output_stream(f"{root}/{name}.{kind}", compression=None) for kind in ("lines", "ends"))
                    ends.write((0).to_bytes(8, "little"))
                for row in zip(*(x[c].tolist() for c in columns), strict=True):
                    line = json.dumps(row, ensure_ascii=False).encode()
                    lines.write(line)
                    end, count = end + len(line), count + 1
                    ends.write(end.to_bytes(8, "little"))
            if lines is not None:
                lines.close(), ends.close()
                yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "name": [name], "lines": [count]})

        n = max(1, -(-directory.count() // DIRECTORY_LINES))
        dealt = directory.repartitionByRange(n, *order).sortWithinPartitions(*order) if n > 1 else directory.coalesce(1).sortWithinPartitions(*order)
        rows = dealt.mapInPandas(run, "part int, name string, lines long").collect()
        return [(r["name"], r["lines"]) for r in sorted(rows, key=lambda r: r["part"])]

    def first_from(self, key: str, at: int = 0) -> int:
        """The first block from `at` on whose last key is not below key: steps that double, then bisection between the last two."""
        step = 1
        while at + step < self.count and self[at + step - 1][1] < key:
            at, step = at + step, 2 * step
        return bisect.bisect_left(self, key, at, min(self.count, at + step), key=lambda x: x[1])

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, k: int) -> list:
        """first, last, file, offset, length, lines of block k."""
        if not 0 <= k < self.count:
            raise IndexError(k)
        if self.met[0] == k:
            return self.met[1]
        part = bisect.bisect_right(self.upto, k) - 1
        if part != self.part:
            self.part, self.files = part, [self.store.open_input_file(f"{self.root}/{self.names[part]}.{kind}") for kind in ("lines", "ends")]
        lines, ends = self.files
        places = ends.read_at(16, 8 * (k - self.upto[part]))
        begin, end = int.from_bytes(places[:8], "little"), int.from_bytes(places[8:], "little")
        self.met = k, json.loads(lines.read_at(end - begin, begin))
        return self.met[1]


class CaptureIndex:
    """Look-ups by url. The directory has one line for BLOCK_LINES captures; it is sorted once, and a look-up reads only the lines that its binary search meets."""

    def __init__(self, directory: DataFrame, folder: str):
        self.directory = SortedLines(f"{folder}/index", SortedLines.write(directory, f"{folder}/index"))
        self.index, self.archive = store_of(f"{folder}/index"), store_of(f"{folder}/archive")

    def captures(self, url: str) -> list[tuple[str, int, int]]:
        """file, offset and length of each capture of a url."""
        key, out = capture_key(url), []
        for k in range(bisect.bisect_left(self.directory, key, key=lambda x: x[1]), len(self.directory)):
            first, _, file, offset, length, _ = self.directory[k]
            if first > key:
                break
            rows = block_lines(read_range(self.index[0], f"{self.index[1]}/{file}", offset, length))
            keys = [r[0] for r in rows]
            out += [tuple(r[1:]) for r in rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
        return out

    def fetch(self, url: str) -> list[tuple]:
        """What described() says of each capture of a url."""
        store, root = self.archive
        return [described(zlib.decompress(read_range(store, f"{root}/{file}", offset, length), 31)) for file, offset, length in self.captures(url)]


def archive(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes archives and index into the shared folder (or `folder`); the directory, and the folder with both."""
    spark: SparkSession = pages.sparkSession
    folder = folder or new_path(spark, f"warc-{uuid.uuid4().hex[:8]}")
    manifest = write_archives(pages, f"{folder}/archive", min_bytes, id_col, url_col, payload_col)
    return write_index(manifest, f"{folder}/index"), folder
