"""The thin queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.llm import exact_dedup, language_id, near_dedup, packing, quality, row_patterns, sentence_pieces, simhash, suffix_tree, url_templates, vector_codes, warc
from trialforge.llm._common import fold, read
from trialforge.llm.token_counts import count_tokens

ORACLE_SQL: dict[str, str] = {}

#: The rules of op4.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text under the 32,000-piece model, and whether decoding gives the text back.

    Null and empty texts have no ids; repeated rows get a row each; a null id stays null; an empty table gives no rows. A
    text with the sign that the model puts for spaces does not come back as it was.
    """
    out = sentence_pieces.encoded(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "round_trip")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text under the byte-level vocabulary.

    Null counts as empty (0 bytes, 0 tokens); special strings inside texts are one token; repeated rows get a row each; an
    empty table gives no rows.
    """
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents.

    Null counts as empty, so null and empty texts are one group; repeated rows are members each; an empty table gives no
    rows.
    """
    return exact_dedup.annotate(read(spark, sf_dir, "documents"))


ORACLE_SQL["op5_exact_dedup"] = """
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
    g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document.

    Null and empty texts have no words and fail the base rule; without labels of both kinds the base rule alone decides;
    repeated rows get a row each; an empty table gives no rows.
    """
    out = quality.judged(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "stats.n_words", "stats.word_chars", "stats.n_symbols", "stats.n_dup_lines", "stats.n_repeat_words", "stats.base_failed", "kept", F.col("stats.good").alias("quality_score"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens.

    A null or empty text is its end id alone; null sources are one queue; repeated rows are packed each; an empty table
    gives no rows.
    """
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url.

    A null url, or one without "://", has an empty host and path and no rule; repeated rows get a row each; an empty table
    gives no rows.
    """
    return url_templates.judged(read(spark, sf_dir, "pages"), URL_RULES)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them.

    Null texts and texts without a letter are "und" with score 0, and so is all where nothing can be learned; null labels
    are no training rows; repeated rows get a row each; an empty table gives no rows.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.identified(docs, ~fold(F.col("doc_id"), 4, 2))
    return out.select("row.doc_id", fold(F.col("row.doc_id"), 4, 2).alias("held_out"), "told.*")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, and every page's url looked up in the capture index and read back.

    Null payloads count as empty and null urls as the empty url; repeated rows are written and read each; an empty table
    gives no rows.
    """
    pages = read(spark, sf_dir, "pages")
    directory, folder = warc.archive(pages, min_bytes=0)
    kind = pages.schema["page_id"].dataType
    back = warc.look_up(pages, directory, folder)
    return back.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


# base32 by five bits at a time over the 160 bits of the digest
ORACLE_SQL["op10_warc"] = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
    bits AS (SELECT page_id, octet_length(b) AS payload_bytes, h, CAST(unhex(h) AS BIT)::VARCHAR AS v FROM p),
    d AS (SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(v, CAST(5 * i + j + 1 AS BIGINT), 1) AS INT) * CAST(pow(2, 4 - j) AS INT))) AS BIGINT), 1)), '') AS payload_digest FROM bits),
    f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM d JOIN f USING (h)"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents.

    Null and empty texts have no shingles and are linked with nothing; texts under five words have one; repeated rows are
    one component; rows with a null id link nothing; an empty table gives no rows.
    """
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under a suffix tree learned from six sevenths of them.

    Null and empty texts are their end token alone; a null id is held out by the hash of the empty text; repeated rows
    count and are answered each; an empty table gives no rows.
    """
    return suffix_tree.scored(read(spark, sf_dir, "documents"), ~fold(F.col("doc_id"), 7, 2))


# Words by white space, shingles as joined words, links by shared shingles, components by the smallest reachable id.
ORACLE_SQL["op2_near_dedup"] = """
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS x FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) >= 5 THEN list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' ')) WHEN len(x) > 0 THEN [array_to_string(x, ' ')] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)"""


def op11_row_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of A (D+ U+)+ P? in each client's clicks.

    Rows without a client or a time are dropped, repeated rows count once; a null value fits no letter, a null kind
    neither D, U nor P; rows that share time and click_id are taken by value and kind; an empty table gives no rows.
    """
    clicks = read(spark, sf_dir, "clicks")
    moves = F.coalesce(F.col("kind") != "error", F.lit(False))
    found = row_patterns.zigzags(clicks, "client_id", "ts", "click_id", row_patterns.cents(F.col("value")), moves, F.coalesce(F.col("kind") == "click", F.lit(False)))
    return found.withColumnRenamed("total", "sum_cents")


# The body's end is the last U before the next row that is neither D nor U; only the row after it may be P.
ORACLE_SQL["op11_row_patterns"] = """
    WITH d AS (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
    c AS (SELECT client_id, click_id, ts, kind, CAST(floor(100 * value + 0.5) AS BIGINT) AS cents, row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id) AS i FROM d),
    p AS (SELECT *, lag(cents) OVER w AS before, ts - lag(ts) OVER w <= INTERVAL 30 MINUTE AS near FROM c WINDOW w AS (PARTITION BY client_id ORDER BY i)),
    l AS (SELECT *, CASE WHEN near AND kind <> 'error' AND cents < before THEN 'D' WHEN near AND kind <> 'error' AND cents > before THEN 'U' ELSE 'x' END AS letter FROM p),
    e AS (SELECT client_id, click_id, i, cents, letter, coalesce(near AND kind = 'click', false) AS ready, sum(coalesce(cents, 0)) OVER (PARTITION BY client_id ORDER BY i) AS total, lead(letter) OVER (PARTITION BY client_id ORDER BY i) AS next,
        coalesce(min(CASE WHEN letter = 'x' THEN i END) OVER (PARTITION BY client_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 9000000000000) AS stop,
        max(CASE WHEN letter = 'U' THEN i END) OVER (PARTITION BY client_id ORDER BY i) AS last_u FROM l),
    n AS (SELECT client_id, max(i) AS n FROM e GROUP BY client_id),
    t AS (SELECT client_id, string_agg(letter, '' ORDER BY i) AS letters FROM e GROUP BY client_id),
    s AS (SELECT a.client_id, a.i, a.click_id, a.cents, a.total, u.last_u FROM e a JOIN n USING (client_id) JOIN e u ON u.client_id = a.client_id AND u.i = least(a.stop - 1, n.n)
        WHERE a.cents IS NOT NULL AND a.next = 'D' AND u.last_u > a.i + 1),
    m AS (SELECT s.*, coalesce(q.ready AND q.cents >= s.cents, false) AS p FROM s LEFT JOIN e q ON q.client_id = s.client_id AND q.i = s.last_u + 1)
    SELECT m.client_id, row_number() OVER (PARTITION BY m.client_id ORDER BY m.i) AS match_no, m.click_id AS first_id, z.click_id AS last_id, z.i - m.i + 1 AS n_rows, CAST(z.total - m.total + m.cents AS BIGINT) AS sum_cents,
        sha256('A' || substr(t.letters, m.i + 1, m.last_u - m.i) || CASE WHEN m.p THEN 'P' ELSE '' END) AS labels_sha256
    FROM m JOIN e z ON z.client_id = m.client_id AND z.i = m.last_u + CAST(m.p AS INT) JOIN t ON t.client_id = m.client_id"""


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and components of those that differ in four bits at most.

    Null and empty texts have the fingerprint zero and link like any other; texts under four words are one shingle;
    repeated rows are one component; an empty table gives no rows.
    """
    return simhash.similar(read(spark, sf_dir, "documents"), limit=4, words=4, seed=42)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every embedding under codebooks of 64 entries for each of 16 parts, after two rounds.

    Null vectors and those with null or non-finite components are dropped; repeated rows get a row each, and null labels
    are one group; an empty table gives no rows.
    """
    told, books = vector_codes.compressed(read(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    return told.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


_ASSIGN = """SELECT id, p, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.id, v.p, v.x, b.c, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i]))) AS d FROM v JOIN {book} b USING (p)) GROUP BY ALL"""
_MOVE = """SELECT b.p, b.c, CASE WHEN m.x IS NULL THEN b.x ELSE m.x END AS x FROM {book} b LEFT JOIN (SELECT p, c, list(f ORDER BY i) AS x FROM (
    SELECT p, c, i, CAST((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f FROM {told}, range(1, 1000) r(i) WHERE i <= len(x) GROUP BY p, c, i) GROUP BY p, c) m ON m.p = b.p AND m.c = b.c"""
ORACLE_SQL["op13_vector_codes"] = f"""
    WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(256 * e::DOUBLE) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    v AS MATERIALIZED (SELECT vec_id AS id, p, x[p * (len(x) // 16) + 1:(p + 1) * (len(x) // 16)] AS x FROM k, range(16) t(p)),
    b0 AS MATERIALIZED (SELECT p, c, x FROM v JOIN (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM k QUALIFY c < 64) USING (id)),
    a0 AS MATERIALIZED ({_ASSIGN.format(book="b0")}), b1 AS MATERIALIZED ({_MOVE.format(book="b0", told="a0")}),
    a1 AS MATERIALIZED ({_ASSIGN.format(book="b1")}), b2 AS MATERIALIZED ({_MOVE.format(book="b1", told="a1")}),
    a2 AS MATERIALIZED ({_ASSIGN.format(book="b2")}),
    t AS (SELECT id, string_agg(lower(printf('%02x', c)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY id),
    h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM b2)
    SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN t ON t.id = k.vec_id, h"""
