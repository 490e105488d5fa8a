"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, importance, lexical, line_dedup, media, ngram_join, packing, quality, templates, token_counts, url_filter, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model)


@query("""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS sh
  FROM words
), spread AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS s FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM spread a JOIN spread b ON a.s = b.s AND a.doc_id <> b.doc_id AND a.n * 9 <= b.n * 10 AND b.n * 9 <= a.n * 10
  GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT sets.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
""")
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


@query("""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(r.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN r.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated r ON keyed.k = r.k GROUP BY doc_id
""")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedupe_lines(table(spark, sf_dir, "documents"), min_docs=10, min_points=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024)


@query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query("""
WITH paged AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: (['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001',
    '1010', '1011', '1100', '1101', '1110', '1111'])[1 + instr('0123456789abcdef', hex[i]) - 1]), '') AS b FROM paged
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda g: ('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[1 + CAST(list_sum(list_transform(range(0, 5),
         lambda k: CAST(b[5 * g + k + 1] AS INT) * CAST(pow(2, 4 - k) AS INT))) AS INT)]), '') AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY hex) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY hex) THEN NULL ELSE max(page_id) OVER (PARTITION BY hex) END AS refers_to
FROM bits
""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = warc.write_archives(pages, min_bytes=0)
    read = warc.read_archives(archives)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op2_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query()
def op4_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query(r"""
WITH split AS (
  SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)', 1)) AS host,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)', 2), '/'), lambda s: s <> '') AS segs,
         1704067200 + CAST('0x' || substr(md5(concat_ws('|', page_id, url)), 1, 8) AS BIGINT) % 31622400 AS fetched_at
  FROM pages
), asked AS (
  SELECT page_id, url, fetched_at, unnest([{'kind': 'host', 'pattern': host, 'specific': 65536}]
    || list_transform(range(1, len(string_split(host, '.')) + 1), lambda k: {'kind': 'domain', 'pattern': array_to_string(string_split(host, '.')[k:], '.'),
         'specific': CAST(len(string_split(host, '.')) - k AS INT)})
    || list_transform(range(1, len(segs) + 1), lambda k: {'kind': 'prefix', 'pattern': host || '/' || array_to_string(segs[1:k], '/'), 'specific': CAST(131072 + k AS INT)})) AS p
  FROM split WHERE host <> ''
), listed AS (
  SELECT kind, pattern, listed_at, max(action) AS action FROM (
    SELECT kind, pattern, (['block', 'allow', 'remove'])[1 + code % 3] AS action, 1704067200 + code % 31622400 AS listed_at FROM (
      SELECT kind, pattern, CAST('0x' || substr(md5(kind || '|' || pattern || '|' || turn), 1, 8) AS BIGINT) AS code
      FROM (SELECT DISTINCT p.kind AS kind, p.pattern AS pattern FROM asked), range(4) AS t(turn)))
  GROUP BY ALL
), hits AS (
  SELECT a.page_id, a.url, a.fetched_at, a.p.specific AS specific, l.kind, l.pattern, l.action, l.listed_at
  FROM asked a ASOF JOIN listed l ON a.p.kind = l.kind AND a.p.pattern = l.pattern AND a.fetched_at >= l.listed_at
), best AS (
  SELECT page_id, url, fetched_at, max_by({'kind': kind, 'pattern': pattern, 'action': action, 'listed_at': listed_at}, specific) AS hit
  FROM hits WHERE action <> 'remove' GROUP BY ALL
)
SELECT s.page_id, s.url, s.fetched_at, CASE WHEN hit.action = 'block' THEN 'blocked' ELSE 'allowed' END AS verdict, hit.kind AS kind, hit.pattern AS pattern,
       hit.listed_at AS listed_at
FROM split s LEFT JOIN best b ON s.page_id = b.page_id AND s.url = b.url AND s.fetched_at = b.fetched_at
""")
def op7_temporal_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = url_filter.filter_captures(url_filter.dated_captures(pages), url_filter.listed_from_pages(pages))
    return found.withColumns({"fetched_at": F.unix_seconds("fetched_at"), "listed_at": F.unix_seconds("listed_at")})


@query()
def op10_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copy_groups(media.rendered(table(spark, sf_dir, "embeddings")))


@query(r"""
WITH terms AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)
), lengths AS (SELECT row, doc_id, count(*) AS n FROM terms GROUP BY ALL
), corpus AS (SELECT count(*) AS docs, sum(n) AS total FROM lengths
), tfs AS (SELECT row, term, count(*) AS tf FROM terms GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM corpus) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs GROUP BY term
), asked AS (
  SELECT item, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
), scored AS (
  SELECT item, item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (row), corpus
  WHERE doc_id IS NOT NULL GROUP BY item, item_id, row, doc_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 20
""")
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


#: Words of a text in DuckDB: A-Z in lower case, runs of ASCII letters and digits and of characters beyond ASCII.
WORDS_SQL = r"""unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word"""


@query(f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS steps
), numbered AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents
), words AS (SELECT row, {WORDS_SQL} FROM numbered
), target AS (SELECT {WORDS_SQL} FROM benchmark
), buckets AS (
  SELECT word, xor(list_reduce(range(octet_length(encode(word))), lambda c, i: xor(c >> 8,
           steps[1 + (xor(c, CAST('0x' || substr(hex(encode(word)), 1 + 2 * i, 2) AS BIGINT)) & 255)]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM words UNION SELECT word FROM target), crc_table
), own AS (SELECT bucket, count(*) AS s FROM words JOIN buckets USING (word) GROUP BY bucket
), wanted AS (SELECT bucket, count(*) AS t FROM target JOIN buckets USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT sum(s) FROM own) + 10000) / (CAST(s + 1 AS DOUBLE) * (coalesce((SELECT sum(t) FROM wanted), 0) + 10000)))) AS BIGINT) AS gain
  FROM own LEFT JOIN wanted USING (bucket)
), weighed AS (SELECT row, count(*) AS n, sum(gain) AS weight FROM words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) AS BIGINT)
         + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM numbered LEFT JOIN weighed USING (row)
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY CASE WHEN n_features >= 20 THEN 0 ELSE 1 END, score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank FROM ranked
""")
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, min_words=20, seed=2024, longest=1, buckets=10_000)


@query()
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=4096)
