"""Registered queries of the operators: each over its whole table, with its check SQL where
SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.llm import (filter_audit, language_id, lsh_forest, mixing, packing, sharding, warc,
                          whitening)
from wardline.llm.html_text import extract
from wardline.llm.line_dedup import line_dedup
from wardline.llm.minhash_dedup import near_duplicates
from wardline.llm.nn_descent import near_vectors
from wardline.llm.substring_dedup import substring_dedup

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_substring_dedup(spark, sf):
    return substring_dedup(table(spark, sf, "documents"))


@query
def op2_best_fit_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@query
def op8_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", language_id.held_out().alias("held_out"), "text")
    return language_id.identify(rows, language_id.learnable(docs), ["doc_id", "held_out"])


@query
def op9_sharding(spark, sf):
    return sharding.shard_by_bytes(table(spark, sf, "documents"))


ORACLE["op9_sharding"] = """
WITH t AS (SELECT list(list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
               CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY v) AS tab
           FROM (SELECT unnest(range(256)) AS v)),
d AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 16 AS BIGINT) AS size,
             xor(4294967295, list_reduce(list_concat([4294967295], list_transform(
                 regexp_extract_all(hex(encode(text)), '..'),
                 lambda h: CAST(concat('0x', h) AS BIGINT))),
                 lambda c, v: xor(tab[xor(c & 255, v) + 1], c >> 8))) AS text_crc32
      FROM documents, t),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS whole,
             row_number() OVER (ORDER BY doc_id) - 1 AS place FROM d),
s AS (SELECT *, CAST(least((2 * upto - size) * 40 // (2 * whole), 39) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM s"""


@query
def op10_source_mixing(spark, sf):
    docs = table(spark, sf, "documents")
    return mixing.mix(docs, ["doc_id"]).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op5_minhash_dedup(spark, sf):
    return near_duplicates(table(spark, sf, "documents"))


@query
def op7_line_dedup(spark, sf):
    out = line_dedup(table(spark, sf, "documents"), ["doc_id"])
    return out.select("doc_id", "n_lines", "n_removed", "longest_repeat",
                      F.md5("text").alias("text_md5"))


ORACLE["op7_line_dedup"] = """
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
p AS MATERIALIZED (SELECT doc_id, pos, length(ls[pos]) AS chars, md5(ls[pos]) AS line,
             row_number() OVER (ORDER BY doc_id, pos) AS place
      FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, ls FROM d)),
-- runs of k lines that start at several places: k grows by one line a round
f AS (SELECT 1 AS k, doc_id, pos, place, chars, first_place FROM (
        SELECT *, min(place) OVER (PARTITION BY line) AS first_place, count(*) OVER (PARTITION BY line) AS n
        FROM p) WHERE n > 1
      UNION ALL
      SELECT k + 1, doc_id, pos, place, chars, first_place FROM (
        SELECT k, r.doc_id, r.pos, r.place, r.chars,
               min(r.place) OVER (PARTITION BY r.first_place, p.line) AS first_place,
               count(*) OVER (PARTITION BY r.first_place, p.line) AS n
        FROM f r JOIN p ON p.doc_id = r.doc_id AND p.pos = r.pos + r.k) WHERE n > 1),
again AS MATERIALIZED (SELECT * FROM f WHERE first_place < place),
gone AS (SELECT doc_id, list(DISTINCT ln) AS ats FROM (
             SELECT doc_id, pos AS ln FROM again WHERE k = 1 AND chars >= 40
             UNION ALL SELECT doc_id, unnest([pos, pos + 1]) AS ln FROM again WHERE k = 2)
         GROUP BY doc_id),
most AS (SELECT doc_id, max(k) AS longest FROM again GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ats), 0) AS BIGINT) AS n_removed,
       CAST(coalesce(longest, 0) AS BIGINT) AS longest_repeat,
       md5(array_to_string(CASE WHEN ats IS NULL THEN ls ELSE list_select(
           ls, list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(ats, i))) END,
           chr(10))) AS text_md5
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN most USING (doc_id)"""


@query
def op4_lsh_forest(spark, sf):
    return lsh_forest.search(table(spark, sf, "embeddings"))


@query
def op6_nn_descent(spark, sf):
    return near_vectors(table(spark, sf, "embeddings"))


@query
def op3_html_text(spark, sf):
    return extract(table(spark, sf, "pages"))


@query
def op11_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))


@query
def op12_filter_audit(spark, sf):
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


ORACLE["op12_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.bad, 0) AS bad,
             [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
              100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(least < w.doc_id, false)] AS fails
      FROM w JOIN first USING (t) LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
s AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM s a, s b, s c, s d, s e
           WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
m AS (SELECT part, o, s.i AS step, o[s.i] AS f, n, good, bad, fails,
             fails[o[s.i]] AS failing,
             len(list_filter(range(1, s.i), lambda j: fails[o[j]])) > 0 AS gone,
             len(list_filter(fails, lambda x: x)) AS k
      FROM c, orders, s),
r AS (SELECT part, o, step, f, sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN failing AND k = 1 THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN failing AND NOT gone THEN bad ELSE 0 END) AS toxic_lost
      FROM m GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order,
       CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r"""


@query
def op13_warc_archive(spark, sf):
    return warc.archive_digests(table(spark, sf, "pages"))


ORACLE["op13_warc_archive"] = """
WITH t AS (SELECT *, coalesce(html, '') AS body FROM pages),
d AS (SELECT *, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS top FROM t),
b AS (SELECT *, list_transform(range(0, 32), lambda i:
               CAST(concat('0x0', substr(hex, (5 * i) // 4 + 1, 1)) AS INTEGER) * 16
               + CAST(concat('0x0', coalesce(nullif(substr(hex, (5 * i) // 4 + 2, 1), ''), '0'))
                      AS INTEGER)) AS pairs FROM d)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((pairs[i + 1] >> (3 - (5 * i) % 4)) & 31) + 1, 1)),
           '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b"""
