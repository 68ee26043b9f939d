"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_records, bpe, decontaminate, html_extract, licenses, line_dedup, minhash, quality, warc, winnowing

#: Folder of the public tokenizer files; every executor has it at this place.
TOKENIZERS = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_next(_table(spark, sf_dir, "documents"))


def op2_binary_records(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    manifest = binary_records.write_records(_table(spark, sf_dir, "documents"), binary_records.byte_level(f"{tokenizers}/byte_bpe_50k.json"), end_id=0)
    return binary_records.read_back(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, counts=True).select("doc_id", "n_lines", "n_deleted", "text")


def op5_bpe(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), f"{tokenizers}/word_bpe_49k.json", digests=True)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    manifest = warc.write_archives(warc.mark_revisits(pages), warc.train_dictionary(pages))
    return warc.read_archives(manifest).drop("url")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return quality.with_score(d, model).select("doc_id", quality.is_held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), n=3, percent=85).drop("key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_winnowing, op2_binary_records, op3_decontamination, op4_line_dedup, op5_bpe, op6_license_scan, op7_warc, op8_quality, op9_html_extraction, op10_minhash)}

_OP3 = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k + 1:k + least(10, len(w))], ' ') AS g
  FROM b, unnest(range(len(w) - least(10, len(w)) + 1)) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, k, n, array_to_string(w[k + 1:k + n], ' ') AS g
  FROM d, sizes, unnest(range(greatest(len(w) - n + 1, 0))) AS t(k)),
hit AS (SELECT r, k, bw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT r, count(DISTINCT k + x) AS n_hit FROM hit, unnest(range(n)) AS u(x) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN items USING (r)
"""

_OP4 = r"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents),
raw AS (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS k, unnest(string_split(text, chr(10))) AS s FROM docs WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, k, s, len(list_filter(regexp_split_to_array(s, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS w, regexp_replace(s, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS t FROM raw),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY k) AS i FROM l WHERE w > 0),
win AS (SELECT a.doc_id, a.text, a.i, b.i AS j, sum(c.w) AS words, string_agg(c.t, chr(10) ORDER BY c.i) AS g
  FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND a.text = b.text AND b.i BETWEEN a.i AND a.i + 9
  JOIN seq c ON a.doc_id = c.doc_id AND a.text = c.text AND c.i BETWEEN a.i AND b.i GROUP BY ALL HAVING sum(c.w) >= 10),
dup AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY doc_id, text, i) AS place FROM win),
gone AS (SELECT DISTINCT doc_id, text, i + x AS i FROM dup, unnest(range(j - i + 1)) AS u(x) WHERE place > 1),
marked AS (SELECT l.doc_id, l.text, l.k, l.s, l.w, gone.i IS NOT NULL AS cut FROM l LEFT JOIN seq USING (doc_id, text, k) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.text = l.text AND gone.i = seq.i),
done AS (SELECT doc_id, text, count(*) FILTER (w > 0) AS n_lines, count(*) FILTER (cut) AS n_deleted, coalesce(string_agg(s, chr(10) ORDER BY k) FILTER (NOT cut), '') AS kept FROM marked GROUP BY doc_id, text)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted, kept AS text
FROM documents d LEFT JOIN done ON d.doc_id = done.doc_id AND d.text = done.text
"""

_OP7 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM q LEFT JOIN f USING (h)
"""

_OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) END AS g FROM d),
x AS MATERIALIZED (SELECT doc_id, len(g) AS n, hash(unnest(g)) AS h FROM s),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(doc_id, place) AS (SELECT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.place)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(c, s.doc_id)) AS kept
FROM s LEFT JOIN (SELECT doc_id, min(place) AS c FROM r GROUP BY doc_id) USING (doc_id)
"""

ORACLES: dict[str, str] = {"op3_decontamination": _OP3, "op4_line_dedup": _OP4, "op6_license_scan": licenses.oracle(), "op7_warc": _OP7, "op10_minhash": _OP10}
