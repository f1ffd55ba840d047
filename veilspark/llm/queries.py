"""The registered queries of this subpackage, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import bpe, decontaminate, language, media, ngramjoin, pagetext, sharding, toxicity, urlrules, warc
from veilspark.llm.common import crc_class, read


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    import public_tokenizers

    return bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts the main text of every page."""
    return pagetext.extract(read(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a record for every page, normalises the archives and reads each record back by the index."""
    index, folder = warc.archive(read(spark, sf_dir, "pages"))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:x-record:(.*)>', 1) AS bigint)")
    return warc.read_records(index, folder).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

# All pairs that share a shingle; labels go along links until none changes.
OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s FROM words
), texts AS (
  SELECT md5(CAST(list_sort(s) AS VARCHAR)) AS c, any_value(s) AS s, len(any_value(s)) AS n, min(doc_id) AS first FROM sets WHERE len(s) > 0 GROUP BY 1
), held AS (
  SELECT c, n, unnest(s) AS g FROM texts
), pairs AS (
  SELECT a.c AS a, b.c AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o FROM held a JOIN held b ON a.g = b.g AND a.c < b.c GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs WHERE 100 * o >= 90 * (na + nb - o)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT c, c FROM texts UNION SELECT r.a, k.b FROM reach r JOIN ways k ON r.b = k.a
), least AS (
  SELECT r.a AS c, min(t.first) AS component_id FROM reach r JOIN texts t ON t.c = r.b GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE l.component_id END AS component_id
FROM sets d LEFT JOIN least l ON len(d.s) > 0 AND l.c = md5(CAST(list_sort(d.s) AS VARCHAR))
"""


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups documents whose 3-word shingles have a Jaccard similarity of at least 0.9."""
    return ngramjoin.near_duplicates(read(spark, sf_dir, "documents"), size=3, share=90)


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), starts AS (
  SELECT item_id, w, least(len(w), 10) AS width, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS words FROM starts
), widths AS (SELECT DISTINCT width FROM windows
), places AS (
  SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM docs, widths WHERE len(w) >= width
), found AS (
  SELECT p.doc_id, p.i, p.width, v.item_id FROM places p JOIN windows v ON v.width = p.width AND v.words = array_to_string(p.w[p.i:p.i + p.width - 1], ' ')
), hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS place FROM found) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       coalesce(t.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN held t ON t.doc_id = d.doc_id
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks the words of every document that lie in a window of a benchmark item."""
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every document as an image, reads it back and computes features."""
    return media.stored_features(read(spark, sf_dir, "documents")).drop("dhash", "tile")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts every document into one of 24 shards by its key, and says where it would go with one more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [(F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    placed = sharding.assign(read(spark, sf_dir, "documents"), "doc_id", [1.0] * 24, [1.0] * 25, columns)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts the language of every document, learnt from those whose class isn't 2."""
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs, language.fitted(docs))
    return found.select("doc_id", (crc_class("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document's toxicity, learnt from labels of documents whose class isn't 0."""
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.fitted(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_class("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


#: The rules of op9: verdict, host and path.
URL_RULES = [urlrules.Rule("allow", "com/"), urlrules.Rule("block", "example.com/en/"), urlrules.Rule("allow", "www.example.com/en/"), urlrules.Rule("block", "net/es/"), urlrules.Rule("block", "net/fr/")]

OP9_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT h.page_id, h.host, h.path, r.host || r.path AS rule, r.verdict, length(r.host || r.path) AS size
  FROM hosts h LEFT JOIN rules r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
)
SELECT page_id, host, path, arg_max(rule, size) AS rule, coalesce(arg_max(verdict, size), 'allow') AS verdict
FROM fits GROUP BY page_id, host, path
"""


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges the URL of every page."""
    return urlrules.judge(read(spark, sf_dir, "pages"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_page_text": op2_page_text,
    "op3_warc": op3_warc,
    "op4_ngram_join": op4_ngram_join,
    "op5_decontaminate": op5_decontaminate,
    "op6_media": op6_media,
    "op7_sharding": op7_sharding,
    "op8_language": op8_language,
    "op9_urls": op9_urls,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {"op3_warc": OP3_SQL, "op4_ngram_join": OP4_SQL, "op5_decontaminate": OP5_SQL, "op9_urls": OP9_SQL}
