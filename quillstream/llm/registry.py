"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import (
    compression_classifier,
    decontaminate,
    html_extract,
    language_crf,
    near_dedup,
    quality_rules,
    sentencepiece_fst,
    sharding,
    token_counts,
    token_store,
)
from quillstream.llm.common import table

SHARDS = 40


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_crf.identify(docs, language_crf.fit(docs))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = compression_classifier.classify(docs, compression_classifier.fit(docs, table(spark, sf_dir, "labels")))
    return found.drop("difference")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.store(table(spark, sf_dir, "documents"))
    store.verify()
    return store.digests()


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.train())


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_decontamination, op3_sharding, op4_language_id, op5_quality_rules, op6_near_dedup,
        op7_quality_classifier, op8_token_store, op9_html_extraction, op10_sentencepiece,
    )
}
_BLANK_WORD = r"[^\x20\x09-\x0D]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS words FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, words[s + 1:s + n] AS win FROM (SELECT *, least(10, len(words))::BIGINT AS n FROM items WHERE len(words) > 0), unnest(range(len(words)::BIGINT - n + 1)) AS r(s)),
places AS (SELECT doc_id, n, s, words[s + 1:s + n] AS win FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(len(words)::BIGINT - n + 1)) AS r(s)),
hits AS (SELECT doc_id, s, n, item_id FROM places JOIN windows USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op3_sharding": f"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
bytes AS (SELECT doc_id, source, coalesce(text, '') AS body, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
hashed AS (SELECT doc_id, source, body, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) AS text_crc32 FROM bytes, crcs),
sized AS (SELECT doc_id, source, strlen(body) + 16 AS size, text_crc32, md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || text_crc32 || '|' || (strlen(body) + 16)) AS key FROM hashed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id, size, text_crc32) - 1 AS r, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM sized),
placed AS (SELECT *, row_number() OVER (ORDER BY (2 * r + 1) / (2.0::DOUBLE * n), source, r) - 1 AS pos FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, source, 'rows' AS law, (pos * {SHARDS} // total)::INT AS shard,
  (pos - (pos * {SHARDS} // total * total + {SHARDS} - 1) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard FROM placed""",
    # every pair of documents with a shingle in common, then everything that is reachable: for small tables
    "op6_near_dedup": f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BLANK_WORD}') AS words FROM documents),
sets AS (SELECT DISTINCT doc_id, words[s + 1:s + 5] AS shingle FROM docs, unnest(range(greatest(1, len(words)::BIGINT - 4))) AS r(s) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sets a JOIN sets b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY x, y),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
reached AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
roots AS (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM roots LEFT JOIN sizes USING (doc_id)""",
}
