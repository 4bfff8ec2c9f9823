"""Runnable queries over the driver tables, one per operator, and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxline.llm import (
    archives, bpe, decontaminate, hard_negatives, licenses, near_duplicates, prefix_trie, quality_model,
    quality_rules, repeated_spans, token_counts, token_files, toxicity,
)
from fluxline.llm.common import file_bytes, held_out, table
from fluxline.session import scratch_path

# Score from which a document counts as good.
QUALITY_THRESHOLD = 0.3

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(
        table(spark, sf_dir, "documents"), file_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken")),
        public_tokenizers.PATTERN)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_files(table(spark, sf_dir, "documents"), path,
                            file_bytes(public_tokenizers.path("byte_bpe_50k.json")))
    return token_files.read_files(spark, path, "n_tokens bigint, ids_crc32 bigint",
                                  lambda ids: (len(ids), token_files.crc32(ids)))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.remove_repeats(
        table(spark, sf_dir, "documents"),
        "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", repeated_spans.digest)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "distance")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"),
                                       file_bytes(public_tokenizers.path("piece_bpe_32k.model")))
    return token_counts.over(counts, 4096)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct("places.phrase"))
    every = F.array_sort(F.array_union(base, F.col("matches.label")))
    covered = F.expr("coalesce(aggregate(matches, 0L, (m, x) -> greatest(m, x.last_word - x.first_word)), 0L)")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        licenses.score(F.size("places"), covered).alias("score"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_model.score_documents(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.participants(table(spark, sf_dir, "embeddings")).withColumn(
        "label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    found = hard_negatives.mine(rows, rows.where(F.col("id") % 100 == 0))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = archives.write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return archives.read_archives(made).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    convs = prefix_trie.rebuilt(
        prefix_trie.turns(table(spark, sf_dir, "conversations")), donor=conv - conv % 100,
        kept=F.crc32(conv.cast("string").cast("binary")) % 6, most=5)
    return prefix_trie.nodes(convs)


for _f in (op1_decontamination, op2_byte_bpe, op3_toxicity, op4_token_files, op5_suffix_dedup, op6_quality_rules,
           op7_token_counts, op8_near_duplicates, op9_licenses, op10_quality, op11_hard_negatives,
           op12_warc_archives, op13_prefix_trie):
    QUERIES[_f.__name__] = _f
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES["op1_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d),
found AS (
  SELECT doc_id, s, x.n, item_id
  FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
        FROM starts, sizes WHERE s + n - 1 <= len(w)) x
  JOIN windows USING (t, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op11_hard_negatives"] = """
WITH part AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM part a JOIN part b ON a.id <> b.id WHERE a.id % 100 = 0),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

ORACLES["op12_warc_archives"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n,
         sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages),
bits AS (
  SELECT page_id, n, first, list_aggregate(list_transform(range(1, 41), lambda i:
    lpad(bin(instr('0123456789abcdef', hex[i]) - 1), 4, '0')), 'string_agg', '') AS b FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(list_sum(list_transform(range(1, 6), lambda j: CAST(substr(b, 5 * i + j, 1) AS INTEGER) << (5 - j))) AS BIGINT) + 1,
         1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM bits
"""

# CRC-32 bit by bit, polynomial EDB88320.
ORACLES["op13_prefix_trie"] = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, to_base64(unhex(sha256(
           length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS donor,
         xor(list_reduce(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i:
           CAST(ord(CAST(conv_id AS VARCHAR)[i]) AS BIGINT)), lambda crc, byte:
             list_reduce(range(0, 8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END,
                         xor(crc, byte)), 4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
seq AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS d, role, text
  FROM (SELECT c.conv_id, 0 AS own, place, role, text FROM c JOIN t ON t.conv_id = donor AND place <= h
        UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND place > h)),
path AS (
  SELECT conv_id, d, length(text) AS size, string_agg(sha256(length(role) || ':' || role || text), '')
         OVER (PARTITION BY conv_id ORDER BY d) AS p FROM seq
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
long AS (SELECT conv_id, max(d) AS top FROM path GROUP BY conv_id),
node AS (
  SELECT d AS depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = top), '') AS ends
  FROM path JOIN long USING (conv_id) GROUP BY d, p),
up AS (
  SELECT n.*, u.conv_id AS parent_conv_id,
         (SELECT count(*) FROM node k WHERE k.depth = n.depth + 1 AND k.p[:64 * n.depth] = n.p) AS n_children
  FROM node n LEFT JOIN node u ON u.depth = n.depth - 1 AND u.p = n.p[:64 * (n.depth - 1)]),
below AS (
  SELECT a.p AS p, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved
  FROM up b, unnest(range(0, b.depth + 1)) AS x(k) JOIN up a ON a.depth = x.k AND a.p = b.p[:64 * x.k]
  GROUP BY a.p)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs,
       CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM up JOIN below USING (p)
"""
