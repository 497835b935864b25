"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from almanac.llm import (cover_tree, divergence, exact_dedup, jaccard_join, language_id, license_scan, packing, piece_lattice, prefix_trie,
                         rule_ensemble, scaled_sketch, substring_dedup, warc)
from almanac.llm.common import saved, table


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = rule_ensemble.remainder(docs["doc_id"], 4) == 2
    return language_id.identify(docs, language_id.train(docs.where(~held_out)), held_out)


def op10_merkle_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Damage of a second replica of the pages' records, parsed from its bytes, found through both trees."""
    first = saved(warc.to_records(table(spark, folder, "pages")), "replica")
    second = warc.read_back(warc.damaged_copy(first))
    return warc.audit(first, second).drop("file", "offset")


OP10_SQL = """
WITH body AS (SELECT page_id, url, coalesce(html, '') AS html,
                     trim(regexp_replace(coalesce(url, ''), '\\s+', ' ', 'g')) AS address FROM pages),
named AS (SELECT *, md5(address || chr(10) || html) AS h FROM body),
records AS (
    SELECT page_id, url, substr(md5(coalesce(page_id::VARCHAR, '')), 1, 2) AS mark, array_to_string([
        'WARC/1.0', 'WARC-Type: resource',
        'WARC-Record-ID: <urn:uuid:' || array_to_string([h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]], '-') || '>',
        'WARC-Date: 2024-01-01T00:00:00Z', 'WARC-Target-URI: ' || address, 'Content-Type: text/html',
        'Content-Length: ' || strlen(html), '', html, '', ''], chr(13) || chr(10)) AS record FROM named)
SELECT page_id, url, CASE mark WHEN '00' THEN 'altered' WHEN '01' THEN 'truncated' ELSE 'missing' END AS status,
       sha256(record) AS sha256_first,
       CASE mark WHEN '00' THEN sha256(left(record, length(record) - 5) || '#' || right(record, 4))
                 WHEN '01' THEN sha256(left(record, length(record) - 10)) END AS sha256_second
FROM records WHERE mark IN ('00', '01', '02')
"""

def op5_piece_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return piece_lattice.summaries(table(spark, folder, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.report(table(spark, folder, "documents"))


def op2_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.judge(table(spark, folder, "documents"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, folder, "documents"))


def op7_rule_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return rule_ensemble.classify(docs, rule_ensemble.train(docs, table(spark, folder, "labels")))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, folder, "documents"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_scaled_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return scaled_sketch.fingerprints(table(spark, folder, "documents"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


OP12_SQL = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rank
    FROM conversations WHERE conv_id IS NOT NULL),
members AS (
    SELECT conv_id, xor(list_reduce(
               list_concat([4294967295::BIGINT], list_transform(range(length(conv_id::VARCHAR)), lambda i: ord(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT)),
               lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                   lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
    SELECT m.conv_id, 0 AS part, rank, role, text FROM members m JOIN turns t ON t.conv_id = m.conv_id - m.conv_id % 5 AND rank <= h
    UNION ALL SELECT conv_id, 1, rank, role, text FROM members m JOIN turns t USING (conv_id) WHERE rank > h),
lists AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY part, rank) AS seq FROM parts GROUP BY conv_id),
full_lists AS (SELECT conv_id, coalesce(seq, []) AS seq FROM members LEFT JOIN lists USING (conv_id)),
prefixes AS (SELECT conv_id, d, seq[1:d] AS node FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM full_lists)),
nodes AS (SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs FROM prefixes GROUP BY node, d),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
marked AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
                  CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.node[depth].text) END AS own FROM nodes n LEFT JOIN children c ON n.node = c.node),
spread AS (SELECT node[1:k] AS node, n_children, own FROM (SELECT node, n_children, own, unnest(range(0, depth + 1)) AS k FROM marked)),
totals AS (SELECT node, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM spread GROUP BY node),
ends AS (SELECT seq AS node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM full_lists GROUP BY seq)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM marked m JOIN totals t ON m.node = t.node LEFT JOIN ends e ON m.node = e.node
LEFT JOIN nodes p ON m.depth > 0 AND p.node = m.node[1:m.depth - 1]
"""


def op13_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    return cover_tree.mine(table(spark, folder, "embeddings"))


OP13_SQL = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
    FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
negatives AS (
    SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
    FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_divergence": op2_divergence, "op3_license_scan": op3_license_scan,
           "op4_jaccard_join": op4_jaccard_join,
           "op5_piece_lattice": op5_piece_lattice, "op6_exact_dedup": op6_exact_dedup,
           "op7_rule_ensemble": op7_rule_ensemble, "op8_packing": op8_packing,
           "op9_language_id": op9_language_id, "op10_merkle_audit": op10_merkle_audit,
           "op11_scaled_sketch": op11_scaled_sketch, "op12_prefix_trie": op12_prefix_trie, "op13_cover_tree": op13_cover_tree}

ORACLE = {"op6_exact_dedup": OP6_SQL, "op10_merkle_audit": OP10_SQL, "op12_prefix_trie": OP12_SQL, "op13_cover_tree": OP13_SQL}
