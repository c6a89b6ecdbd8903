"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_tree, decontaminate, exact_dedup, hard_negatives, jaccard_join, line_dedup, packing, secret_scan, sharding, token_counts, toxicity, warc, whitening
from ._common import table


def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_documents(table(spark, sf_dir, "documents"))


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op7_trie_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label_col=label)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the other operators are held against brute force in tests/llm."""
    lower = _LOWER.format("text")
    return {
        "op6_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        # Different sets are compared through their shared n-grams; components by reachability over classes of equal sets.
        "op7_trie_jaccard_join": f"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
            s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                  ELSE list_sort(list_distinct([array_to_string(ws[i : i + 3], ' ') FOR i IN range(1, len(ws) - 2)])) END AS g FROM w),
            classes AS (SELECT g, min(doc_id) AS least, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
            grams AS (SELECT least, n, unnest(g) AS gram FROM classes),
            links AS (SELECT a.least AS a, b.least AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.least <> b.least
                      WHERE 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
                      GROUP BY a.least, b.least, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
            reach AS (SELECT least AS a, least AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
            roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
            SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(r.root, s.doc_id) AS component_id
            FROM s LEFT JOIN classes c ON s.g = c.g LEFT JOIN roots r ON c.least = r.a""",
        "op8_warc_normaliser": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
            m AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS least FROM p),
            digits AS (SELECT *, [list_sum([(instr('0123456789abcdef', h[5 * g + i]) - 1) * (16 ** (5 - i))::BIGINT FOR i IN range(1, 6)])::BIGINT FOR g IN range(8)] AS d FROM m)
            SELECT page_id, strlen(payload) AS payload_bytes,
                   array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((d[1 + i // 4] >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1) FOR i IN range(32)], '') AS payload_digest,
                   CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
            FROM digits""",
        "op9_decontaminate": f"""
            WITH d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
            b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
            k AS (SELECT item, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0),
            windows AS (SELECT DISTINCT item, k, array_to_string(ws[i : i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM k)),
            sizes AS (SELECT DISTINCT k FROM windows),
            own AS (SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes)),
            hits AS (SELECT o.doc_id, o.i, o.k, w.item FROM own o JOIN windows w ON o.k = w.k AND o.win = w.win),
            places AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
            items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
            SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
            FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
        "op11_hard_negatives": """
            WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
                       FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
            pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
            positives AS (SELECT a, b, s FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
            SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)::INTEGER AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
            FROM positives p JOIN pairs n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
            QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) <= 10""",
        "op12_line_dedup": f"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
            l AS (SELECT r, i, ls[i] AS line, {_LOWER.format("trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
            often AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
            kept AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM l WHERE key NOT IN (SELECT key FROM often) GROUP BY r)
            SELECT doc_id, len(ls) AS n_lines, len(ls) - coalesce(n, 0) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    }
