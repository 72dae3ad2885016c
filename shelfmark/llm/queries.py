"""The registered query of each operator: thin calls over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, class_lm, conversation_repair, exact_dedup, fingerprints, langid, mixing, near_dedup, repair_sql, sharding, substring_dedup, suffix_dedup, url_filter, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(_documents(spark, sf_dir), near_dedup.Settings(k=3, percent=85))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(_documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), shards=16)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove(_documents(spark, sf_dir), window=13, with_text=False)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify(_documents(spark, sf_dir))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_documents(spark, sf_dir))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.classify(_documents(spark, sf_dir))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(_documents(spark, sf_dir))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(_documents(spark, sf_dir), length=100, with_bytes=False)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repair(conversation_repair.damaged(rows), there="present")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_bpe, op3_fingerprints, op4_sharding, op5_substring_dedup, op6_exact_dedup, op7_url_filter, op8_mixing, op9_langid, op10_class_lm, op11_suffix_dedup, op12_conversation_repair, op13_whitening)}

ORACLES = {
    "op12_conversation_repair": repair_sql.STATEMENT,
    "op1_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 1, 2))) t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach AS (SELECT doc_id, doc_id AS r FROM d
                  UNION SELECT l.x, reach.r FROM reach JOIN (SELECT a AS x, b AS y FROM link UNION ALL SELECT b, a FROM link) l ON l.y = reach.doc_id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
        FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n
    """,
    "op5_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM d, unnest(range(1, len(w) - 11)) t(i)),
        low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY 1),
        gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN low USING (k), unnest(range(13)) u(j) WHERE m < doc_id),
        word AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) t(p)),
        kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.p) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p WHERE gone.p IS NULL GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op11_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        part AS (SELECT doc_id, c, substr(h, 1000 * c + 1, 1198) AS s FROM d, unnest(range(0, len(h) // 1000 + 1)) t(c)),
        win AS (SELECT doc_id, 500 * c + p AS p, md5_number(substr(s, 2 * p + 1, 200)) AS k FROM part, unnest(range(0, 500)) t(p) WHERE len(s) >= 2 * p + 200),
        again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
        spans AS (SELECT doc_id, p, coalesce(p > lag(p) OVER w + 100, true) AS fresh, lead(p) OVER w AS q FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
        span AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM spans) GROUP BY doc_id, g),
        edge AS (SELECT doc_id, b AS a, lead(a, 1, 1000000000) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT * FROM span UNION ALL SELECT DISTINCT doc_id, -1, 0 FROM span)),
        kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS t FROM edge JOIN d USING (doc_id) GROUP BY doc_id),
        sums AS (SELECT doc_id, count(*) AS n, sum(b - a) AS r FROM span GROUP BY 1)
        SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
    """,
    "op6_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
}
