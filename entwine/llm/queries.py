"""The corpus operators as registered queries, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.llm import bpe, exact_dedup, matroska, near_dedup, packing, secrets, suffix_dedup, token_counts, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_features(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return encoded.drop("ids")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_texts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents")).drop("spans")
    return found.withColumns({"has_repeats": F.col("n_removed") > 0, "n_kept": F.col("n_bytes") - F.col("n_removed")})


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_matroska": op2_matroska,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_near_dedup": op8_near_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             r AS (SELECT h, min(page_id) AS response_id FROM p GROUP BY h),
             d AS (SELECT page_id, h, response_id, sha1(h) AS hex FROM p JOIN r USING (h))
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)
                   for i in range(32)], '') AS payload_digest,
               CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> response_id THEN response_id END AS refers_to
        FROM d""",
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op8_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i : i + 4], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n2 FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * n2 >= 75 * (x.n + y.n - n2)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        c(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, c.r FROM c JOIN e ON c.doc_id = e.a)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM c LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op9_suffix_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        x AS (SELECT doc_id, t, hex(t) AS h, n FROM d),
        p AS (SELECT doc_id, i, md5(t[i + 1 : i + 400]) AS k FROM (SELECT doc_id, t, unnest(range(0, n - 399)) AS i FROM x WHERE n >= 400)),
        m AS (SELECT doc_id, i FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
        g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM m)),
        r AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY ALL),
        q AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed FROM r GROUP BY doc_id),
        b AS (SELECT doc_id, a AS stop, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM r UNION ALL SELECT doc_id, n, coalesce(max(z), 0) FROM x LEFT JOIN r USING (doc_id) GROUP BY doc_id, n),
        k AS (SELECT doc_id, string_agg(hex(t[start + 1 : stop]), '' ORDER BY start) AS h FROM b JOIN x USING (doc_id) GROUP BY doc_id)
        SELECT x.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256,
               coalesce(n_removed, 0) > 0 AS has_repeats, CAST(n - coalesce(n_removed, 0) AS BIGINT) AS n_kept
        FROM x JOIN k USING (doc_id) LEFT JOIN q USING (doc_id)""",
}
