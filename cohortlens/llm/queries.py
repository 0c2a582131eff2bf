"""The registered queries of this subpackage.

Each is its operator with production parameters on the whole table; what nulls, empty texts, ties, repeated rows, empty
tables and clashing columns give is stated by the operator's module.  Queries read the columns that they need alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._tokens import token_path
from .attribution import section_tokens
from .decontamination import contamination_report
from .extraction import main_text
from .near_duplicates import near_duplicates
from .packing import packed
from .quality import quality_report
from .substrings import substring_report
from .token_file import token_files
from .toxicity import toxicity
from .warc import archived


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), token_path("byte_bpe_50k.json"), end_id=2)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), token_path("word_bpe_49k.json"), end_id=0, size=2048)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"), token_path("byte_bpe_50k.json"), rule="start")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_file": op2_token_file,
    "op3_decontamination": op3_decontamination,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_warc": op5_warc,
    "op6_html_extraction": op6_html_extraction,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        h AS (SELECT k, i, CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(w[i:i + 34], ' ')) END AS h, w[i] AS x FROM p),
        r AS (SELECT k, i, x, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS again FROM h),
        g AS (SELECT k, i, x, bool_or(again) OVER (PARTITION BY k ORDER BY i ROWS 34 PRECEDING) AS gone FROM r),
        o AS (SELECT k, count(*) AS n, count(*) FILTER (gone) AS n_gone, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY k)
        SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(n_gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o ON o.k = d.k""",
    "op3_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT k, i, size, array_to_string(w[i:i + size - 1], ' ') AS h FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d JOIN (SELECT DISTINCT size FROM bw) ON len(w) >= size)),
        m AS (SELECT k, i, dw.size AS size, item_id FROM dw JOIN bw ON bw.h = dw.h AND bw.size = dw.size),
        n AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS j FROM m) GROUP BY k),
        t AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT k, item_id FROM m) GROUP BY k)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n ON n.k = d.k LEFT JOIN t ON t.k = d.k""",
    "op4_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT k, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
        c AS (SELECT a.k AS x, b.k AS y, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.k <> b.k GROUP BY a.k, b.k),
        e AS (SELECT x, y FROM c JOIN n p ON p.k = x JOIN n q ON q.k = y WHERE 5 * common >= 4 * (p.n + q.n - common)),
        r AS (SELECT k AS x, k AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
        z AS (SELECT r.x, min(d.doc_id) AS class_id FROM r JOIN d ON d.k = r.y GROUP BY r.x),
        l AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
        SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links FROM d JOIN z ON z.x = d.k LEFT JOIN l ON l.x = d.k""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        f AS (SELECT *, CASE WHEN octet_length(encode(html)) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first_id FROM p)
        SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest,
               CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM f""",
}
