"""Inputs of the registered queries, derived from the given tables.

Every derived table is stated once, as SQL text that both Spark and the checking engine
run, so that a query and its check start from the same rows.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.schema import Archive
from folioscope.session import configure
from folioscope.sources.archive import make_archive

GIVEN = ("pages", "documents", "labels", "events")

_URL = (
    "COALESCE(p.url, CONCAT('https://', d.source, '.example.org/', d.lang, '/', "
    "CAST(d.doc_id AS STRING)))"
)

BOOKMARKS = f"""
SELECT CAST(d.doc_id AS STRING) AS id,
       {_URL} AS url,
       REGEXP_REPLACE({_URL}, '#.*$', '') AS normalized_url,
       {_URL} AS final_url,
       SPLIT_PART(d.text, CHR(10), 1) AS title,
       LOWER(REGEXP_EXTRACT({_URL}, '^https?://([^/:?#]+)', 1)) AS domain,
       d.text AS markdown_content,
       d.text AS plain_text,
       CASE WHEN d.doc_id % 10 = 0 THEN CONCAT('note ', d.source) ELSE '' END AS user_note,
       CASE WHEN d.doc_id % 11 = 0 THEN 'pending' WHEN d.doc_id % 7 = 0 THEN 'failed'
            WHEN d.n_chars < 240 THEN 'partial' ELSE 'success' END AS extraction_status,
       CASE WHEN d.doc_id % 7 = 0 THEN
            CASE WHEN d.doc_id % 3 = 0 THEN 'DNS_FAILED' WHEN d.doc_id % 3 = 1 THEN 'ODD_CODE' END
            END AS error_code,
       CASE WHEN d.doc_id % 7 = 0 AND d.doc_id % 2 = 0 THEN CONCAT('stored ', d.source) END AS error_message,
       200 AS http_status_code,
       CAST(LENGTH(d.text) AS BIGINT) AS content_length,
       (d.doc_id % 5 = 0) AS is_content_edited,
       CAST(d.doc_id % 3 AS INT) AS retry_count,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * d.doc_id AS created_at,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (d.doc_id + (d.doc_id * 37) % 1000) AS updated_at,
       CASE WHEN d.doc_id % 17 = 0
            THEN TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' MINUTE * (d.doc_id % 30) END AS deleted_at
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id
"""

LINKS = """
SELECT CAST(doc_id AS STRING) AS bookmark_id, lang AS tag_id FROM documents
UNION ALL SELECT CAST(doc_id AS STRING), source FROM documents
UNION ALL SELECT CAST(doc_id AS STRING), CASE WHEN quality = 1 THEN 'quality' ELSE 'low' END FROM labels
"""

TAGS = f"""
SELECT DISTINCT tag_id AS id, UPPER(tag_id) AS name, tag_id AS normalized_name FROM ({LINKS}) l
UNION ALL SELECT 'unused', 'Unused', 'unused'
"""

NOW = "2024-01-31 00:05:00"


def now():
    return F.lit(NOW).cast("timestamp")


def given(spark: SparkSession, sf_dir: str) -> SparkSession:
    """Register the given tables as views and apply the session settings."""
    configure(spark)
    for name in GIVEN:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark


def archive(spark: SparkSession, sf_dir: str) -> Archive:
    given(spark, sf_dir)
    return make_archive(spark.sql(BOOKMARKS), spark.sql(TAGS), spark.sql(LINKS))


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return given(spark, sf_dir).sql(sql)


def check(sql: str, **parts: str) -> str:
    """SQL for the checking engine: derived tables become common table expressions."""
    parts = {"bookmarks": BOOKMARKS, "links": LINKS, "tags": TAGS, **parts}
    used = []

    def need(name):
        if name in used:
            return
        for other in parts:
            if other != name and _mentions(parts[name], other):
                need(other)
        used.append(name)

    for name in parts:
        if _mentions(sql, name):
            need(name)
    if not used:
        return sql
    return "WITH " + ", ".join(f"{n} AS ({parts[n]})" for n in used) + sql


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql, re.I) is not None
