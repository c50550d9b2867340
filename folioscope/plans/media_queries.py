"""Registered queries: stored images, exports and storage."""

from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import urls as U
from folioscope.operators import export as X
from folioscope.operators import media as M
from folioscope.plans import tables as T
from folioscope.plans.registry import query

# Bookmarks whose text mentions images: a few, many, repeated, in code, with a cover.
IMAGED = """
SELECT CAST(page_id AS STRING) AS id, page_id, CONCAT('# ', url, CHR(10), '![a [1]](https://cdn.example/shared.png) and ![x](<https://cdn.example/p(', CAST(page_id AS STRING), ').png> "T q")',
  CHR(10), '![again](https://cdn.example/shared.png) `![no](https://cdn.example/code.png)` ![rel](/local.png) ![big](https://cdn.example/big', CAST(page_id % 7 AS STRING), '.png)',
  CASE WHEN page_id % 40 = 3 THEN CONCAT(CHR(10), REPEAT('![m](https://cdn.example/shared.png)', 3), many) ELSE '' END) AS markdown_content,
  CASE page_id % 3 WHEN 0 THEN 'https://cdn.example/cover.png' WHEN 1 THEN CONCAT('/api/bookmarks/', CAST(page_id AS STRING), '/assets/', SUBSTR(MD5(url), 1, 24), '.png') END AS cover_image_url
FROM pages CROSS JOIN (SELECT '{many}' AS many) m
""".replace("{many}", " ".join(f"![n](https://cdn.example/n{i}.png)" for i in range(70)))

_SHARED = "https://cdn.example/shared.png"


def imaged(spark, sf_dir):
    return T.table(spark, sf_dir, IMAGED)


_COVER = "CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END"


@query(
    T.check(
        f"SELECT id AS bookmark_id, url, position FROM (SELECT id, 'https://cdn.example/cover.png' AS url, 0 AS position FROM imaged WHERE page_id % 3 = 0 UNION ALL "
        f"SELECT id, '{_SHARED}', {_COVER} FROM imaged UNION ALL SELECT id, CONCAT('https://cdn.example/p(', id, ').png'), 1 + {_COVER} FROM imaged UNION ALL "
        f"SELECT id, CONCAT('https://cdn.example/big', CAST(page_id % 7 AS STRING), '.png'), 2 + {_COVER} FROM imaged UNION ALL "
        f"SELECT id, CONCAT('https://cdn.example/n', CAST(i AS STRING), '.png'), CAST(3 + i + {_COVER} AS INT) FROM imaged, RANGE(0, 70) r(i) WHERE page_id % 40 = 3) x",
        imaged=IMAGED,
    )
)
def distinct_image_addresses(spark, sf_dir):
    return M.distinct_images(imaged(spark, sf_dir)).select("bookmark_id", "url", "position")


@query(
    T.check(
        f"SELECT id AS bookmark_id, CASE WHEN page_id % 3 = 1 THEN 1 ELSE 0 END AS localized, "
        f"4 + {_COVER} + CASE WHEN page_id % 40 = 3 THEN 70 ELSE 0 END AS remote FROM imaged",
        imaged=IMAGED,
    )
)
def image_archive_summary(spark, sf_dir):
    return M.image_summary(imaged(spark, sf_dir))


# What became of each download: one row per address.
DOWNLOADS = """
SELECT url, CASE WHEN url LIKE '%/p(%' THEN 'FFD8FF' ELSE '89504E470D0A1A0A' END AS hexed,
  CASE WHEN url LIKE '%/n3%' THEN 'image/gif' ELSE CASE WHEN url LIKE '%/p(%' THEN 'image/jpeg' ELSE 'image/png' END END AS content_type,
  CASE WHEN url LIKE '%/n5%' THEN 'HTTP_NOT_FOUND' END AS error_code
FROM (SELECT DISTINCT CONCAT('https://cdn.example/p(', CAST(page_id AS STRING), ').png') AS url FROM pages UNION ALL SELECT 'https://cdn.example/shared.png' UNION ALL
  SELECT 'https://cdn.example/cover.png' UNION ALL SELECT DISTINCT CONCAT('https://cdn.example/big', CAST(page_id % 7 AS STRING), '.png') FROM pages WHERE page_id % 7 <> 4
  UNION ALL SELECT DISTINCT CONCAT('https://cdn.example/n', CAST(page_id % 70 AS STRING), '.png') FROM pages) u
"""


def downloads(spark, sf_dir):
    df = T.table(spark, sf_dir, DOWNLOADS)
    return df.withColumn("body", F.unhex("hexed"))


# Of the 70 numbered images those beyond the cap of 60, n3, n30-n39, n5 and n50-n59 fail.
_REACH = f"(56 - {_COVER})"
_NUMBERED = f"(SELECT COUNT(*) FROM RANGE(0, 70) r(i) WHERE i <= {_REACH} AND NOT (i IN (3, 5) OR i BETWEEN 30 AND 39 OR i BETWEEN 50 AND 59))"
_DONE = f"{_COVER} + 2 + CASE WHEN page_id % 7 <> 4 THEN 1 ELSE 0 END + CASE WHEN page_id % 40 = 3 THEN {_NUMBERED} ELSE 0 END"
_ALL = f"3 + {_COVER} + CASE WHEN page_id % 40 = 3 THEN 70 ELSE 0 END"


@query(
    T.check(
        f"SELECT id AS bookmark_id, {_DONE} AS localized, {_ALL} - ({_DONE}) AS failed, 8 * ({_DONE}) - 5 AS total_bytes FROM imaged",
        imaged=IMAGED,
    )
)
def image_localization_plan(spark, sf_dir):
    plan = M.localization_plan(
        imaged(spark, sf_dir), downloads(spark, sf_dir), K.MAX_IMAGES, K.MAX_IMAGE_TOTAL_BYTES
    )
    return plan.select("bookmark_id", "localized", "failed", "total_bytes")


_EVERY = "(SELECT COUNT(*) FROM RANGE(0, 70) r(i) WHERE i IN (SELECT page_id % 70 FROM pages) AND NOT (i IN (3, 5) OR i BETWEEN 30 AND 39 OR i BETWEEN 50 AND 59))"
_DONE_OF_ALL = _DONE.replace(_NUMBERED, _EVERY)


@query(
    T.check(
        f"SELECT id AS bookmark_id, {_DONE_OF_ALL} AS localized, {_ALL} - ({_DONE_OF_ALL}) AS failed, 8 * ({_DONE_OF_ALL}) - 5 AS total_bytes FROM imaged",
        imaged=IMAGED,
    )
)
def unlimited_localization(spark, sf_dir):
    plan = M.localization_plan(imaged(spark, sf_dir), downloads(spark, sf_dir))
    return plan.select("bookmark_id", "localized", "failed", "total_bytes")


def _local(url: str, extension: str) -> str:
    return f"CONCAT('/api/bookmarks/', id, '/assets/', SUBSTR(SHA256({url}), 1, 24), '.{extension}')"


_LOCAL_SHARED = _local(f"'{_SHARED}'", "png")
_N_URL = "CONCAT('https://cdn.example/n', CAST(i AS STRING), '.png')"
_N_DONE = f"i <= {_REACH} AND NOT (i IN (3, 5) OR i BETWEEN 30 AND 39 OR i BETWEEN 50 AND 59)"
_MANY = (
    f"CONCAT(CHR(10), REPEAT(CONCAT('![m](', {_LOCAL_SHARED}, ')'), 3), (SELECT STRING_AGG(CONCAT('![n](', CASE WHEN {_N_DONE} THEN {_local(_N_URL, 'png')} "
    f"ELSE {_N_URL} END, ')'), ' ' ORDER BY i) FROM RANGE(0, 70) r(i)))"
)
_P_URL = "CONCAT('https://cdn.example/p(', id, ').png')"
_BIG = "CONCAT('https://cdn.example/big', CAST(page_id % 7 AS STRING), '.png')"


@query(
    T.check(
        "SELECT id, CONCAT(REPLACE(REPLACE(REPLACE(REPLACE(SPLIT_PART(markdown_content, CONCAT(CHR(10), '![m]'), 1), "
        rf"'![a [1]](https://cdn.example/shared.png)', CONCAT('![a \[1\]](', {_LOCAL_SHARED}, ')')), "
        f"'![again](https://cdn.example/shared.png)', CONCAT('![again](', {_LOCAL_SHARED}, ')')), "
        f"""CONCAT('![x](<', {_P_URL}, '> "T q")'), CONCAT('![x](', {_local(_P_URL, 'jpg')}, ' "T q")')), """
        f"CONCAT('![big](', {_BIG}, ')'), CASE WHEN page_id % 7 <> 4 THEN CONCAT('![big](', {_local(_BIG, 'png')}, ')') ELSE CONCAT('![big](', {_BIG}, ')') END), CASE WHEN page_id % 40 = 3 THEN {_MANY} ELSE '' END) AS markdown_content, "
        f"CASE page_id % 3 WHEN 0 THEN {_local(chr(39) + 'https://cdn.example/cover.png' + chr(39), 'png')} ELSE cover_image_url END AS cover_image_url FROM imaged",
        imaged=IMAGED,
    )
)
def localized_articles(spark, sf_dir):
    done = M.localize_images(
        imaged(spark, sf_dir), downloads(spark, sf_dir), K.MAX_IMAGES, K.MAX_IMAGE_TOTAL_BYTES
    )
    return done.select("id", "markdown_content", "cover_image_url")


# Downloaded sizes per user, to be admitted in order until the limit is met.
SIZES = """
SELECT CAST(user_id AS STRING) AS bookmark_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS position, CAST(value * 1000 AS BIGINT) AS bytes FROM events
"""
LIMIT = 300_000


@query(
    T.check(
        "WITH RECURSIVE sized AS ({s}), walk AS (SELECT bookmark_id, position, bytes <= {l} AS admitted, CASE WHEN bytes <= {l} THEN bytes ELSE 0 END AS total FROM sized WHERE position = 0 UNION ALL "
        "SELECT s.bookmark_id, s.position, w.total + s.bytes <= {l}, CASE WHEN w.total + s.bytes <= {l} THEN w.total + s.bytes ELSE w.total END FROM walk w "
        "JOIN sized s ON s.bookmark_id = w.bookmark_id AND s.position = w.position + 1) SELECT bookmark_id, position, admitted FROM walk"
        .replace("{s}", SIZES).replace("{l}", str(LIMIT))
    )
)
def byte_budget(spark, sf_dir):
    return M.byte_budget(T.table(spark, sf_dir, SIZES), LIMIT).select("bookmark_id", "position", "admitted")


# A file listing as the binaryFile source gives it, with names that do not belong.
FILES = """
SELECT CONCAT('file:/data/assets/b', CAST(page_id % 50 AS STRING), '/', CASE WHEN page_id % 9 = 0 THEN 'notes.txt' WHEN page_id % 9 = 1 THEN CONCAT(SUBSTR(MD5(url), 1, 23), '.png')
  ELSE CONCAT(SUBSTR(MD5(url), 1, 24), CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.svg' ELSE '.jpg' END) END) AS path, LENGTH(html) AS length, page_id, url FROM pages
"""
_VALID = "page_id % 9 > 1"
_FILE = "CONCAT(SUBSTR(MD5(url), 1, 24), CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.svg' ELSE '.jpg' END)"


@query(
    T.check(
        f"SELECT CONCAT('b', CAST(page_id % 50 AS STRING)) AS bookmark_id, {_FILE} AS filename, length AS bytes, "
        f"CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/svg+xml' ELSE 'image/jpeg' END AS content_type FROM files WHERE {_VALID}",
        files=FILES,
    )
)
def asset_listing(spark, sf_dir):
    return M.asset_manifest(T.table(spark, sf_dir, FILES)).orderBy("bookmark_id", "filename")


OWNERS = """
SELECT CONCAT('b', CAST(page_id AS STRING)) AS id, CASE WHEN page_id % 4 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' MINUTE * (page_id % 10) END AS deleted_at FROM pages WHERE page_id % 7 <> 3
"""


@query(
    T.check(
        f"SELECT {_FILE} AS filename, CONCAT('b', CAST(page_id % 50 AS STRING)) AS bookmark_id FROM files WHERE {_VALID} AND CONCAT('b', CAST(page_id % 50 AS STRING)) IN "
        f"(SELECT id FROM owners WHERE deleted_at IS NULL OR deleted_at >= TIMESTAMP '{T.NOW}' - INTERVAL '10' MINUTE)",
        files=FILES,
        owners=OWNERS,
    )
)
def readable_asset_files(spark, sf_dir):
    manifest = M.asset_manifest(T.table(spark, sf_dir, FILES))
    owners = spark.sql(OWNERS).withColumn("deleted_at", F.col("deleted_at").cast("timestamp"))
    return M.readable_assets(manifest, owners, T.now()).select("filename", "bookmark_id")


@query(
    "SELECT REGEXP_EXTRACT(url, '^https?://([^/:]+)', 1) AS domain, SUM(STRLEN(html)) AS total_bytes FROM pages GROUP BY 1"
)
def storage_per_domain(spark, sf_dir):
    pages = T.given(spark, sf_dir).table("pages")
    files = pages.select(U.url_domain(F.col("url")).alias("domain"), F.octet_length("html").alias("length"))
    return M.storage_usage(files, "domain")


@query("SELECT SUM(STRLEN(html)) AS total_bytes FROM pages")
def storage_total(spark, sf_dir):
    pages = T.given(spark, sf_dir).table("pages")
    return M.storage_usage(pages.select(F.octet_length("html").alias("length")))


# --- export ---------------------------------------------------------------------------------

_JSON = r"""CONCAT('"', REPLACE(REPLACE(REPLACE({0}, '\', '\\'), '"', '\"'), CHR(10), '\n'), '"')"""
_STEM = r"""COALESCE(NULLIF(SUBSTR(TRIM(REGEXP_REPLACE(REGEXP_REPLACE(title, '[<>:"/\\|?*\x00-\x1f]', '-', 'g'), '\s+', ' ', 'g')), 1, 80), ''), 'bookmark')"""
_CONTENT = (
    "CONCAT('---', CHR(10), 'title: ', " + _JSON.format("title") + ", CHR(10), 'source: ', " + _JSON.format("url") + ", CHR(10), 'domain: ', " + _JSON.format("domain")
    + ", CHR(10), 'saved_at: \"', STRFTIME(created_at, '%Y-%m-%dT%H:%M:%S.000Z'), '\"', CHR(10), 'tags:', CHR(10), "
    "COALESCE((SELECT STRING_AGG(CONCAT('  - \"', t.name, '\"', CHR(10)), '' ORDER BY t.id) FROM links l JOIN tags t ON t.id = l.tag_id WHERE l.bookmark_id = b.id), ''), "
    "'---', CHR(10), '# ', title, CHR(10), CHR(10), markdown_content, CHR(10))"
)


@query(
    T.check(
        f"SELECT id, CONCAT({_STEM}, CASE WHEN COUNT(*) OVER (PARTITION BY {_STEM}) > 1 THEN CONCAT('-', id) ELSE '' END, '.md') AS filename, {_CONTENT} AS content FROM bookmarks b"
    )
)
def markdown_export(spark, sf_dir):
    return X.export_markdown(T.archive(spark, sf_dir))


@query(
    T.check(
        "SELECT id, CONCAT('f', id) AS path, 'text' AS kind, CONCAT('see assets/', SUBSTR(MD5(url), 1, 24), '.png and /api/bookmarks/other/assets/', SUBSTR(MD5(url), 1, 24), '.png') AS content "
        "FROM (SELECT CONCAT('b', CAST(page_id AS STRING)) AS id, url FROM pages) p UNION ALL "
        f"SELECT CONCAT('b', CAST(page_id % 50 AS STRING)), CONCAT('assets/', {_FILE}), 'asset', NULL FROM files WHERE {_VALID}",
        files=FILES,
    )
)
def portable_bundle(spark, sf_dir):
    T.given(spark, sf_dir)
    name = F.concat(F.substring(F.md5("url"), 1, 24), F.lit(".png"))
    owner = F.concat(F.lit("b"), F.col("page_id").cast("string"))
    exported = spark.table("pages").select(
        owner.alias("id"),
        F.concat(F.lit("f"), owner).alias("filename"),
        F.concat(F.lit("see /api/bookmarks/"), owner, F.lit("/assets/"), name, F.lit(" and /api/bookmarks/other/assets/"), name).alias("content"),
    )
    return X.export_bundle(exported, M.asset_manifest(spark.sql(FILES)))
