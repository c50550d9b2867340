"""Registered queries: batch writes to the archive, each over the whole archive."""

from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import changes as W
from folioscope.plans import tables as T
from folioscope.plans.registry import query

AT = f"TIMESTAMP '{T.NOW}'"


def rejects(change):
    return change.rejects.groupBy("error_code").agg(F.count("*").alias("n"))


# --- admission -----------------------------------------------------------------------

# Requests made of the page addresses: known, new, repeated and broken ones.
REQUESTS = """
SELECT CONCAT('r', CAST(page_id AS STRING)) AS request_id, page_id AS seq, CONCAT(url, '#again') AS url FROM pages
UNION ALL SELECT CONCAT('n', CAST(page_id AS STRING)), 1000000 + page_id, CONCAT('HTTPS://new.example/', CAST(page_id % 150 AS STRING)) FROM pages
UNION ALL SELECT CONCAT('b', CAST(page_id AS STRING)), 2000000 + page_id, CASE page_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'ftp://x.example/' ELSE 'https://me@x.example/' END FROM pages
"""
_GOOD = (
    "SELECT request_id, seq, CASE WHEN url LIKE 'HTTPS:%' THEN REPLACE(url, 'HTTPS', 'https') "
    "ELSE REGEXP_REPLACE(url, '#.*$', '') END AS u FROM requests WHERE url LIKE 'http%' AND url NOT LIKE '%@%' OR url LIKE 'HTTPS:%'"
)


def _requests(spark, sf_dir):
    return T.table(spark, sf_dir, REQUESTS)


@query(
    T.check(
        f"SELECT u AS normalized_url, ARG_MIN(request_id, seq) AS request_id FROM ({_GOOD}) g GROUP BY u",
        requests=REQUESTS,
    )
)
def first_request_per_url(spark, sf_dir):
    requests = W.with_normalized_url(_requests(spark, sf_dir), "url")
    return W.first_per_url(requests).select("normalized_url", "request_id")


@query(
    T.check(
        f"SELECT g.request_id, CASE WHEN b.id IS NULL THEN 'none' WHEN b.deleted_at IS NULL THEN 'live' ELSE 'deleted' END AS match, "
        f"b.id AS existing_id FROM ({_GOOD}) g LEFT JOIN bookmarks b ON b.normalized_url = g.u",
        requests=REQUESTS,
    )
)
def incoming_url_matches(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    good = W.with_normalized_url(_requests(spark, sf_dir), "url").where("normalized_url IS NOT NULL")
    return W.match_existing(good, a.bookmarks).select("request_id", "match", "existing_id")


def _admitted(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    tags = F.array(F.lit("Fresh  Tag"), F.lit("FR"), F.upper(F.substring("request_id", 1, 1)))
    return a, W.admit(a, _requests(spark, sf_dir).withColumn("tag_names", tags), T.now())


_TAKEN = f"SELECT u, ARG_MIN(request_id, seq) AS request_id FROM ({_GOOD}) g GROUP BY u"
_NEW = (
    f"SELECT f.u, f.request_id, b.id AS old_id FROM ({_TAKEN}) f LEFT JOIN bookmarks b ON b.normalized_url = f.u "
    "WHERE b.id IS NULL OR b.deleted_at IS NOT NULL"
)


@query(
    T.check(
        f"SELECT request_id AS id, u AS normalized_url, REGEXP_EXTRACT(u, '^https?://([^/:?#]+)', 1) AS title, 'pending' AS extraction_status, "
        f"EPOCH_MS({AT}) AS created_at_ms FROM ({_NEW}) n UNION ALL "
        f"SELECT id, normalized_url, title, extraction_status, EPOCH_MS(created_at) FROM bookmarks WHERE id NOT IN (SELECT old_id FROM ({_NEW}) n WHERE old_id IS NOT NULL)",
        requests=REQUESTS,
    )
)
def admitted_archive(spark, sf_dir):
    _, change = _admitted(spark, sf_dir)
    return change.archive.bookmarks.select(
        "id", "normalized_url", "title", "extraction_status", F.unix_millis("created_at").alias("created_at_ms")
    )


@query(
    T.check(
        "SELECT 'INVALID_URL' AS error_code, COUNT(*) AS n FROM pages WHERE page_id % 3 <> 1 UNION ALL "
        "SELECT 'UNSUPPORTED_PROTOCOL', COUNT(*) FROM pages WHERE page_id % 3 = 1 UNION ALL "
        f"SELECT 'DUPLICATE_URL', (SELECT COUNT(*) FROM ({_GOOD}) g) - (SELECT COUNT(*) FROM ({_NEW}) n)",
        requests=REQUESTS,
    )
)
def refused_requests(spark, sf_dir):
    return rejects(_admitted(spark, sf_dir)[1])


@query(
    T.check(
        f"SELECT l.tag_id, COUNT(*) AS n FROM (SELECT bookmark_id, tag_id FROM links WHERE bookmark_id NOT IN (SELECT old_id FROM ({_NEW}) n WHERE old_id IS NOT NULL) "
        f"UNION ALL SELECT request_id, UNNEST([CONCAT('tag-', SUBSTR(SHA256('fresh tag'), 1, 32)), 'fr', "
        f"CONCAT('tag-', SUBSTR(SHA256(LOWER(SUBSTR(request_id, 1, 1))), 1, 32))]) FROM ({_NEW}) n) l GROUP BY 1",
        requests=REQUESTS,
    )
)
def tags_after_admission(spark, sf_dir):
    change = _admitted(spark, sf_dir)[1]
    return change.archive.links.groupBy("tag_id").agg(F.count("*").alias("n"))


# Requests with new addresses whose ids repeat, are missing or belong to stored bookmarks.
TAKEN_IDS = """
SELECT CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS STRING) WHEN page_id % 3 = 1 THEN CONCAT('t', CAST(page_id % 10 AS STRING))
  WHEN page_id % 5 > 0 THEN CONCAT('u', CAST(page_id AS STRING)) END AS request_id,
  page_id AS seq, CONCAT('https://taken.example/', CAST(page_id AS STRING)) AS url, ARRAY('Fresh Tag', 'FR') AS tag_names FROM pages
"""
_TAKEN_IDS = TAKEN_IDS.replace("ARRAY('Fresh Tag', 'FR') AS tag_names", "CONCAT('https://taken.example/', CAST(page_id AS STRING)) AS u")
_FREE_IDS = "SELECT request_id, ARG_MIN(u, seq) AS u, COUNT(*) AS asked FROM taken_ids WHERE request_id NOT IN (SELECT id FROM bookmarks) GROUP BY request_id"


@query(
    T.check(
        f"SELECT id, normalized_url FROM bookmarks UNION ALL SELECT request_id, u FROM ({_FREE_IDS}) f",
        taken_ids=_TAKEN_IDS,
    )
)
def admitted_ids(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return W.admit(a, T.table(spark, sf_dir, TAKEN_IDS), T.now()).archive.bookmarks.select("id", "normalized_url")


@query(
    T.check(
        "SELECT DISTINCT request_id AS key, 'VALIDATION_ERROR' AS error_code FROM taken_ids WHERE request_id IS NULL OR request_id IN (SELECT id FROM bookmarks) "
        f"UNION ALL SELECT request_id, 'VALIDATION_ERROR' FROM ({_FREE_IDS}) f WHERE asked > 1",
        taken_ids=_TAKEN_IDS,
    )
)
def refused_ids(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return W.admit(a, T.table(spark, sf_dir, TAKEN_IDS), T.now()).rejects


# --- extraction results -----------------------------------------------------------------

RESULTS = """
SELECT CAST(doc_id AS STRING) AS bookmark_id, doc_id % 2 = 0 AS overwrite,
  CASE doc_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' ELSE 'success' END AS extraction_status,
  CONCAT('https://final.example/', CAST(doc_id AS STRING)) AS final_url,
  CASE WHEN doc_id % 8 = 3 THEN '' ELSE CONCAT('T', CAST(doc_id AS STRING)) END AS title,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'final.example' END AS domain,
  CASE WHEN doc_id % 6 = 0 THEN 'described' END AS description, CAST(NULL AS STRING) AS author,
  CAST(NULL AS STRING) AS favicon_url, CASE WHEN doc_id % 5 = 1 THEN 'https://c.example/c.png' END AS cover_image_url,
  CONCAT('# new ', lang) AS markdown_content, CONCAT('new ', lang) AS plain_text, CAST(8 AS BIGINT) AS content_length,
  CASE WHEN doc_id % 4 = 2 THEN 'HTTP_NOT_FOUND' WHEN doc_id % 4 = 1 THEN 'CONTENT_TOO_SHORT' END AS error_code,
  CAST(NULL AS STRING) AS error_message, CAST(CASE WHEN doc_id % 4 = 2 THEN 404 ELSE 200 END AS INT) AS http_status_code
FROM documents UNION ALL SELECT 'missing', TRUE, 'success', 'u', 't', 'd', NULL, NULL, NULL, NULL, '', '', 0, NULL, NULL, 200
"""


@query(
    T.check(
        "SELECT b.id, CASE WHEN p THEN r.title ELSE b.title END AS title, CASE WHEN p THEN r.markdown_content ELSE b.markdown_content END AS markdown_content, "
        "CASE WHEN p THEN r.extraction_status ELSE b.extraction_status END AS extraction_status, CASE WHEN p THEN r.error_code ELSE b.error_code END AS error_code, "
        f"CASE WHEN p THEN EPOCH_MS({AT}) END AS extracted_at_ms FROM (SELECT *, extraction_status = 'pending' AS p FROM bookmarks) b JOIN results r ON r.bookmark_id = b.id",
        results=RESULTS,
    )
)
def extractions_applied(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    change = W.apply_extractions(a, T.table(spark, sf_dir, RESULTS), T.now())
    return change.archive.bookmarks.select(
        "id", "title", "markdown_content", "extraction_status", "error_code", F.unix_millis("extracted_at").alias("extracted_at_ms")
    )


_ALLOWED = "b.deleted_at IS NULL AND (NOT b.is_content_edited OR r.overwrite)"
_KEEP = "(r.extraction_status = 'failed' OR (b.is_content_edited AND r.extraction_status <> 'success'))"


@query(
    T.check(
        f"SELECT b.id, CASE WHEN NOT ({_ALLOWED}) THEN b.title WHEN r.extraction_status = 'success' AND r.title <> '' THEN r.title ELSE b.title END AS title, "
        f"CASE WHEN {_ALLOWED} AND r.domain <> '' THEN r.domain ELSE b.domain END AS domain, "
        f"CASE WHEN {_ALLOWED} AND NOT {_KEEP} THEN r.markdown_content ELSE b.markdown_content END AS markdown_content, "
        f"CASE WHEN {_ALLOWED} AND NOT {_KEEP} THEN 8 ELSE b.content_length END AS content_length, "
        f"CASE WHEN {_ALLOWED} THEN r.extraction_status ELSE b.extraction_status END AS extraction_status, "
        f"CASE WHEN {_ALLOWED} THEN {_KEEP} AND b.is_content_edited ELSE b.is_content_edited END AS is_content_edited, "
        f"CAST(CASE WHEN {_ALLOWED} THEN b.retry_count + 1 ELSE b.retry_count END AS INT) AS retry_count, "
        f"CASE WHEN {_ALLOWED} THEN r.cover_image_url END AS cover_image_url, "
        f"CASE WHEN {_ALLOWED} THEN r.description END AS description FROM bookmarks b JOIN results r ON r.bookmark_id = b.id",
        results=RESULTS,
    )
)
def re_extractions_merged(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    change = W.re_extract(a, T.table(spark, sf_dir, RESULTS), T.now())
    return change.archive.bookmarks.select(
        "id", "title", "domain", "markdown_content", "content_length", "extraction_status", "is_content_edited",
        "retry_count", "cover_image_url", "description",
    )


@query(
    T.check(
        "SELECT 'CONTENT_EDITED' AS error_code, COUNT(*) AS n FROM bookmarks b JOIN results r ON r.bookmark_id = b.id "
        "WHERE b.deleted_at IS NULL AND b.is_content_edited AND NOT r.overwrite UNION ALL "
        "SELECT 'NOT_FOUND', COUNT(*) FROM results r LEFT JOIN bookmarks b ON r.bookmark_id = b.id AND b.deleted_at IS NULL WHERE b.id IS NULL",
        results=RESULTS,
    )
)
def refused_re_extractions(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return rejects(W.re_extract(a, T.table(spark, sf_dir, RESULTS), T.now()))


# --- edits ----------------------------------------------------------------------------------

PATCHES = """
SELECT CAST(doc_id AS STRING) AS bookmark_id, CASE doc_id % 5 WHEN 0 THEN CONCAT('  New ', source, ' ') WHEN 1 THEN ' ' WHEN 2 THEN REPEAT('t', 301) END AS title,
  CASE doc_id % 3 WHEN 0 THEN CONCAT('noted ', lang) WHEN 1 THEN CASE WHEN doc_id % 200 = 1 THEN REPEAT('n', 5001) END END AS user_note,
  CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN CONCAT('# ', text) END AS markdown_content FROM documents
UNION ALL SELECT 'missing', 'x', NULL, NULL
"""
_PATCH_OK = "(p.title IS NULL OR (TRIM(p.title) <> '' AND LENGTH(TRIM(p.title)) <= 300)) AND (p.user_note IS NULL OR LENGTH(p.user_note) <= 5000)"
_USE = f"b.deleted_at IS NULL AND {_PATCH_OK}"
_MD = "p.markdown_content IS NOT NULL AND p.markdown_content <> b.markdown_content"
_SQUASHED = r"TRIM(REGEXP_REPLACE(REGEXP_REPLACE(p.markdown_content, '[#>*_`~\[\]()!-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    T.check(
        f"SELECT b.id, CASE WHEN {_USE} AND p.title IS NOT NULL THEN TRIM(p.title) ELSE b.title END AS title, "
        f"CASE WHEN {_USE} AND p.user_note IS NOT NULL THEN p.user_note ELSE b.user_note END AS user_note, "
        f"CASE WHEN {_USE} AND {_MD} THEN p.markdown_content ELSE b.markdown_content END AS markdown_content, "
        f"CASE WHEN {_USE} AND {_MD} THEN {_SQUASHED} ELSE b.plain_text END AS plain_text, "
        f"CASE WHEN {_USE} AND {_MD} THEN LENGTH(p.markdown_content) ELSE b.content_length END AS content_length, "
        f"CASE WHEN {_USE} AND {_MD} THEN TRUE ELSE b.is_content_edited END AS is_content_edited, "
        f"EPOCH_MS(CASE WHEN {_USE} AND (p.title IS NOT NULL OR p.user_note IS NOT NULL OR ({_MD})) THEN {AT} ELSE b.updated_at END) AS updated_at_ms "
        "FROM bookmarks b JOIN patches p ON p.bookmark_id = b.id",
        patches=PATCHES,
    )
)
def edits_applied(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    change = W.edit(a, T.table(spark, sf_dir, PATCHES), T.now())
    return change.archive.bookmarks.select(
        "id", "title", "user_note", "markdown_content", "plain_text", "content_length", "is_content_edited",
        F.unix_millis("updated_at").alias("updated_at_ms"),
    )


@query(
    T.check(
        f"SELECT 'VALIDATION_ERROR' AS error_code, COUNT(*) AS n FROM patches p WHERE NOT ({_PATCH_OK}) UNION ALL "
        f"SELECT 'NOT_FOUND', COUNT(*) FROM patches p LEFT JOIN bookmarks b ON b.id = p.bookmark_id AND b.deleted_at IS NULL WHERE b.id IS NULL AND {_PATCH_OK}",
        patches=PATCHES,
    )
)
def refused_edits(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return rejects(W.edit(a, T.table(spark, sf_dir, PATCHES), T.now()))


@query(
    T.check(
        "SELECT bookmark_id, CONCAT_WS(',', CASE WHEN title IS NOT NULL AND (TRIM(title) = '' OR LENGTH(TRIM(title)) > 300) THEN 'title' END, "
        "CASE WHEN LENGTH(user_note) > 5000 THEN 'user_note' END, CASE WHEN LENGTH(markdown_content) > 2097152 THEN 'markdown_content' END) AS failed_fields "
        f"FROM patches p WHERE NOT ({_PATCH_OK})",
        patches=PATCHES,
    )
)
def field_validation(spark, sf_dir):
    _, broken = W.validate_changes(T.table(spark, sf_dir, PATCHES))
    return broken.select("bookmark_id", F.array_join("failed_fields", ",").alias("failed_fields"))


# --- delete, restore, purge --------------------------------------------------------------------

IDS = """
SELECT CAST(doc_id AS STRING) AS bookmark_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'missing'
"""


@query(
    T.check(
        f"SELECT b.id, EPOCH_MS(CASE WHEN i.bookmark_id IS NOT NULL AND b.deleted_at IS NULL THEN {AT} ELSE b.deleted_at END) AS deleted_at_ms, "
        "EPOCH_MS(b.updated_at) AS updated_at_ms FROM bookmarks b LEFT JOIN ids i ON i.bookmark_id = b.id",
        ids=IDS,
    )
)
def soft_deleted_archive(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    b = W.soft_delete(a, T.table(spark, sf_dir, IDS), T.now()).archive.bookmarks
    return b.select("id", F.unix_millis("deleted_at").alias("deleted_at_ms"), F.unix_millis("updated_at").alias("updated_at_ms"))


@query(
    T.check(
        "SELECT b.id, EPOCH_MS(CASE WHEN i.bookmark_id IS NULL THEN b.deleted_at END) AS deleted_at_ms FROM bookmarks b LEFT JOIN ids i ON i.bookmark_id = b.id",
        ids=IDS,
    )
)
def restored_archive(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    b = W.restore(a, T.table(spark, sf_dir, IDS)).archive.bookmarks
    return b.select("id", F.unix_millis("deleted_at").alias("deleted_at_ms"))


@query(
    T.check(
        "SELECT i.bookmark_id AS key, 'NOT_FOUND' AS error_code FROM ids i LEFT JOIN bookmarks b "
        "ON b.id = i.bookmark_id AND b.deleted_at IS NOT NULL WHERE b.id IS NULL",
        ids=IDS,
    )
)
def refused_restores(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return W.restore(a, T.table(spark, sf_dir, IDS)).rejects


_GONE = f"SELECT id FROM bookmarks WHERE deleted_at < {AT} - INTERVAL '10' MINUTE"


@query(
    T.check(
        f"SELECT 'bookmark' AS kind, id AS key, 1 AS n FROM bookmarks WHERE id NOT IN ({_GONE}) UNION ALL "
        f"SELECT 'link', bookmark_id, COUNT(*) FROM links WHERE bookmark_id NOT IN ({_GONE}) GROUP BY bookmark_id"
    )
)
def purged_archive(spark, sf_dir):
    after = W.purge(T.archive(spark, sf_dir), T.now()).archive
    b = after.bookmarks.select(F.lit("bookmark").alias("kind"), F.col("id").alias("key"), F.lit(1).cast("bigint").alias("n"))
    links = after.links.groupBy(F.col("bookmark_id").alias("key")).agg(F.count("*").alias("n"))
    return b.unionByName(links.select(F.lit("link").alias("kind"), "key", "n"))


# --- tags -----------------------------------------------------------------------------------------

TAGGING = """
SELECT CAST(doc_id AS STRING) AS bookmark_id, source, lang, doc_id FROM documents WHERE lang <> 'de'
"""


def _tagging(spark, sf_dir):
    df = T.table(spark, sf_dir, TAGGING)
    many = F.transform(F.sequence(F.lit(1), F.lit(13)), lambda i: F.concat(F.lit("t"), i.cast("string")))
    few = F.array(F.upper("source"), F.concat(F.lit(" New  "), F.col("lang"), F.lit(" ")), F.col("source"), F.concat(F.lit("new "), F.col("lang")), F.lit(" "))
    return df.select("bookmark_id", F.when(F.col("doc_id") % 50 == 7, many).otherwise(few).alias("tag_names"))


@query(
    T.check(
        "SELECT bookmark_id, source AS normalized_name, 0 AS position, source AS name FROM tagging WHERE doc_id % 50 <> 7 UNION ALL "
        "SELECT bookmark_id, CONCAT('new ', lang), 1, CONCAT('new ', lang) FROM tagging WHERE doc_id % 50 <> 7 UNION ALL "
        "SELECT bookmark_id, CONCAT('t', CAST(i AS STRING)), i - 1, CONCAT('t', CAST(i AS STRING)) FROM tagging, RANGE(1, 14) r(i) WHERE doc_id % 50 = 7",
        tagging=TAGGING,
    )
)
def distinct_tag_spellings(spark, sf_dir):
    return W.distinct_tag_names(_tagging(spark, sf_dir)).select("bookmark_id", "normalized_name", "position", "name")


_NEW_ID = "CONCAT('tag-', SUBSTR(SHA256(CONCAT('new ', lang)), 1, 32))"


@query(
    T.check(
        "SELECT bookmark_id, tag_id FROM links WHERE bookmark_id NOT IN (SELECT bookmark_id FROM tagging WHERE doc_id % 50 <> 7) UNION ALL "
        f"SELECT bookmark_id, source FROM tagging WHERE doc_id % 50 <> 7 UNION ALL SELECT bookmark_id, {_NEW_ID} FROM tagging WHERE doc_id % 50 <> 7",
        tagging=TAGGING,
    )
)
def tags_replaced(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return W.set_tags(a, _tagging(spark, sf_dir), T.now()).archive.links.select("bookmark_id", "tag_id")


@query(
    T.check(
        "SELECT id, name, normalized_name FROM tags UNION ALL "
        f"SELECT DISTINCT {_NEW_ID}, CONCAT('new ', lang), CONCAT('new ', lang) FROM tagging WHERE doc_id % 50 <> 7",
        tagging=TAGGING,
    )
)
def tag_table_after_tagging(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return W.set_tags(a, _tagging(spark, sf_dir), T.now()).archive.tags.select("id", "name", "normalized_name")


TAG_NAMES = """
SELECT CONCAT(' ', UPPER(lang), '  ') AS name, doc_id AS seq FROM documents
UNION ALL SELECT CONCAT('Topic ', CAST(doc_id % 40 AS STRING)), doc_id FROM documents
UNION ALL SELECT CONCAT('TOPIC  ', CAST(doc_id % 40 AS STRING)), doc_id + 0 FROM documents WHERE doc_id >= 40
UNION ALL SELECT CONCAT('long ', text), doc_id FROM documents WHERE LENGTH(text) > 60 AND text NOT LIKE '% ' AND lang = 'fr'
"""


@query(
    T.check(
        "SELECT id, name, normalized_name FROM tags UNION ALL SELECT DISTINCT CONCAT('tag-', SUBSTR(SHA256(CONCAT('topic ', CAST(doc_id % 40 AS STRING))), 1, 32)), "
        "CONCAT('Topic ', CAST(doc_id % 40 AS STRING)), CONCAT('topic ', CAST(doc_id % 40 AS STRING)) FROM documents"
    )
)
def tags_created(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return W.create_tags(a, T.table(spark, sf_dir, TAG_NAMES), T.now()).archive.tags.select("id", "name", "normalized_name")


@query(
    T.check(
        "SELECT normalized_name, is_new FROM (SELECT DISTINCT normalized_name, FALSE AS is_new FROM tags WHERE id IN (SELECT lang FROM documents) "
        "UNION ALL SELECT DISTINCT CONCAT('topic ', CAST(doc_id % 40 AS STRING)), TRUE FROM documents) x"
    )
)
def tags_resolved(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    applied = W.create_tags(a, T.table(spark, sf_dir, TAG_NAMES), T.now()).applied
    return applied.select("normalized_name", "is_new")


# Every tag is asked to take a new name; some names belong to other tags or are too long.
RENAMES = """
SELECT id AS tag_id, CASE WHEN id LIKE 'src1%' THEN CONCAT('Renamed ', id) WHEN id LIKE 'src2%' THEN 'FR' WHEN id = 'de' THEN 'DE ' WHEN id = 'en' THEN REPEAT('x', 31)
  WHEN id LIKE 'src3%' THEN 'shared name' ELSE id END AS name FROM (SELECT DISTINCT source AS id FROM documents UNION SELECT DISTINCT lang FROM documents) s
UNION ALL SELECT 'missing', 'whatever'
"""


@query(
    T.check(
        "SELECT t.id, CASE WHEN t.id LIKE 'src1%' THEN CONCAT('Renamed ', t.id) WHEN t.id LIKE 'src2%' OR t.id = 'en' THEN t.name WHEN t.id = 'de' THEN 'DE' "
        "WHEN t.id = (SELECT MIN(tag_id) FROM renames WHERE tag_id LIKE 'src3%') THEN 'shared name' WHEN t.id LIKE 'src3%' THEN t.name "
        "WHEN t.id IN (SELECT tag_id FROM renames) THEN t.id ELSE t.name END AS name FROM tags t",
        renames=RENAMES,
    )
)
def tags_renamed(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return W.rename_tags(a, T.table(spark, sf_dir, RENAMES), T.now()).archive.tags.select("id", "name")


@query(
    T.check(
        "SELECT tag_id AS key, CASE WHEN tag_id = 'missing' THEN 'NOT_FOUND' ELSE 'VALIDATION_ERROR' END AS error_code FROM renames "
        "WHERE tag_id IN ('missing', 'en') OR tag_id LIKE 'src2%' OR (tag_id LIKE 'src3%' AND tag_id <> (SELECT MIN(tag_id) FROM renames WHERE tag_id LIKE 'src3%'))",
        renames=RENAMES,
    )
)
def refused_renames(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return W.rename_tags(a, T.table(spark, sf_dir, RENAMES), T.now()).rejects


# Each source takes the name of the one before it, in turn: the first moves to a new name. Where
# the number ends in 5 the rename comes too early, so it is refused, and with it all up to the
# next new name; two languages want to swap names, which no order allows.
RENAMES_IN_TURN = """
SELECT source AS tag_id, CASE WHEN k % 10 = 0 THEN CONCAT('Moved ', source) ELSE CONCAT('SRC', CAST(k - 1 AS STRING)) END AS name,
  CASE WHEN k % 10 = 5 THEN -1 ELSE k END AS seq FROM (SELECT DISTINCT source, TRY_CAST(SUBSTR(source, 4) AS INT) AS k FROM documents) s
UNION ALL SELECT DISTINCT lang, CASE lang WHEN 'de' THEN 'fr' WHEN 'fr' THEN 'de' ELSE UPPER(lang) END, 5000 FROM documents
UNION ALL SELECT DISTINCT lang, 'superseded', 4000 FROM documents WHERE lang = 'en'
"""
_MOVES = (
    "SELECT tag_id, name, tag_id LIKE 'src%' AND TRY_CAST(REGEXP_EXTRACT(tag_id, '[0-9]+') AS INT) % 10 < 5 OR tag_id IN ('en', 'es') AS wins "
    "FROM renames_in_turn WHERE seq <> 4000"
)


@query(
    T.check(
        f"SELECT t.id, CASE WHEN m.wins THEN m.name ELSE t.name END AS name, LOWER(CASE WHEN m.wins THEN m.name ELSE t.name END) AS normalized_name "
        f"FROM tags t LEFT JOIN ({_MOVES}) m ON m.tag_id = t.id",
        renames_in_turn=RENAMES_IN_TURN,
    )
)
def tags_renamed_in_turn(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    tags = W.rename_tags(a, T.table(spark, sf_dir, RENAMES_IN_TURN), T.now()).archive.tags
    return tags.select("id", "name", "normalized_name")


@query(
    T.check(
        f"SELECT tag_id AS key, 'VALIDATION_ERROR' AS error_code FROM ({_MOVES}) m WHERE NOT wins UNION ALL SELECT 'en', 'SUPERSEDED'",
        renames_in_turn=RENAMES_IN_TURN,
    )
)
def refused_renames_in_turn(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return W.rename_tags(a, T.table(spark, sf_dir, RENAMES_IN_TURN), T.now()).rejects


@query(
    T.check(
        "SELECT 'tag' AS kind, id AS tag_id, 1 AS n FROM tags WHERE id NOT IN (SELECT DISTINCT lang FROM documents) UNION ALL "
        "SELECT 'link', tag_id, COUNT(*) FROM links WHERE tag_id NOT IN (SELECT DISTINCT lang FROM documents) GROUP BY tag_id"
    )
)
def tags_deleted(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    ids = spark.table("documents").select(F.col("lang").alias("tag_id"))
    after = W.delete_tags(a, ids).archive
    tags = after.tags.select(F.lit("tag").alias("kind"), F.col("id").alias("tag_id"), F.lit(1).cast("bigint").alias("n"))
    links = after.links.groupBy("tag_id").agg(F.count("*").alias("n"))
    return tags.unionByName(links.select(F.lit("link").alias("kind"), "tag_id", "n"))


# --- curated sets -----------------------------------------------------------------------------------

# A set that resets the bookmarks of one language and adds one new bookmark per page.
CURATED = """
SELECT id, normalized_url AS url, CONCAT('Curated ', id) AS title, domain, CONCAT(' ', markdown_content, ' ') AS markdown_content, created_at FROM bookmarks
WHERE domain LIKE 'src%'
"""
CURATED_SQL = CURATED.replace("FROM bookmarks", f"FROM ({T.BOOKMARKS}) b")
NEW_CURATED = """
SELECT CONCAT('cur', CAST(page_id AS STRING)) AS id, CONCAT('https://curated.example/', CAST(page_id AS STRING)) AS url, CONCAT('Curated ', CAST(page_id AS STRING)) AS title,
  'curated.example' AS domain, html AS markdown_content, TIMESTAMP '2024-01-05 00:00:00' AS created_at FROM pages
"""


def _curated(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    rows = spark.sql(CURATED_SQL).unionByName(spark.sql(NEW_CURATED))
    rows = rows.withColumn("tag_names", F.array(F.lit("Curated"), F.lit("FR"))).withColumn("updated_at", F.col("created_at"))
    tags = spark.table("pages").select(
        F.lit("cur-tag").alias("id"), F.lit("Curated").alias("name"), F.lit("curated").alias("normalized_name")
    ).unionByName(spark.table("pages").select(F.lit("cur-fr").alias("id"), F.lit("FR").alias("name"), F.lit("fr").alias("normalized_name"))).distinct()
    return a, rows, tags


_CURATED_ALL = f"SELECT id, url, title, markdown_content FROM ({CURATED}) c UNION ALL SELECT id, url, title, markdown_content FROM ({NEW_CURATED}) n"
_TRIMMED = r"REGEXP_REPLACE(c.markdown_content, '^\s+|\s+$', '', 'g')"


@query(
    T.check(
        f"SELECT c.id, c.title, LENGTH({_TRIMMED}) AS content_length, 'pending' AS extraction_status, EPOCH_MS(b.deleted_at) AS deleted_at_ms FROM ({_CURATED_ALL}) c LEFT JOIN bookmarks b ON b.id = c.id "
        f"UNION ALL SELECT id, title, content_length, extraction_status, EPOCH_MS(deleted_at) FROM bookmarks WHERE id NOT IN (SELECT id FROM ({CURATED}) c)"
    )
)
def curated_upsert(spark, sf_dir):
    a, rows, tags = _curated(spark, sf_dir)
    after = W.upsert_curated(a, rows, tags, T.now()).archive.bookmarks
    return after.select("id", "title", "content_length", "extraction_status", F.unix_millis("deleted_at").alias("deleted_at_ms"))


@query(
    T.check(
        f"SELECT action, n FROM (SELECT 'upserted' AS action, COUNT(*) AS n FROM ({_CURATED_ALL}) c UNION ALL SELECT 'created', 1 UNION ALL SELECT 'reused', 1) s"
    )
)
def curated_counters(spark, sf_dir):
    a, rows, tags = _curated(spark, sf_dir)
    return W.change_summary(W.upsert_curated(a, rows, tags, T.now()).applied)


@query(
    T.check(
        f"SELECT tag_id, COUNT(*) AS n FROM (SELECT tag_id FROM links WHERE bookmark_id NOT IN (SELECT id FROM ({CURATED}) c) UNION ALL "
        f"SELECT UNNEST(['cur-tag', 'fr']) FROM ({_CURATED_ALL}) c) l GROUP BY tag_id"
    )
)
def curated_links(spark, sf_dir):
    a, rows, tags = _curated(spark, sf_dir)
    links = W.upsert_curated(a, rows, tags, T.now()).archive.links
    return links.groupBy("tag_id").agg(F.count("*").alias("n"))


@query(
    T.check(
        f"SELECT 'deleted_bookmark' AS action, (SELECT COUNT(*) FROM ({_CURATED_ALL}) c) AS n UNION ALL SELECT 'deleted_tag', 1"
    )
)
def curated_removal(spark, sf_dir):
    a, rows, tags = _curated(spark, sf_dir)
    seeded = W.upsert_curated(a, rows, tags, T.now()).archive
    own = tags.where(F.col("id") == "cur-tag")
    return W.change_summary(W.remove_curated(seeded, rows, own).applied)


# --- audit -----------------------------------------------------------------------------------------------



def _damaged() -> str:
    """The stored bookmarks with wrong statuses, missing titles, repeated ids and addresses."""
    sql = T.BOOKMARKS
    for old, new in (
        ("WHEN d.n_chars < 240 THEN 'partial'", "WHEN d.n_chars < 240 THEN 'odd'"),
        ("SPLIT_PART(d.text, CHR(10), 1) AS title", "CASE WHEN d.lang <> 'es' THEN SPLIT_PART(d.text, CHR(10), 1) END AS title"),
        ("CAST(d.doc_id AS STRING) AS id", "CAST(d.doc_id - CASE WHEN d.doc_id % 20 = 7 THEN 1 ELSE 0 END AS STRING) AS id"),
        ("REGEXP_REPLACE(COALESCE(p.url", "REGEXP_REPLACE(COALESCE(CASE WHEN d.doc_id % 30 < 2 THEN CONCAT('https://twice.example/', CAST(d.doc_id % 2 AS STRING)) END, p.url"),
    ):
        if old not in sql:
            raise ValueError(f"not in the bookmarks: {old}")
        sql = sql.replace(old, new, 1)
    return sql


# Links of bookmarks and of tags that are not stored, and bookmarks with very many tags.
DAMAGED = _damaged()
DAMAGED_LINKS = f"""{T.LINKS}
UNION ALL SELECT CONCAT('x', CAST(page_id AS STRING)), 'fr' FROM pages
UNION ALL SELECT CAST(page_id AS STRING), 'ghost' FROM pages
UNION ALL SELECT CAST(doc_id % 3 AS STRING), CONCAT('many', CAST(doc_id AS STRING)) FROM documents
"""


@query(
    T.check(
        "SELECT 'missing_value' AS rule, id AS key, COUNT(*) AS n FROM damaged WHERE title IS NULL GROUP BY id UNION ALL "
        "SELECT 'unknown_status', id, COUNT(*) FROM damaged WHERE extraction_status = 'odd' GROUP BY id UNION ALL "
        "SELECT 'duplicate_id', id, COUNT(*) FROM damaged GROUP BY id HAVING COUNT(*) > 1 UNION ALL "
        "SELECT 'duplicate_url', normalized_url, COUNT(*) FROM damaged GROUP BY 2 HAVING COUNT(*) > 1 UNION ALL "
        "SELECT 'duplicate_tag_name', normalized_name, COUNT(*) FROM (SELECT normalized_name FROM tags UNION ALL SELECT 'fr') t GROUP BY 2 HAVING COUNT(*) > 1 UNION ALL "
        "SELECT 'orphan_bookmark_link', bookmark_id, COUNT(*) FROM damaged_links WHERE bookmark_id NOT IN (SELECT id FROM damaged) GROUP BY 2 UNION ALL "
        "SELECT 'orphan_tag_link', tag_id, COUNT(*) FROM damaged_links WHERE tag_id NOT IN (SELECT id FROM tags) GROUP BY 2 UNION ALL "
        "SELECT 'too_many_tags', bookmark_id, COUNT(*) FROM damaged_links GROUP BY 2 HAVING COUNT(*) > 20",
        damaged=DAMAGED,
        damaged_links=DAMAGED_LINKS,
    )
)
def archive_audit(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    double = a.tags.where("id = 'fr'").withColumn("id", F.lit("fr2"))
    damaged = a.replace(
        bookmarks=W.with_defaults(spark.sql(DAMAGED)),
        links=spark.sql(DAMAGED_LINKS).withColumn("created_at", T.now()),
        tags=a.tags.unionByName(double),
    )
    return W.audit(damaged)


def _findings(archive):
    """Findings per rule, with a row also when there are none."""
    found = W.audit(archive).groupBy("rule").agg(F.count("*").alias("n"))
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))


# What the derived archive itself breaks: two bookmarks of one address.
_STORED_FINDINGS = "SELECT COUNT(*) FROM (SELECT normalized_url FROM bookmarks GROUP BY 1 HAVING COUNT(*) > 1) d"


@query(T.check(f"SELECT ({_STORED_FINDINGS}) AS findings"))
def audit_after_admission(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return _findings(W.admit(a, T.table(spark, sf_dir, TAKEN_IDS), T.now()).archive)


@query(T.check(f"SELECT ({_STORED_FINDINGS}) AS findings"))
def audit_after_renames(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return _findings(W.rename_tags(a, T.table(spark, sf_dir, RENAMES_IN_TURN), T.now()).archive)
