"""Registered queries: reading the archive."""

from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import query as Q
from folioscope.plans import tables as T
from folioscope.plans.registry import query

UP, LOW = X.ASCII_UPPER, X.ASCII_LOWER


def folded(column: str) -> str:
    return f"TRANSLATE({column}, '{UP}', '{LOW}')"


def text_test(pattern: str, escape: str = "") -> str:
    tests = [f"{folded(c)} LIKE '{pattern}'{escape}" for c in Q.SEARCHED]
    tag = (
        "EXISTS (SELECT 1 FROM links l JOIN tags t ON t.id = l.tag_id WHERE l.bookmark_id = b.id "
        f"AND {folded('t.name')} LIKE '{pattern}'{escape})"
    )
    return "(" + " OR ".join([*tests, tag]) + ")"


SEARCH = "Queon"
COMBINED = "de"


def millis(column: str, alias: str | None = None):
    return F.unix_millis(F.col(column)).alias(alias or f"{column}_ms")


def tag_string(column: str = "tags"):
    return F.array_join(F.transform(column, lambda t: t["id"]), ",").alias("tag_ids")


@query(
    T.check(
        "SELECT id, url, final_url, domain, extraction_status, content_length, retry_count, "
        "is_content_edited, CAST(NULL AS VARCHAR) AS author, EPOCH_MS(created_at) AS created_at_ms, "
        "EPOCH_MS(deleted_at) AS deleted_at_ms FROM bookmarks"
    )
)
def archive_scan(spark, sf_dir):
    return T.archive(spark, sf_dir).bookmarks.select(
        "id", "url", "final_url", "domain", "extraction_status", "content_length", "retry_count",
        "is_content_edited", "author", millis("created_at"), millis("deleted_at"),
    )


@query(
    T.check(
        "SELECT b.id, b.title FROM bookmarks b "
        f"WHERE b.deleted_at IS NULL AND {text_test('%' + SEARCH.lower() + '%')}"
    )
)
def keyword_search(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return Q.matching(a, q=SEARCH).select("id", "title")


@query(
    T.check(
        "SELECT b.id, b.domain FROM bookmarks b WHERE "
        + text_test("%=2&ref%")
    )
)
def keyword_search_in_urls(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return Q.search(a, "=2&ref").select("id", "domain")


@query(
    T.check(
        "SELECT 'percent' AS needle, COUNT(*) AS n FROM bookmarks b WHERE "
        + text_test("%!%%", " ESCAPE '!'")
        + " UNION ALL SELECT 'underscore', COUNT(*) FROM bookmarks b WHERE "
        + text_test("%!_%", " ESCAPE '!'")
        + " UNION ALL SELECT 'backslash', COUNT(*) FROM bookmarks b WHERE "
        + text_test("%" + chr(92) + "%")
    )
)
def search_wildcards_are_literal(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    counts = [
        Q.search(a, q).agg(F.count("*").alias("n")).select(F.lit(name).alias("needle"), "n")
        for name, q in (("percent", "%"), ("underscore", "_"), ("backslash", "\\"))
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    T.check(
        "SELECT b.id, b.title FROM bookmarks b WHERE b.deleted_at IS NULL AND EXISTS "
        "(SELECT 1 FROM links l WHERE l.bookmark_id = b.id AND l.tag_id = 'fr')"
    )
)
def tag_filter(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return Q.filter_tag(a, "fr", Q.live(a.bookmarks)).select("id", "title")


@query(
    T.check(
        "SELECT 'partial' AS asked, id FROM bookmarks WHERE extraction_status = 'partial' "
        "UNION ALL SELECT 'nonsense', id FROM bookmarks"
    )
)
def status_filter(spark, sf_dir):
    b = T.archive(spark, sf_dir).bookmarks
    asked = lambda s: Q.filter_status(b, s).select(F.lit(s).alias("asked"), "id")
    return asked("partial").unionByName(asked("nonsense"))


@query(
    T.check(
        "SELECT 'live' AS scope, COUNT(*) AS n FROM bookmarks WHERE deleted_at IS NULL "
        "UNION ALL SELECT 'all', COUNT(*) FROM bookmarks"
    )
)
def live_rows(spark, sf_dir):
    b = T.archive(spark, sf_dir).bookmarks
    n = lambda df, s: df.agg(F.count("*").alias("n")).select(F.lit(s).alias("scope"), "n")
    return n(Q.live(b), "live").unionByName(n(Q.live(b, include_deleted=True), "all"))


@query(
    T.check(
        "SELECT id, EPOCH_MS(deleted_at) AS deleted_at_ms FROM bookmarks "
        f"WHERE deleted_at < TIMESTAMP '{T.NOW}' - INTERVAL '10' MINUTE"
    )
)
def expired_deletes(spark, sf_dir):
    return Q.expired(T.archive(spark, sf_dir).bookmarks, T.now()).select("id", millis("deleted_at"))


@query(
    T.check(
        "SELECT b.id, b.normalized_url FROM bookmarks b WHERE b.normalized_url IN "
        "(SELECT REGEXP_REPLACE(url, '#.*$', '') FROM pages)"
    )
)
def lookup_by_url(spark, sf_dir):
    b = T.archive(spark, sf_dir).bookmarks
    keys = spark.table("pages").select(F.regexp_replace("url", "#.*$", ""))
    return Q.lookup(b, "normalized_url", keys).select("id", "normalized_url")


@query(
    T.check(
        "SELECT b.id, (SELECT STRING_AGG(l.tag_id, ',' ORDER BY l.tag_id) FROM links l "
        "WHERE l.bookmark_id = b.id) AS tag_ids, ROW_NUMBER() OVER (ORDER BY b.updated_at DESC, b.id) AS rank "
        "FROM (SELECT * FROM bookmarks b WHERE b.deleted_at IS NULL AND b.extraction_status = 'success' "
        "AND EXISTS (SELECT 1 FROM links l WHERE l.bookmark_id = b.id AND l.tag_id = 'de') "
        f"AND {text_test('%' + COMBINED + '%')} ORDER BY b.updated_at DESC, b.id LIMIT 20 OFFSET 20) b"
    )
)
def list_page(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    items, _ = Q.list_bookmarks(
        a, q=COMBINED, tag_id="de", status="success", sort="updated", number=2, size=20
    )
    rank = F.row_number().over(Q.W.orderBy(F.col("updated_at").desc(), "id")).cast("bigint")
    return items.select("id", tag_string(), rank.alias("rank"))


@query(
    T.check(
        "SELECT COUNT(*) AS total FROM bookmarks b WHERE b.deleted_at IS NULL AND "
        f"b.extraction_status = 'success' AND {text_test('%' + COMBINED + '%')}"
    )
)
def list_total(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return Q.list_bookmarks(a, q=COMBINED, status="success")[1]


@query(
    T.check(
        f"SELECT id, title FROM bookmarks WHERE deleted_at IS NULL ORDER BY {folded('title')}, id "
        "LIMIT 100 OFFSET 100"
    )
)
def title_order_page(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return Q.page(Q.live(a.bookmarks), 2, 500, "title").select("id", "title")


@query(
    T.check(
        "SELECT id, EPOCH_MS(created_at) AS created_at_ms FROM bookmarks "
        "WHERE created_at < TIMESTAMP '2024-01-01 02:00:00' ORDER BY created_at DESC, id LIMIT 50"
    )
)
def keyset_page(spark, sf_dir):
    import datetime

    after = {"created_at": datetime.datetime(2024, 1, 1, 2, 0), "id": "~"}
    b = T.archive(spark, sf_dir).bookmarks
    return Q.next_page(b, after).select("id", millis("created_at"))


@query(
    T.check(
        "SELECT id FROM ((SELECT id FROM bookmarks ORDER BY created_at DESC, id LIMIT 60) UNION "
        "(SELECT id FROM bookmarks ORDER BY updated_at DESC, id LIMIT 60)) u"
    )
)
def page_append(spark, sf_dir):
    b = T.archive(spark, sf_dir).bookmarks
    return Q.append_page(Q.page(b, 1, 60).select("id"), Q.page(b, 1, 60, "updated").select("id"))


@query(
    T.check(
        "SELECT b.id, COALESCE(STRING_AGG(l.tag_id, ',' ORDER BY l.tag_id), '') AS tag_ids "
        "FROM bookmarks b LEFT JOIN links l ON l.bookmark_id = b.id GROUP BY b.id"
    )
)
def bookmarks_with_tags(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return Q.attach_tags(a.bookmarks.select("id"), a).select("id", tag_string())


@query(
    T.check(
        "SELECT t.id, t.name, COUNT(b.id) AS bookmark_count FROM tags t "
        "LEFT JOIN links l ON l.tag_id = t.id "
        "LEFT JOIN bookmarks b ON b.id = l.bookmark_id AND b.deleted_at IS NULL GROUP BY t.id, t.name"
    )
)
def tag_counts(spark, sf_dir):
    return Q.list_tags(T.archive(spark, sf_dir)).select("id", "name", "bookmark_count")


@query(
    T.check(
        "SELECT BOOL_OR(extraction_status = 'pending') AS has_pending FROM bookmarks "
        "WHERE deleted_at IS NULL"
    )
)
def pending_flag(spark, sf_dir):
    return Q.has_pending(Q.live(T.archive(spark, sf_dir).bookmarks))


@query(
    T.check(
        "SELECT bookmark_id, position, tag_id FROM (SELECT b.id AS bookmark_id, t.id AS tag_id, "
        f"ROW_NUMBER() OVER (PARTITION BY b.id ORDER BY {folded('t.name')}, t.id) AS position "
        "FROM bookmarks b CROSS JOIN tags t WHERE NOT EXISTS (SELECT 1 FROM links l "
        "WHERE l.bookmark_id = b.id AND l.tag_id = t.id)) s WHERE position <= 6"
    )
)
def tag_suggestions(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    return Q.suggest_tags(a, a.bookmarks.select("id")).select("bookmark_id", "position", "tag_id")


PLAIN = r"'[#>*_`~\[\]()!-]', ' ', 'g'"


def squeeze(expression: str) -> str:
    return rf"TRIM(REGEXP_REPLACE({expression}, '\s+', ' ', 'g'))"


EXCERPT_QUERY = "La"
_AT = f"STRPOS(LOWER(plain_text), LOWER('{EXCERPT_QUERY}'))"
_CUT = (
    f"SUBSTR(plain_text, GREATEST(0, {_AT} - 56) + 1, "
    f"LEAST(LENGTH(plain_text), {_AT} - 1 + 107) - GREATEST(0, {_AT} - 56))"
)
_CLEAN = squeeze(f"REGEXP_REPLACE({_CUT}, {PLAIN})")
_EXCERPT = (
    f"CASE WHEN {_AT} > 0 THEN CONCAT(CASE WHEN {_AT} > 56 THEN '…' ELSE '' END, {_CLEAN}, "
    f"CASE WHEN {_AT} - 1 + 107 < LENGTH(plain_text) THEN '…' ELSE '' END) END"
)


@query(
    T.check(
        f"SELECT id, COALESCE(NULLIF({_EXCERPT}, ''), "
        "NULLIF(SUBSTR(REGEXP_REPLACE(plain_text, '^\\s+|\\s+$', '', 'g'), 1, 160), ''), "
        "CASE WHEN extraction_status = 'pending' THEN '正在提取正文…' "
        "ELSE '尚未提取到正文，可打开详情查看原因并手动补充内容。' END) AS summary FROM bookmarks"
    )
)
def card_summaries(spark, sf_dir):
    b = T.archive(spark, sf_dir).bookmarks
    return Q.with_card_summary(b, EXCERPT_QUERY).select("id", "summary")


@query(
    T.check(
        "SELECT id, REGEXP_REPLACE(title, '(?i)(on)', '<\\1>', 'g') AS marked, "
        "CAST(LENGTH(REGEXP_REPLACE(title, '(?i)on', '<>', 'g')) - LENGTH(REGEXP_REPLACE(title, '(?i)on', '<', 'g')) AS BIGINT) "
        "AS matches FROM bookmarks"
    )
)
def highlighted_titles(spark, sf_dir):
    b = T.archive(spark, sf_dir).bookmarks
    segments = X.highlight_segments(F.col("title"), "ON")
    marked = F.transform(
        "s", lambda s: F.when(s["is_match"], F.concat(F.lit("<"), s["segment"], F.lit(">"))).otherwise(s["segment"])
    )
    return b.select("id", segments.alias("s")).select(
        "id",
        F.array_join(marked, "").alias("marked"),
        F.size(F.filter("s", lambda s: s["is_match"])).cast("bigint").alias("matches"),
    )


@query(
    T.check(
        "SELECT id, CASE WHEN error_code = 'DNS_FAILED' THEN '无法解析该网址的域名' "
        "ELSE COALESCE(error_message, '无法提取网页正文') END AS failure "
        "FROM bookmarks WHERE extraction_status = 'failed'"
    )
)
def failure_texts(spark, sf_dir):
    b = T.archive(spark, sf_dir).bookmarks
    return Q.describe_errors(Q.filter_status(b, "failed")).select("id", "failure")


@query(
    T.check(
        "SELECT tag_id, id FROM (SELECT l.tag_id, b.id, ROW_NUMBER() OVER "
        "(PARTITION BY l.tag_id ORDER BY b.created_at DESC, b.id) AS r FROM links l "
        "JOIN bookmarks b ON b.id = l.bookmark_id) s WHERE r <= 6"
    )
)
def newest_per_tag(spark, sf_dir):
    a = T.archive(spark, sf_dir)
    joined = a.links.join(
        a.bookmarks.select(F.col("id").alias("bookmark_id"), F.col("created_at").alias("at")), "bookmark_id"
    )
    top = Q.cap(joined, ["tag_id"], [F.col("at").desc(), "bookmark_id"], 6)
    return top.select("tag_id", F.col("bookmark_id").alias("id"))


@query(
    T.check("SELECT tag_id, GREATEST(COUNT(*) - 60, 0) AS overflow FROM links GROUP BY tag_id")
)
def overflow_per_tag(spark, sf_dir):
    return Q.overflow(T.archive(spark, sf_dir).links, ["tag_id"], 60)
