"""Registered queries: scalar functions over the given texts and addresses."""

from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import net as N
from folioscope.functions import text as X
from folioscope.functions import urls as U
from folioscope.functions import images as I
from folioscope.functions import charts as C
from folioscope.operators.safety import block_list, cidr_join
from folioscope.plans import tables as T
from folioscope.plans.registry import query

PLAIN = r"'[#>*_`~\[\]()!-]', ' ', 'g'"
PLAIN_PIPE = r"'[#>*_`~\[\]()|!-]', ' ', 'g'"


def squeeze(expression: str) -> str:
    return rf"TRIM(REGEXP_REPLACE({expression}, '\s+', ' ', 'g'))"


# --- addresses of pages ------------------------------------------------------------

# Spellings of the same address, and addresses that must be refused.
URL_VARIANTS = """
SELECT page_id, 'as given' AS variant, url AS raw FROM pages
UNION ALL SELECT page_id, 'fragment', CONCAT(url, '#part') FROM pages
UNION ALL SELECT page_id, 'upper case', CONCAT('  ', REPLACE(REPLACE(UPPER(SUBSTR(url, 1, 20)), 'HTTPS', 'HtTpS'), 'HTTP:', 'hTTP:'), SUBSTR(url, 21, 999), ' ') FROM pages
UNION ALL SELECT page_id, 'default port', REPLACE(REPLACE(url, '.example.com/', '.example.com:443/'), 'http:', 'https:') FROM pages
UNION ALL SELECT page_id, 'blank', '   ' FROM pages
UNION ALL SELECT page_id, 'no scheme', REPLACE(REPLACE(url, 'https://', ''), 'http://', '') FROM pages
UNION ALL SELECT page_id, 'other scheme', REPLACE(REPLACE(url, 'https:', 'ftp:'), 'http:', 'ftp:') FROM pages
UNION ALL SELECT page_id, 'user', REPLACE(url, '://', '://me:pw@') FROM pages
"""

_NORMAL = (
    "REGEXP_REPLACE(REGEXP_REPLACE(CONCAT(LOWER(REGEXP_EXTRACT(TRIM(raw), '^[A-Za-z]+://[^/?#]*')), "
    "SUBSTR(TRIM(raw), LENGTH(REGEXP_EXTRACT(TRIM(raw), '^[A-Za-z]+://[^/?#]*')) + 1)), '#.*$', ''), "
    "'^(https://[^/:]*):443/', '\\1/')"
)
_URL_ERROR = (
    "CASE WHEN variant IN ('blank', 'no scheme', 'user') THEN 'INVALID_URL' "
    "WHEN variant = 'other scheme' THEN 'UNSUPPORTED_PROTOCOL' END"
)


@query(
    T.check(
        f"SELECT page_id, variant, {_URL_ERROR} AS url_error, "
        f"CASE WHEN {_URL_ERROR} IS NULL THEN {_NORMAL} END AS normalized_url, "
        f"CASE WHEN {_URL_ERROR} IS NULL THEN REGEXP_EXTRACT({_NORMAL}, '^[a-z]+://([^/:]+)', 1) END AS domain "
        "FROM variants",
        variants=URL_VARIANTS,
    )
)
def normalized_urls(spark, sf_dir):
    df = T.table(spark, sf_dir, URL_VARIANTS)
    named = U.with_normalized_url(df, "raw", error="url_error", domain="domain")
    return named.select("page_id", "variant", "url_error", "normalized_url", "domain")


@query(
    "SELECT REGEXP_EXTRACT(url, '^https?://([^/:]+)', 1) AS domain, COUNT(*) AS pages FROM pages GROUP BY 1"
)
def pages_per_domain(spark, sf_dir):
    pages = T.given(spark, sf_dir).table("pages")
    return pages.groupBy(U.url_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


LINK_KINDS = """
SELECT page_id, url, 'rooted' AS kind, CONCAT('/a/', CAST(page_id AS STRING), '?x=1&amp;y=2') AS href FROM pages
UNION ALL SELECT page_id, url, 'absolute', CONCAT('https://other.example/', CAST(page_id AS STRING), '#end') FROM pages
UNION ALL SELECT page_id, url, 'same scheme', CONCAT('//cdn.example/', CAST(page_id AS STRING)) FROM pages
UNION ALL SELECT page_id, url, 'query only', '?page=3' FROM pages
UNION ALL SELECT page_id, url, 'parent', '../up/./here' FROM pages
UNION ALL SELECT page_id, url, 'mail', CONCAT('mailto:a', CAST(page_id AS STRING), '@example.org') FROM pages
UNION ALL SELECT page_id, url, 'script', 'javascript:void(0)' FROM pages
UNION ALL SELECT page_id, url, 'blank', '' FROM pages
"""
_ORIGIN = "REGEXP_EXTRACT(url, '^https?://[^/]+')"
_PATH = "REGEXP_EXTRACT(url, '^https?://[^/]+([^?#]*)', 1)"
_ENTITY = "REPLACE(href, '&amp;', '&')"


@query(
    T.check(
        "SELECT page_id, kind, CASE kind "
        f"WHEN 'rooted' THEN CONCAT({_ORIGIN}, {_ENTITY}) WHEN 'absolute' THEN href "
        "WHEN 'same scheme' THEN CONCAT(REGEXP_EXTRACT(url, '^https?:'), href) "
        f"WHEN 'query only' THEN CONCAT({_ORIGIN}, {_PATH}, href) "
        f"WHEN 'parent' THEN CONCAT({_ORIGIN}, REGEXP_REPLACE(REGEXP_REPLACE({_PATH}, '[^/]*$', ''), '[^/]+/$', ''), 'up/here') "
        "END AS absolute FROM link_kinds",
        link_kinds=LINK_KINDS,
    )
)
def absolute_links(spark, sf_dir):
    df = T.table(spark, sf_dir, LINK_KINDS)
    return df.select("page_id", "kind", U.absolute_url(F.col("href"), F.col("url")).alias("absolute"))


ENCODED = """
SELECT page_id, 'once' AS kind, REPLACE(REPLACE(REPLACE(REPLACE(url, ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D') AS raw FROM pages
UNION ALL SELECT page_id, 'twice', REPLACE(REPLACE(url, ':', '%253A'), '/', '%252F') FROM pages
UNION ALL SELECT page_id, 'thrice', REPLACE(url, '/', '%25252F') FROM pages
UNION ALL SELECT page_id, 'broken', CONCAT(url, '%zz') FROM pages
UNION ALL SELECT page_id, 'plus', CONCAT(' ', url, '+b%2Bc ') FROM pages
"""


@query(
    T.check(
        "SELECT page_id, kind, CASE kind WHEN 'broken' THEN raw WHEN 'thrice' THEN REPLACE(raw, '%25252F', '%2F') "
        "WHEN 'plus' THEN REPLACE(TRIM(raw), '%2B', '+') ELSE "
        "REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(raw, '%25', '%'), '%3A', ':'), '%2F', '/'), '%3F', '?'), '%3D', '=') "
        "END AS decoded FROM encoded",
        encoded=ENCODED,
    )
)
def decoded_url_candidates(spark, sf_dir):
    df = T.table(spark, sf_dir, ENCODED)
    return df.select("page_id", "kind", U.decode_url_candidate(F.col("raw")).alias("decoded"))


# Paging in paths and in parameters, around the addresses of the pages.
SERIES_URLS = """
SELECT page_id, 'as given' AS kind, url AS u, '' AS link_text FROM pages
UNION ALL SELECT page_id, 'word', CONCAT('https://s.example/a', CAST(page_id AS STRING), '/page/', CAST(page_id % 12 AS STRING)), '' FROM pages
UNION ALL SELECT page_id, 'suffix', CONCAT('https://s.example/a', CAST(page_id AS STRING), '_', CAST(page_id % 12 AS STRING), '.shtml'), '' FROM pages
UNION ALL SELECT page_id, 'text', CONCAT('https://s.example/a', CAST(page_id AS STRING), '/x'), CONCAT(' ', CAST(page_id % 1500 AS STRING), ' ') FROM pages
UNION ALL SELECT page_id, 'key', CONCAT('https://s.example/a?z=2&PageNo=', CAST(page_id % 20 AS STRING), '&b=1'), 'next' FROM pages
"""
_MARKLESS = (
    r"REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(path, '_(\d+)(\.[^./]+)$', '\2'), "
    r"'(?i)[-_/](page|p)[-_/]?(\d+)/?$', ''), '/(\d+)/?$', ''), '/$', '')"
)


@query(
    T.check(
        f"SELECT page_id, {_MARKLESS} AS stripped FROM (SELECT page_id, {_PATH} AS path FROM pages) p"
    )
)
def paths_without_page_marker(spark, sf_dir):
    pages = T.given(spark, sf_dir).table("pages")
    return pages.select(
        "page_id", U.strip_pagination_marker(U.url_path(F.col("url"))).alias("stripped")
    )


@query(
    T.check(
        "SELECT page_id, kind, CASE kind "
        "WHEN 'as given' THEN CONCAT(origin, " + _MARKLESS + ", CASE WHEN u LIKE '%?page=%' THEN '?ref=x' "
        "WHEN u LIKE '%utm_source%' THEN '?utm_source=feed' ELSE '' END) "
        "WHEN 'key' THEN 'https://s.example/a?b=1&z=2' WHEN 'suffix' THEN CONCAT('https://s.example/a', CAST(page_id AS STRING), '.shtml') "
        "WHEN 'text' THEN u ELSE CONCAT('https://s.example/a', CAST(page_id AS STRING)) END AS series "
        "FROM (SELECT *, REGEXP_EXTRACT(u, '^https?://[^/]+') AS origin, "
        "REGEXP_EXTRACT(u, '^https?://[^/]+([^?#]*)', 1) AS path FROM series_urls) s",
        series_urls=SERIES_URLS,
    )
)
def series_keys(spark, sf_dir):
    df = T.table(spark, sf_dir, SERIES_URLS)
    return df.select("page_id", "kind", U.pagination_series_key(F.col("u")).alias("series"))


@query(
    T.check(
        "SELECT page_id, kind, CASE WHEN kind = 'text' THEN CASE WHEN page_id % 1500 < 1000 THEN page_id % 1500 END "
        "WHEN kind = 'key' THEN page_id % 20 WHEN kind <> 'as given' THEN page_id % 12 "
        "WHEN u LIKE '%?page=%' THEN CAST(REGEXP_EXTRACT(u, 'page=(\\d+)', 1) AS BIGINT) "
        "ELSE TRY_CAST(REGEXP_EXTRACT(REGEXP_EXTRACT(u, '^https?://[^/]+([^?#]*)', 1), '/(\\d+)/?$', 1) AS BIGINT) END AS number "
        "FROM series_urls",
        series_urls=SERIES_URLS,
    )
)
def page_numbers(spark, sf_dir):
    df = T.table(spark, sf_dir, SERIES_URLS)
    return df.select(
        "page_id", "kind", U.pagination_page_number(F.col("u"), F.col("link_text")).alias("number")
    )


IMAGE_URLS = """
SELECT page_id, CONCAT(REGEXP_REPLACE(url, '[?#].*$', ''), CASE page_id % 6 WHEN 0 THEN '/a.PNG' WHEN 1 THEN '/b.jpeg?w=1'
  WHEN 2 THEN '/loading-icon.gif' WHEN 3 THEN '/Spacer.webp' WHEN 4 THEN '/my-pixel' ELSE '/pixels.avif' END) AS u FROM pages
UNION ALL SELECT page_id, CONCAT('data:image/png;base64,', CAST(page_id AS STRING)) FROM pages
UNION ALL SELECT page_id, '' FROM pages
"""


@query(
    T.check(
        "SELECT page_id, u, u LIKE 'http%' AND REGEXP_MATCHES(REGEXP_REPLACE(u, '[?#].*$', ''), "
        "'(?i)\\.(avif|gif|jpe?g|png|webp)$') AS is_image, u = '' OR (u LIKE 'http%' AND "
        "REGEXP_MATCHES(LOWER(REGEXP_REPLACE(u, '[?#].*$', '')), "
        "'[-_/](blank|empty|loading|placeholder|spacer|transparent|pixel)([-_. /]|$)')) AS is_placeholder "
        "FROM image_urls",
        image_urls=IMAGE_URLS,
    )
)
def image_address_tests(spark, sf_dir):
    df = T.table(spark, sf_dir, IMAGE_URLS)
    return df.select(
        "page_id",
        "u",
        U.is_image_url(F.col("u")).alias("is_image"),
        U.is_placeholder_image(F.col("u")).alias("is_placeholder"),
    )


SRCSETS = """
SELECT page_id, CONCAT('/a-', CAST(page_id AS STRING), '.png ', CAST(page_id % 7 * 100 AS STRING), 'w, /b-',
  CAST(page_id AS STRING), '.png ', CAST(page_id % 5 * 150 AS STRING), 'w') AS srcset,
  CASE WHEN page_id % 5 * 150 >= page_id % 7 * 100 THEN CONCAT('/b-', CAST(page_id AS STRING), '.png')
  ELSE CONCAT('/a-', CAST(page_id AS STRING), '.png') END AS best FROM pages
UNION ALL SELECT page_id, CONCAT('/a.png 2x,/b.png 1.5x , /c.png ', CAST(page_id AS STRING), 'w'),
  CASE WHEN page_id >= 20000 THEN '/c.png' ELSE '/a.png' END FROM pages
UNION ALL SELECT page_id, CONCAT('/p.png, /q', CAST(page_id AS STRING), '.png,'), CONCAT('/q', CAST(page_id AS STRING), '.png') FROM pages
"""


@query(T.check("SELECT page_id, srcset, best FROM srcsets", srcsets=SRCSETS))
def best_responsive_images(spark, sf_dir):
    df = T.table(spark, sf_dir, SRCSETS)
    return df.select("page_id", "srcset", U.best_srcset(F.col("srcset")).alias("best"))


LINK_TARGETS = """
SELECT id, kind, CASE n % 6 WHEN 0 THEN url WHEN 1 THEN CONCAT('#s', CAST(n AS STRING)) WHEN 2 THEN 'javascript:alert(1)'
  WHEN 3 THEN 'MAILTO:a@example.org' WHEN 4 THEN 'data:text/html,x'
  ELSE CONCAT('/api/bookmarks/', CAST(n AS STRING), '/assets/', SUBSTR(CONCAT(MD5(url), MD5(url)), 1, 24), '.png') END AS target
FROM (SELECT page_id AS id, page_id AS n, url, 'link' AS kind FROM pages UNION ALL SELECT page_id, page_id, url, 'image' FROM pages) x
"""


@query(
    T.check(
        "SELECT id, kind, target, CASE WHEN kind = 'image' THEN target LIKE 'http%' OR target LIKE '/api/%' "
        "ELSE target LIKE 'http%' OR target LIKE '#%' OR target LIKE 'MAILTO:%' END AS safe FROM link_targets",
        link_targets=LINK_TARGETS,
    )
)
def safe_link_audit(spark, sf_dir):
    df = T.table(spark, sf_dir, LINK_TARGETS)
    return df.select("id", "kind", "target", I.safe_link(F.col("target"), F.col("kind")).alias("safe"))


# --- hosts and network addresses -----------------------------------------------------

HOSTS = """
SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'LOCALHOST' WHEN 1 THEN CONCAT('p', CAST(page_id AS STRING), '.local.')
  WHEN 2 THEN 'metadata.google.internal' WHEN 3 THEN CONCAT('svc', CAST(page_id AS STRING), '.Internal')
  WHEN 4 THEN 'localhost.example' ELSE REGEXP_EXTRACT(url, '^https?://([^/]+)', 1) END AS host FROM pages
"""


@query(
    T.check(
        "SELECT page_id, host, page_id % 9 < 4 AS blocked FROM hosts", hosts=HOSTS
    )
)
def blocked_hosts(spark, sf_dir):
    df = T.table(spark, sf_dir, HOSTS)
    return df.select("page_id", "host", N.blocked_host(F.col("host")).alias("blocked"))


# An address per event, spread over public and special ranges.
ADDRESSES = """
SELECT event_id, CASE event_id % 8
  WHEN 0 THEN CONCAT('10.', CAST(user_id % 256 AS STRING), '.0.', CAST(event_id % 256 AS STRING))
  WHEN 1 THEN CONCAT('172.', CAST(user_id % 64 AS STRING), '.1.', CAST(event_id % 256 AS STRING))
  WHEN 2 THEN CONCAT('198.', CAST(16 + user_id % 4 AS STRING), '.7.', CAST(event_id % 256 AS STRING))
  WHEN 3 THEN CONCAT('192.168.', CAST(user_id % 300 AS STRING), '.9')
  WHEN 4 THEN CONCAT('100.', CAST(user_id % 256 AS STRING), '.2.', CAST(event_id % 256 AS STRING))
  WHEN 5 THEN CONCAT('2001:db8::', CAST(event_id % 1000 AS STRING))
  WHEN 6 THEN CONCAT('2606:2800:220:', CAST(user_id % 1000 AS STRING), '::', CAST(event_id % 1000 AS STRING))
  ELSE CONCAT('f', SUBSTR('0123456789abcdef', CAST(user_id % 16 + 1 AS INT), 1), '80::', CAST(event_id % 1000 AS STRING), '%eth0') END AS address
FROM events
"""
_BLOCKED_IP = (
    "CASE event_id % 8 WHEN 0 THEN TRUE WHEN 1 THEN user_id % 64 BETWEEN 16 AND 31 "
    "WHEN 2 THEN user_id % 4 IN (2, 3) WHEN 3 THEN TRUE WHEN 4 THEN user_id % 256 BETWEEN 64 AND 127 "
    "WHEN 5 THEN TRUE WHEN 6 THEN FALSE ELSE user_id % 16 IN (12, 13, 14, 15) END"
)


@query(
    T.check(
        f"SELECT event_id, address, {_BLOCKED_IP} AS blocked, "
        "event_id % 8 = 2 AND user_id % 4 IN (2, 3) AS fake FROM addresses JOIN events USING (event_id)",
        addresses=ADDRESSES,
    )
)
def blocked_addresses(spark, sf_dir):
    df = T.table(spark, sf_dir, ADDRESSES)
    return df.select(
        "event_id",
        "address",
        N.blocked_ip(F.col("address")).alias("blocked"),
        N.fake_ip(F.col("address")).alias("fake"),
    )


_NETWORKS = (
    ("10.0.0.0/8", "address LIKE '10.%'"),
    ("172.16.0.0/12", "REGEXP_MATCHES(address, '^172\\.(1[6-9]|2[0-9]|3[01])\\.')"),
    ("198.18.0.0/15", "REGEXP_MATCHES(address, '^198\\.(18|19)\\.')"),
    ("192.168.0.0/16", "REGEXP_MATCHES(address, '^192\\.168\\.([01]?[0-9]?[0-9]|2[0-4][0-9]|25[0-5])\\.')"),
    ("100.64.0.0/10", "REGEXP_MATCHES(address, '^100\\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\\.')"),
    ("2001:db8::/32", "address LIKE '2001:db8::%'"),
    ("fc00::/7", "REGEXP_MATCHES(address, '^f[cd]80:')"),
    ("fe80::/10", "address LIKE 'fe80:%'"),
    ("ff00::/8", "address LIKE 'ff80:%'"),
)


@query(
    T.check(
        " UNION ALL ".join(
            f"SELECT DISTINCT address, '{n.split('/')[0]}' AS network, {n.split('/')[1]} AS prefix FROM addresses WHERE {test}"
            for n, test in _NETWORKS
        ),
        addresses=ADDRESSES,
    )
)
def address_networks(spark, sf_dir):
    df = T.table(spark, sf_dir, ADDRESSES)
    return cidr_join(df, block_list(spark))


# --- fetching ----------------------------------------------------------------------------

FETCHES = """
SELECT page_id, url, CASE page_id % 13 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 500 WHEN 3 THEN 429
    WHEN 4 THEN 302 WHEN 5 THEN 301 WHEN 6 THEN 410 ELSE 200 END AS status,
  CASE page_id % 11 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'IMAGE/PNG; q=1' WHEN 2 THEN 'Application/XHTML+xml' ELSE 'text/html; charset=utf-8' END AS content_type,
  CASE page_id % 17 WHEN 0 THEN 0 WHEN 1 THEN 6000000 ELSE LENGTH(html) END AS bytes,
  CAST(page_id % 8 AS INT) AS hops,
  CASE WHEN page_id % 13 = 4 THEN '/moved' END AS location,
  page_id % 19 = 0 AS timed_out FROM pages
"""


@query(
    T.check(
        "SELECT page_id, CASE WHEN timed_out THEN 'REQUEST_TIMEOUT' "
        "WHEN status BETWEEN 300 AND 399 AND location IS NOT NULL AND hops >= 5 THEN 'TOO_MANY_REDIRECTS' "
        "WHEN status = 403 THEN 'HTTP_FORBIDDEN' WHEN status IN (404, 410) THEN 'HTTP_NOT_FOUND' "
        "WHEN status <> 200 THEN 'HTTP_SERVER_ERROR' "
        "WHEN NOT (LOWER(content_type) LIKE '%text/html%' OR LOWER(content_type) LIKE '%application/xhtml+xml%') THEN 'UNSUPPORTED_CONTENT_TYPE' "
        "WHEN bytes > 5242880 THEN 'CONTENT_TOO_LARGE' WHEN bytes = 0 THEN 'EMPTY_RESPONSE' END AS outcome, "
        "status IN (401, 403, 429, 503) AS retry, LOWER(content_type) LIKE 'image/png%' AS is_image "
        "FROM fetches",
        fetches=FETCHES,
    )
)
def fetch_outcomes(spark, sf_dir):
    df = T.table(spark, sf_dir, FETCHES)
    c = F.col
    outcome = N.fetch_outcome(
        c("status"), c("content_type"), c("bytes"), c("hops"), c("location"), c("timed_out"),
        K.MAX_BODY_BYTES,
    )
    return df.select(
        "page_id",
        outcome.alias("outcome"),
        N.retry_eligible(c("status"), "http").alias("retry"),
        N.content_type_ok(c("content_type"), "image").alias("is_image"),
    )


@query(
    T.check(
        "SELECT outcome, n, outcome IN ('REQUEST_TIMEOUT', 'HTTP_FORBIDDEN', 'HTTP_SERVER_ERROR') AS retry_image, "
        "outcome IN ('REQUEST_TIMEOUT', 'HTTP_SERVER_ERROR') AS retry_client FROM (SELECT CASE WHEN timed_out THEN 'REQUEST_TIMEOUT' "
        "WHEN status = 403 THEN 'HTTP_FORBIDDEN' WHEN status IN (404, 410) THEN 'HTTP_NOT_FOUND' "
        "WHEN status >= 400 THEN 'HTTP_SERVER_ERROR' ELSE 'OTHER' END AS outcome, COUNT(*) AS n FROM fetches GROUP BY 1) o",
        fetches=FETCHES,
    )
)
def retryable_failures(spark, sf_dir):
    df = T.table(spark, sf_dir, FETCHES)
    c = F.col
    plain = N.fetch_outcome(
        c("status"), F.lit("text/html"), F.lit(1), F.lit(0), F.lit(None).cast("string"), c("timed_out")
    )
    judged = df.select(
        F.when(c("timed_out") | (c("status") >= 400), plain).otherwise("OTHER").alias("outcome")
    )
    return judged.groupBy("outcome").agg(F.count("*").alias("n")).select(
        "outcome",
        "n",
        N.retry_eligible(c("outcome"), "image").alias("retry_image"),
        N.retry_eligible(c("outcome"), "client").alias("retry_client"),
    )


DUMPS = """
SELECT page_id, html, CONCAT(CASE WHEN page_id % 3 = 0 THEN CONCAT('HTTP/1.1 100 Continue', CHR(13), CHR(10), CHR(13), CHR(10)) ELSE '' END,
  CASE WHEN page_id % 10 = 9 THEN 'garbage' ELSE CONCAT('HTTP/1.1 ', CAST(200 + page_id % 5 AS STRING), ' OK') END, CHR(13), CHR(10),
  'Content-Type: text/html', CHR(13), CHR(10), 'X-Page: ', CAST(page_id AS STRING), CHR(13), CHR(10),
  'x-page:  again ', CAST(page_id AS STRING), CHR(13), CHR(10), CHR(13), CHR(10), html) AS dump FROM pages
"""


@query(
    T.check(
        "SELECT page_id, CASE WHEN page_id % 10 <> 9 THEN CAST(200 + page_id % 5 AS INT) END AS status_code, "
        "CASE WHEN page_id % 10 <> 9 THEN 'text/html' END AS content_type, "
        "CASE WHEN page_id % 10 <> 9 THEN CONCAT('again ', CAST(page_id AS STRING)) END AS x_page, "
        "CASE WHEN page_id % 10 <> 9 THEN html END AS body, "
        "CASE WHEN page_id % 10 = 9 THEN 'EMPTY_RESPONSE' END AS error_code FROM dumps",
        dumps=DUMPS,
    )
)
def http_dumps(spark, sf_dir):
    df = T.table(spark, sf_dir, DUMPS)
    parsed = df.select("page_id", N.parse_http_dump(F.encode("dump", "UTF-8")).alias("d"))
    return parsed.select(
        "page_id",
        "d.status_code",
        F.try_element_at("d.headers", F.lit("content-type")).alias("content_type"),
        F.try_element_at("d.headers", F.lit("x-page")).alias("x_page"),
        F.decode("d.body", "UTF-8").alias("body"),
        "d.error_code",
    )


# --- texts -----------------------------------------------------------------------------------


@query(f"SELECT doc_id, {squeeze(f'REGEXP_REPLACE(text, {PLAIN})')} AS plain FROM documents")
def plain_texts(spark, sf_dir):
    docs = T.given(spark, sf_dir).table("documents")
    return docs.select("doc_id", X.markdown_to_plain(F.col("text")).alias("plain"))


FENCED = """
SELECT doc_id, CONCAT('# T', CHR(10), '```js', CHR(10), 'x | y', CHR(10), '```', CHR(10), text, CHR(10), '```a```', ' tail | end') AS md FROM documents
"""


@query(
    T.check(
        "SELECT doc_id, " + squeeze(f"REGEXP_REPLACE(CONCAT('# T ', 'x | y ', text, '  tail | end'), {PLAIN_PIPE})")
        + " AS plain FROM documents"
    )
)
def plain_texts_with_code(spark, sf_dir):
    df = T.table(spark, sf_dir, FENCED)
    return df.select("doc_id", X.markdown_to_plain_fenced(F.col("md")).alias("plain"))


LOOSE = """
SELECT doc_id, CONCAT(CHR(10), '  ', REPLACE(text, '.', CONCAT('. ', CHR(9), CHR(10), CHR(10), CHR(10), CHR(10), CHR(10))), '[ ](https://x.example/y) ', CHR(10)) AS md FROM documents
"""


@query(
    T.check(
        r"SELECT doc_id, REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(md, '\n{4,}', E'\n\n\n', 'g'), "
        r"'\[\s*\]\([^)]*\)', '', 'g'), '[ \t]+\n', E'\n', 'g'), '^\s+|\s+$', '', 'g') AS md FROM loose",
        loose=LOOSE,
    )
)
def tidy_markdown(spark, sf_dir):
    df = T.table(spark, sf_dir, LOOSE)
    return df.select("doc_id", X.normalize_markdown(F.col("md")).alias("md"))


@query(
    "SELECT doc_id, CAST(GREATEST(1, FLOOR((LENGTH(text) - LENGTH(REGEXP_REPLACE(text, '[\\x{4e00}-\\x{9fa5}]', '', 'g'))) / 300.0 "
    "+ LEN(REGEXP_EXTRACT_ALL(text, '[A-Za-z0-9]+')) / 220.0 + 0.5)) AS BIGINT) AS minutes, LENGTH(text) AS content_length FROM documents"
)
def reading_minutes(spark, sf_dir):
    docs = T.given(spark, sf_dir).table("documents")
    return docs.select(
        "doc_id",
        X.reading_minutes(F.col("text")).alias("minutes"),
        X.content_length(F.col("text")).alias("content_length"),
    )


WIDE = """
SELECT doc_id, CONCAT(text, REPEAT('😀', CAST(doc_id % 4 AS INT)), REPEAT('漢', CAST(doc_id % 120 AS INT))) AS t FROM documents
"""


@query(
    T.check("SELECT doc_id, LENGTH(t) + doc_id % 4 AS units FROM wide", wide=WIDE)
)
def utf16_lengths(spark, sf_dir):
    df = T.table(spark, sf_dir, WIDE)
    return df.select("doc_id", X.utf16_length(F.col("t")).alias("units"))


_SQ = squeeze("t")


@query(
    T.check(
        f"SELECT doc_id, doc_id % 120 AS cjk_characters, LEN(REGEXP_EXTRACT_ALL({_SQ}, '[A-Za-z]+([''’-][A-Za-z]+)*')) AS latin_words, "
        f"LEN([x FOR x IN REGEXP_SPLIT_TO_ARRAY(t, '\\n\\s*\\n') IF LENGTH(TRIM(x)) > 0]) AS paragraphs, "
        f"LENGTH({_SQ}) + doc_id % 4 AS characters FROM wide",
        wide=WIDE,
    )
)
def text_statistics(spark, sf_dir):
    df = T.table(spark, sf_dir, WIDE)
    return df.select("doc_id", X.text_stats(F.col("t")).alias("s")).select("doc_id", "s.*")


JUDGED = """
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN CONCAT('Please Log  In. ', text) WHEN doc_id % 9 = 2 THEN REPEAT('漢', CAST(doc_id % 200 AS INT)) ELSE text END AS t,
  CAST(doc_id % 5 AS INT) AS paragraphs, doc_id % 23 = 0 AS has_password FROM documents
"""


@query(
    T.check(
        f"SELECT doc_id, CASE WHEN has_password OR (REGEXP_MATCHES(SUBSTR({_SQ}, 1, 1200), '(?i)登录|登入|sign\\s*in|log\\s*in|验证码|captcha') "
        f"AND LENGTH({_SQ}) < 800) THEN 'JS_REQUIRED' WHEN NOT (LEN(REGEXP_EXTRACT_ALL(t, '[\\x{{3400}}-\\x{{9fff}}]')) >= 100 "
        f"OR LEN(REGEXP_EXTRACT_ALL({_SQ}, '[A-Za-z]+([''’-][A-Za-z]+)*')) >= 80 OR (paragraphs >= 3 AND LENGTH({_SQ}) >= 240)) "
        "THEN 'CONTENT_TOO_SHORT' END AS quality FROM judged",
        judged=JUDGED,
    )
)
def content_quality(spark, sf_dir):
    df = T.table(spark, sf_dir, JUDGED)
    return df.select(
        "doc_id",
        X.content_quality(F.col("t"), F.col("paragraphs"), F.col("has_password")).alias("quality"),
    )


NAMES = """
SELECT doc_id, CONCAT('  ', text, CHR(9), ' ', UPPER(lang), '  ') AS name,
  CONCAT(source, ', ', lang, '，', source, ' ,, ', UPPER(lang)) AS list,
  CONCAT(text, '/a:b?', CHR(9)) AS title FROM documents
"""


@query(
    T.check(
        f"SELECT doc_id, {squeeze('name')} AS shown, LOWER({squeeze('name')}) AS normalized FROM names",
        names=NAMES,
    )
)
def normalized_tag_names(spark, sf_dir):
    df = T.table(spark, sf_dir, NAMES)
    return df.select(
        "doc_id",
        X.tag_display_name(F.col("name")).alias("shown"),
        X.normalize_tag_name(F.col("name")).alias("normalized"),
    )


@query(
    "SELECT doc_id, CONCAT(source, '|', lang, '|', UPPER(lang)) AS names FROM documents"
)
def split_tag_texts(spark, sf_dir):
    df = T.table(spark, sf_dir, NAMES)
    return df.select("doc_id", F.array_join(X.split_tag_names(F.col("list")), "|").alias("names"))


@query(
    T.check(
        "SELECT doc_id, COALESCE(NULLIF(SUBSTR("
        + squeeze(r"""REGEXP_REPLACE(title, '[<>:"/\\|?*\x00-\x1f]', '-', 'g')""")
        + ", 1, 80), ''), 'bookmark') AS filename FROM names",
        names=NAMES,
    )
)
def safe_filenames(spark, sf_dir):
    df = T.table(spark, sf_dir, NAMES)
    return df.select("doc_id", X.safe_filename(F.col("title")).alias("filename"))


@query(
    "SELECT page_id, SUBSTR(SHA256(url), 1, 24) AS asset, UPPER(SUBSTR(SHA256(CONCAT(CAST(page_id AS STRING), '|', url)), 1, 12)) AS mark FROM pages"
)
def hashed_names(spark, sf_dir):
    pages = T.given(spark, sf_dir).table("pages")
    mark = F.concat_ws("|", F.col("page_id").cast("string"), "url")
    return pages.select(
        "page_id", X.sha_prefix(F.col("url"), 24).alias("asset"), X.sha_prefix(mark, 12, upper=True).alias("mark")
    )


_AGE = "FLOOR((EPOCH_MS(TIMESTAMP '2024-02-01 12:30:00') - EPOCH_MS(ts)) / 60000.0 + 0.5)"


@query(
    f"SELECT event_id, CASE WHEN {_AGE} < 1 THEN '刚刚' WHEN {_AGE} < 60 THEN CONCAT(CAST(CAST({_AGE} AS BIGINT) AS STRING), ' 分钟前') "
    f"WHEN FLOOR({_AGE} / 60.0 + 0.5) < 24 AND CAST(ts AS DATE) = DATE '2024-02-01' THEN CONCAT('今天 ', STRFTIME(ts, '%H:%M')) "
    "WHEN CAST(ts AS DATE) = DATE '2024-01-31' THEN CONCAT('昨天 ', STRFTIME(ts, '%H:%M')) "
    "WHEN YEAR(ts) = 2024 THEN CONCAT(CAST(MONTH(ts) AS STRING), '月', CAST(DAY(ts) AS STRING), '日') "
    "ELSE CONCAT(CAST(YEAR(ts) AS STRING), '年', CAST(MONTH(ts) AS STRING), '月', CAST(DAY(ts) AS STRING), '日') END AS label FROM events"
)
def recency_labels(spark, sf_dir):
    events = T.given(spark, sf_dir).table("events")
    now = F.lit("2024-02-01 12:30:00").cast("timestamp")
    return events.select("event_id", X.recency_label(F.col("ts").cast("timestamp"), now).alias("label"))


# --- chart specifications -------------------------------------------------------------------------

SPECS = """
SELECT event_id, CONCAT('{"$schema":"https://vega.github.io/schema/', CASE WHEN event_id % 5 = 0 THEN 'vega' ELSE 'vega-lite' END, '/v5.json"',
  CASE event_id % 4 WHEN 0 THEN CONCAT(',"title":" ', event_type, ' "') WHEN 1 THEN CONCAT(',"title":{"text":"t ', event_type, '"}')
    WHEN 2 THEN ',"title":{"text":7}' ELSE '' END,
  CASE event_id % 3 WHEN 0 THEN ',"data":{"values":[1]}' WHEN 1 THEN ',"datasets":{"a":[2]}' ELSE ',"data":null' END,
  CASE WHEN event_id % 7 < 4 THEN ',"mark":"bar"' WHEN event_id % 7 = 4 THEN ',"layer":[]' ELSE ',"mark":""' END, '}') AS spec FROM events
"""


@query(
    T.check(
        "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN CONCAT('t ', event_type) "
        "ELSE CONCAT('Chart ', CAST(event_id AS STRING)) END AS title, "
        "event_id % 5 <> 0 AND event_id % 3 <> 2 AND event_id % 7 < 5 AS renderable "
        "FROM specs s JOIN events e USING (event_id)",
        specs=SPECS,
    )
)
def chart_spec_tests(spark, sf_dir):
    df = T.table(spark, sf_dir, SPECS).withColumn("v", F.try_parse_json("spec"))
    default = F.concat(F.lit("Chart "), F.col("event_id").cast("string"))
    return df.select(
        "event_id",
        C.chart_title(F.col("v"), default).alias("title"),
        C.chart_renderable(F.col("v")).alias("renderable"),
    )


# --- image bytes -------------------------------------------------------------------------------------

BODIES = """
SELECT page_id, url, CASE page_id % 8 WHEN 0 THEN '89504E470D0A1A0A0000' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN '474946383761' WHEN 3 THEN '474946383961'
  WHEN 4 THEN '524946460000000057454250' WHEN 5 THEN '0000002066747970617669730000' WHEN 6 THEN '203C7376672078'
  ELSE '48656C6C6F' END AS hexed,
  CASE page_id % 8 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/png' WHEN 4 THEN 'image/webp'
  WHEN 5 THEN 'image/avif' WHEN 6 THEN 'image/svg+xml' ELSE 'image/png' END AS content_type FROM pages
"""


@query(
    T.check(
        "SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'gif' WHEN 4 THEN 'webp' "
        "WHEN 5 THEN 'avif' WHEN 6 THEN 'svg' END AS extension, page_id % 8 NOT IN (3, 7) AS usable FROM bodies",
        bodies=BODIES,
    )
)
def image_types(spark, sf_dir):
    df = T.table(spark, sf_dir, BODIES).withColumn("body", F.unhex("hexed"))
    return df.select(
        "page_id",
        I.detect_image_type(F.col("body")).alias("extension"),
        I.image_body_ok(F.col("body"), F.col("content_type")).alias("usable"),
    )
