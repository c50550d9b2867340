"""Registered queries: page captures, from HTML to articles."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import dom
from folioscope.functions import text as X
from folioscope.functions import urls as U
from folioscope.operators import changes as C
from folioscope.operators import charts as G
from folioscope.operators import extract as E
from folioscope.operators import pagination as P
from folioscope.operators import safety as S
from folioscope.operators.shred import LINK_FIELDS, node_table, shred_html
from folioscope.plans import tables as T
from folioscope.plans.registry import query
from folioscope.sources.captures import decode_captures, read_captures

# --- the given pages as the checking engine reads them: a known, plain grammar ---------------

_UNESCAPE = (
    "REPLACE(REPLACE(REPLACE(REPLACE({0}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
)


def unescape(sql: str) -> str:
    return _UNESCAPE.format(sql)


def squeeze(sql: str) -> str:
    return rf"TRIM(REGEXP_REPLACE({sql}, '\s+', ' ', 'g'))"


TITLE = "TRIM(" + unescape("REGEXP_EXTRACT(html, '(?s)<title>(.*?)</title>', 1)") + ")"
# The article without its heading, which repeats the title.
BODY = "REGEXP_REPLACE(REGEXP_EXTRACT(html, '(?s)<article>(.*?)</article>', 1), '(?s)^<h1>.*?</h1>', '')"
PLAIN = squeeze(unescape(f"REGEXP_REPLACE({BODY}, '<[^>]*>', '', 'g')"))
ORIGIN = "REGEXP_EXTRACT(url, '^https?://[^/]+')"
DOMAIN = "REGEXP_EXTRACT(url, '^https?://([^/:]+)', 1)"
WORDS = f"LEN(REGEXP_EXTRACT_ALL({PLAIN}, '[A-Za-z]+([''’-][A-Za-z]+)*'))"
PARAGRAPHS = f"LEN(REGEXP_EXTRACT_ALL({BODY}, '<p>'))"
LOGIN = f"(LENGTH({PLAIN}) < 800 AND REGEXP_MATCHES(SUBSTR({PLAIN}, 1, 1200), '(?i)sign\\s*in|log\\s*in|captcha'))"
QUALITY = (
    f"CASE WHEN {LOGIN} THEN 'JS_REQUIRED' WHEN NOT ({WORDS} >= 80 OR ({PARAGRAPHS} >= 3 AND LENGTH({PLAIN}) >= 240)) "
    "THEN 'CONTENT_TOO_SHORT' END"
)

# Markdown of a paragraph: a bold that is never closed goes on in the paragraphs after it;
# at most three of them are carried over.
_ESCAPED = (
    r"REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE({0}, '([\\*`\[\]_])', '\\\1', 'g'), "
    r"'^(-|\+ |=+|#{{1,6}} |~~~|>)', '\\\1'), '^(\d+)\. ', '\1\\. ')"
)
_PARAGRAPH_TEXT = unescape(r"REGEXP_REPLACE(part, '<[^>]*>', '', 'g')")
_FLAT = r"REGEXP_REPLACE({0}, '\s+', ' ', 'g')"
_TEXT = f"LTRIM({_FLAT.format(_PARAGRAPH_TEXT)})"
_BLOCK = (
    f"CONCAT(REPEAT('**', bold), {_ESCAPED.format(_TEXT)}, CASE WHEN part LIKE '%<br>%' THEN CHR(10) ELSE '' END, REPEAT('**', bold))"
)
PARTS = (
    "SELECT page_id, i, part, CAST(LEAST(3, COALESCE(SUM(CASE WHEN part LIKE '%<b>%' THEN 1 ELSE 0 END) OVER "
    "(PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS INT) "
    "+ CASE WHEN part LIKE '%<b>%' THEN 1 ELSE 0 END AS bold "
    f"FROM (SELECT page_id, UNNEST(STRING_SPLIT({BODY}, '<p>'))  AS part, GENERATE_SUBSCRIPTS(STRING_SPLIT({BODY}, '<p>'), 1) AS i FROM pages) x"
)
MARKDOWN = (
    f"SELECT page_id, REGEXP_REPLACE(REGEXP_REPLACE(STRING_AGG({_BLOCK}, CONCAT(CHR(10), CHR(10)) ORDER BY i), '[ \\t]+\\n', CHR(10), 'g'), '^\\s+|\\s+$', '', 'g') AS markdown "
    f"FROM ({PARTS}) p WHERE REGEXP_MATCHES({_PARAGRAPH_TEXT}, '\\S') GROUP BY page_id"
)


def pages(spark, sf_dir):
    T.given(spark, sf_dir)
    return read_captures(spark, f"{sf_dir}/pages.parquet")


@query(
    f"SELECT {DOMAIN} AS domain, COALESCE({QUALITY}, 'success') AS outcome, COUNT(*) AS captures, "
    "COUNT(DISTINCT REGEXP_REPLACE(url, '#.*$', '')) AS addresses, "
    f"SUM(LENGTH({PLAIN})) AS characters FROM pages GROUP BY 1, 2"
)
def domain_status_report(spark, sf_dir):
    text = E.main_content(pages(spark, sf_dir))
    judged = U.with_normalized_url(text, "url", domain="domain").withColumn(
        "outcome",
        F.coalesce(X.content_quality(F.col("plain_text"), F.col("paragraphs"), F.lit(False)), F.lit("success")),
    )
    return judged.groupBy("domain", "outcome").agg(
        F.count("*").alias("captures"),
        F.count_distinct("normalized_url").alias("addresses"),
        F.sum(X.utf16_length(F.col("plain_text"))).alias("characters"),
    )


@query(
    "SELECT page_id, REGEXP_REPLACE(url, '#.*$', '') AS bare, 200 AS status_code, 'text/html' AS content_type, LENGTH(html) AS size FROM pages"
)
def capture_scan(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", F.regexp_replace("url", "#.*$", "").alias("bare"), "status_code", "content_type", F.length("html").cast("bigint").alias("size")
    )


_COUNT = "LEN(REGEXP_EXTRACT_ALL(html, '{0}'))"


@query(
    "SELECT page_id, tag, n FROM (SELECT page_id, 'li' AS tag, " + _COUNT.format("<li>") + " AS n FROM pages UNION ALL SELECT page_id, 'a', " + _COUNT.format("<a ")
    + " FROM pages UNION ALL SELECT page_id, 'p', " + _COUNT.format("<p>") + " FROM pages UNION ALL SELECT page_id, 'br', " + _COUNT.format("<br>")
    + " FROM pages UNION ALL SELECT page_id, 'script', " + _COUNT.format("<script>") + " FROM pages) x WHERE n > 0"
)
def node_counts(spark, sf_dir):
    nodes = node_table(shred_html(pages(spark, sf_dir)))
    return nodes.where(F.col("tag").isin("li", "a", "p", "br", "script")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, {squeeze(TITLE)} AS title, CONCAT({ORIGIN}, '/favicon.ico') AS favicon_url, CAST(NULL AS VARCHAR) AS author FROM pages")
def page_metadata(spark, sf_dir):
    m = E.extract_metadata(shred_html(pages(spark, sf_dir)))
    return m.select("page_id", X.collapse_space(F.col("title")).alias("title"), "favicon_url", "author")


@query(
    "SELECT page_id, n, ARRAY_TO_STRING(LIST_TRANSFORM(STRING_SPLIT(target, ''), lambda c: CASE WHEN UNICODE(c) > 127 THEN URL_ENCODE(c) ELSE c END), '') AS target, text FROM (SELECT page_id, UNNEST(hrefs) AS href, UNNEST(texts) AS text, GENERATE_SUBSCRIPTS(hrefs, 1) AS n, CONCAT(o, UNNEST(hrefs)) AS target "
    "FROM (SELECT page_id, " + ORIGIN + " AS o, REGEXP_EXTRACT_ALL(html, '<a href=\"([^\"]*)\">', 1) AS hrefs, REGEXP_EXTRACT_ALL(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) AS texts FROM pages) x) y"
)
def page_links(spark, sf_dir):
    links = E.extract_links(shred_html(pages(spark, sf_dir)))
    order = F.row_number().over(W.partitionBy("page_id").orderBy("seq")).cast("bigint")
    return links.withColumn("n", order).select("page_id", "n", F.col("url").alias("target"), "text")


@query(f"SELECT page_id, TRUE AS has_main, {PLAIN} AS plain_text FROM pages")
def main_texts(spark, sf_dir):
    return E.main_content(pages(spark, sf_dir)).select("page_id", "has_main", "plain_text")


@query(MARKDOWN)
def page_markdown(spark, sf_dir):
    out = E.extract(pages(spark, sf_dir))
    return out.where(F.length("markdown_content") > 0).select("page_id", F.col("markdown_content").alias("markdown"))


@query(
    f"SELECT p.page_id, p.url AS final_url, {TITLE} AS title, {DOMAIN} AS domain, {PLAIN} AS plain_text, COALESCE(m.markdown, '') AS markdown_content, "
    f"COALESCE(LENGTH(m.markdown), 0) AS content_length, CASE WHEN {QUALITY} IS NULL THEN 'success' ELSE 'partial' END AS extraction_status, {QUALITY} AS error_code, 200 AS http_status_code "
    f"FROM pages p LEFT JOIN ({MARKDOWN}) m ON m.page_id = p.page_id"
)
def full_extraction(spark, sf_dir):
    return E.extract(pages(spark, sf_dir)).select(
        "page_id", "final_url", "title", "domain", "plain_text", "markdown_content", "content_length", "extraction_status", "error_code", "http_status_code"
    )


# Captures with all kinds of outcomes, made of the pages.
OUTCOMES = """
SELECT page_id, url, CASE WHEN page_id % 12 = 1 THEN '' WHEN page_id % 12 = 2 THEN '<html><head><title>Only a title</title></head><body></body></html>'
  WHEN page_id % 12 = 3 THEN '<html><body><form><p>Enter</p><input type="password" name="p"></form></body></html>' ELSE html END AS html,
  CAST(CASE page_id % 12 WHEN 4 THEN 404 WHEN 5 THEN 403 WHEN 6 THEN 503 ELSE 200 END AS INT) AS status_code,
  CASE WHEN page_id % 12 = 7 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type FROM pages
"""


@query(
    T.check(
        "SELECT page_id, CASE WHEN page_id % 12 IN (1, 4, 5, 6, 7) THEN 'failed' WHEN page_id % 12 IN (2, 3) OR q IS NOT NULL THEN 'partial' ELSE 'success' END AS extraction_status, "
        "CASE page_id % 12 WHEN 1 THEN 'EMPTY_RESPONSE' WHEN 2 THEN 'CONTENT_TOO_SHORT' WHEN 3 THEN 'JS_REQUIRED' WHEN 4 THEN 'HTTP_NOT_FOUND' WHEN 5 THEN 'HTTP_FORBIDDEN' "
        "WHEN 6 THEN 'HTTP_SERVER_ERROR' WHEN 7 THEN 'UNSUPPORTED_CONTENT_TYPE' ELSE q END AS error_code, "
        "CASE page_id % 12 WHEN 2 THEN 'Only a title' WHEN 1 THEN d WHEN 3 THEN d WHEN 4 THEN d WHEN 5 THEN d WHEN 6 THEN d WHEN 7 THEN d ELSE t END AS title "
        f"FROM (SELECT page_id, {QUALITY} AS q, {DOMAIN} AS d, {TITLE} AS t FROM pages) x"
    )
)
def extraction_outcomes(spark, sf_dir):
    captures = T.table(spark, sf_dir, OUTCOMES)
    return E.extract(captures).select("page_id", "extraction_status", "error_code", "title")


@query(
    "SELECT page_id, 1 + page_id % 3 AS scripts, 2 AS event_attributes, 2 AS script_links, 1 AS svg_outside_links FROM pages"
)
def unsafe_markup(spark, sf_dir):
    df = T.table(spark, sf_dir, UNSAFE)
    return E.audit_markup(shred_html(df))


UNSAFE = """
SELECT page_id, url, REPLACE(html, '</article>', CONCAT('<img src=x onerror="a()" onload="b()"><a href=" java', CHR(10), 'script:alert(1)">x</a><iframe src="JavaScript:1"></iframe>',
  '<svg><use href="#in"></use><use xlink:href="https://out.example/x"></use></svg>', REPEAT('<script>1</script>', CAST(page_id % 3 AS INT)), '</article>')) AS html FROM pages
"""

# --- pages with more kinds of content, built around the given ones ----------------------------------

_IMG = "https://cdn.example/"
RICH = f"""
SELECT page_id, url, 200 AS status_code, 'text/html' AS content_type, REPLACE(REPLACE(html, '<head>', CONCAT('<head><meta name="twitter:title" content="Twitter ', CAST(page_id AS STRING), '">',
  CASE WHEN page_id % 2 = 0 THEN CONCAT('<meta property="og:title" content=" OG &lt;', CAST(page_id AS STRING), '&gt; ">') ELSE '' END,
  '<meta name="description" content="Described"><meta property="article:author" content="Ann"><link rel="shortcut ICON" href="i/f.ico">',
  '<meta property="og:image" content="/cover-', CAST(page_id AS STRING), '.png">')), '</article>', CONCAT('</b></b></b></p>',
  '<img src="/img/blank.gif" data-src="{_IMG}lazy-', CAST(page_id AS STRING), '.png" alt="Lazy [one]">',
  '<figure><img src="pic.jpg"><figcaption> Cap ', CAST(page_id AS STRING), ' </figcaption></figure>',
  '<a href="{_IMG}full.webp"><img src="{_IMG}thumb.webp"></a>',
  '<picture><source srcset="{_IMG}s.png 1x, {_IMG}l.png 2x"><img data-lazy=""></picture>',
  '<img srcset="{_IMG}a.png 300w, {_IMG}b.png 200w">',
  '<figure style="color: red; background-image: url(''/bg.png'')" title="Back"></figure>',
  '<table><thead><tr><th>Name</th><th>Share</th></tr></thead><tbody><tr><td>row</td><td><span aria-label="', CAST(page_id % 100 AS STRING), '% share"><i>dot</i></span></td></tr></tbody></table>',
  '<pre><code class="hljs language-sql">SELECT 1', CHR(10), '  FROM t', CHR(10), '</code></pre><ul><li>one<ol><li>deep</li></ol></li><li>two</li></ul>',
  '<blockquote><p>said ', CAST(page_id AS STRING), '</p><p>again</p></blockquote><p>a <em> wide </em>end <a href="/n?x=(1)">link</a></p></article>')) AS html FROM pages
"""


def rich(spark, sf_dir):
    return T.table(spark, sf_dir, RICH)


@query(
    f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CONCAT('OG <', CAST(page_id AS STRING), '>') ELSE CONCAT('Twitter ', CAST(page_id AS STRING)) END AS title, "
    f"'Described' AS description, 'Ann' AS author, CONCAT({ORIGIN}, REGEXP_REPLACE(REGEXP_EXTRACT(url, '^https?://[^/]+([^?#]*)', 1), '[^/]*$', ''), 'i/f.ico') AS favicon_url, "
    f"CONCAT({ORIGIN}, '/cover-', CAST(page_id AS STRING), '.png') AS cover_image_url FROM pages"
)
def metadata_priorities(spark, sf_dir):
    return E.extract_metadata(shred_html(rich(spark, sf_dir))).drop("url")


_FOLDER = f"CONCAT({ORIGIN}, REGEXP_REPLACE(REGEXP_EXTRACT(url, '^https?://[^/]+([^?#]*)', 1), '[^/]*$', ''))"


@query(
    f"SELECT page_id, 1 AS ordinal, CONCAT('{_IMG}lazy-', CAST(page_id AS STRING), '.png') AS src, 'Lazy [one]' AS alt FROM pages UNION ALL "
    f"SELECT page_id, 2, CONCAT({_FOLDER}, 'pic.jpg'), CONCAT('Cap ', CAST(page_id AS STRING)) FROM pages UNION ALL "
    f"SELECT page_id, 3, '{_IMG}full.webp', '文章图片 3' FROM pages UNION ALL SELECT page_id, 4, '{_IMG}l.png', '文章图片 4' FROM pages UNION ALL "
    f"SELECT page_id, 5, '{_IMG}a.png', '文章图片 5' FROM pages UNION ALL SELECT page_id, 6, CONCAT({ORIGIN}, '/bg.png'), 'Back' FROM pages"
)
def page_images(spark, sf_dir):
    return E.extract_images(shred_html(rich(spark, sf_dir)))


@query("SELECT page_id, CONCAT(CAST(page_id % 100 AS STRING), '%') AS label FROM pages")
def repaired_table_cells(spark, sf_dir):
    return E.repair_cells(shred_html(rich(spark, sf_dir))).select("page_id", "label")


@query("SELECT page_id, 'sql' AS language, CONCAT('SELECT 1', CHR(10), '  FROM t') AS code FROM pages")
def code_blocks(spark, sf_dir):
    return E.extract_code(shred_html(rich(spark, sf_dir))).select("page_id", "language", "code")


@query(
    "SELECT page_id, 'img' AS tag, 'figure' AS inside, 1 AS n FROM pages UNION ALL SELECT page_id, 'img', 'a', 1 FROM pages UNION ALL "
    "SELECT page_id, 'img', 'picture', 1 FROM pages UNION ALL SELECT page_id, 'code', 'pre', 1 FROM pages"
)
def enclosing_elements(spark, sf_dir):
    nodes = F.col("nodes")
    kinds = ("figure", "link", "picture", "pre")
    near = lambda n: F.get(nodes, F.greatest(*(n["inside"][k] for k in kinds)))["tag"]
    rows = F.transform(dom.with_tag(nodes, "img", "code"), lambda n: F.struct(n["tag"].alias("tag"), near(n).alias("inside")))
    found = shred_html(rich(spark, sf_dir)).select("page_id", F.inline(rows))
    return found.where("inside IS NOT NULL").groupBy("page_id", "tag", "inside").agg(F.count("*").alias("n"))


_TAIL = (
    f"CONCAT('![Lazy one]({_IMG}lazy-', id, '.png)', CHR(10), CHR(10), '![Cap ', id, '](', folder, 'pic.jpg)', CHR(10), CHR(10), 'Cap ', id, CHR(10), CHR(10), "
    f"'[![文章图片 3]({_IMG}full.webp)]({_IMG}full.webp)![文章图片 4]({_IMG}l.png)![文章图片 5]({_IMG}a.png)', CHR(10), CHR(10), '![Back](', o, '/bg.png)', CHR(10), CHR(10), "
    "'| Name | Share |', CHR(10), '| --- | --- |', CHR(10), '| row | ', label, '% |', CHR(10), CHR(10), '```sql', CHR(10), 'SELECT 1', CHR(10), '  FROM t', CHR(10), '```', CHR(10), CHR(10), "
    "'-   one', CHR(10), '    1.  deep', CHR(10), '-   two', CHR(10), CHR(10), '> said ', id, CHR(10), '>', CHR(10), '> again', CHR(10), CHR(10), "
    r"'a *wide* end [link](', o, '/n?x=\(1\))')"
)


@query(
    f"SELECT page_id, {_TAIL} AS tail FROM (SELECT page_id, CAST(page_id AS STRING) AS id, CAST(page_id % 100 AS STRING) AS label, {ORIGIN} AS o, {_FOLDER} AS folder FROM pages) x"
)
def rich_markdown(spark, sf_dir):
    md = E.extract(rich(spark, sf_dir)).select("page_id", "markdown_content")
    return md.select("page_id", F.regexp_extract("markdown_content", r"(?s)(!\[Lazy.*)$", 1).alias("tail"))


# --- raw bytes -------------------------------------------------------------------------------------------

RAW = """
SELECT page_id, REPLACE(html, '<meta charset="utf-8">', '') AS t, CAST(page_id % 6 AS INT) AS kind FROM pages
"""


@query(
    T.check(
        "SELECT page_id, CASE kind WHEN 5 THEN CONCAT('<meta charset=''latin1''>', t) WHEN 4 THEN CONCAT('<meta charset=\"koi8-zz\">', t) ELSE t END AS html FROM raw_pages",
        raw_pages=RAW,
    )
)
def decoded_captures(spark, sf_dir):
    t = F.col("t")
    bom = lambda h: F.unhex(F.lit(h))
    body = (
        F.when(F.col("kind") == 0, F.encode(t, "UTF-8"))
        .when(F.col("kind") == 1, F.concat(bom("EFBBBF"), F.encode(t, "UTF-8")))
        .when(F.col("kind") == 2, F.concat(bom("FFFE"), F.encode(t, "UTF-16LE")))
        .when(F.col("kind") == 3, F.encode(t, "ISO-8859-1"))
        .when(F.col("kind") == 4, F.encode(F.concat(F.lit('<meta charset="koi8-zz">'), t), "UTF-8"))
        .otherwise(F.encode(F.concat(F.lit("<meta charset='latin1'>"), t), "ISO-8859-1"))
    )
    header = F.when(F.col("kind") == 3, 'text/html; Charset="ISO-8859-1"').when(F.col("kind") == 0, "text/html; charset=nonsense").when(F.col("kind") == 1, "text/html; charset=latin1")
    df = T.table(spark, sf_dir, RAW).select("page_id", body.alias("body"), header.alias("content_type"))
    return decode_captures(df).select("page_id", "html")


# --- pagination --------------------------------------------------------------------------------------------

# Each page becomes an article of three pages that link to one another, and to others. Some
# roots were redirected to https, some could not be fetched.
SERIES = """
SELECT page_id * 10 + n AS page_id, CONCAT(CASE WHEN page_id % 10 = 5 AND n = 1 THEN 'http' ELSE 'https' END, '://s.example/a', CAST(page_id AS STRING), CASE WHEN n = 1 THEN '' ELSE CONCAT('_', CAST(n AS STRING)) END, '.html') AS url,
  CONCAT('https://s.example/a', CAST(page_id AS STRING), CASE WHEN n = 1 THEN '' ELSE CONCAT('_', CAST(n AS STRING)) END, '.html') AS final_url,
  CAST(CASE WHEN page_id % 10 = 3 AND n = 3 THEN 404 WHEN page_id % 10 = 7 AND n = 1 THEN 500 ELSE 200 END AS INT) AS status_code, 'text/html' AS content_type,
  CONCAT('<html><head><title>Series ', CAST(page_id AS STRING), '</title></head><body><article><p>', REPEAT(CONCAT('Unique part ', CAST(n AS STRING), ' of the long story here. '), 20), '</p>',
    '<p>', CASE WHEN n > 1 THEN CONCAT('<a href="/a', CAST(page_id AS STRING), '.html">1</a> <a href="/a', CAST(page_id AS STRING), '_2.html">2</a>') ELSE '' END, '</p>',
    CASE WHEN n < 3 THEN CONCAT('<p><a rel="next" href="/a', CAST(page_id AS STRING), '_', CAST(n + 1 AS STRING), '.html">下一页</a></p>') ELSE '' END,
    '<p><a href="/z9_2.html">2</a> <a href="https://other.example/page/2">next</a><a href="#note">3</a></p></article></body></html>') AS html
FROM pages CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) k
"""


# The same addresses with the given pages behind them: the links stand at the end of the article.
LINKED = SERIES.replace(
    SERIES[SERIES.index("  CONCAT('<html><head>") : SERIES.index("    '<p>', CASE WHEN n > 1")],
    "  REPLACE(html, '</article>', CONCAT(\n",
).replace("</a></p></article></body></html>') AS html", "</a></p></article>')) AS html")


def linked(spark, sf_dir):
    return T.table(spark, sf_dir, LINKED)


def series(spark, sf_dir):
    return T.table(spark, sf_dir, SERIES)


@query(
    "SELECT CONCAT('https://s.example/a', CAST(page_id AS STRING), f, '.html') AS page_url, CONCAT('https://s.example/a', CAST(page_id AS STRING), '_', CAST(n AS STRING), '.html') AS url, n AS page_number "
    "FROM pages CROSS JOIN (SELECT '' AS f, 2 AS n UNION ALL SELECT '_2', 3 UNION ALL SELECT '_3', 2) k"
)
def follow_up_pages(spark, sf_dir):
    links = E.extract_links(shred_html(linked(spark, sf_dir), fields=LINK_FIELDS))
    return P.discover_pages(links, K.MAX_SERIES_PAGES).select("page_url", "url", "page_number")


_ROOT = "CONCAT(CASE WHEN page_id % 10 = 5 THEN 'http' ELSE 'https' END, '://s.example/a', CAST(page_id AS STRING), '.html')"
_HOME = "CONCAT('https://s.example/a', CAST(page_id AS STRING), '.html')"


@query(
    f"SELECT {_ROOT} AS root_url, CASE WHEN n = 1 THEN {_ROOT} ELSE CONCAT('https://s.example/a', CAST(page_id AS STRING), f, '.html') END AS url, n AS page_number "
    "FROM pages CROSS JOIN (SELECT '' AS f, 1 AS n UNION ALL SELECT '_2', 2 UNION ALL SELECT '_3', 3) k"
)
def reachable_pages(spark, sf_dir):
    captures = linked(spark, sf_dir)
    roots = captures.where("page_id % 10 = 1").select("url")
    links = E.extract_links(shred_html(captures, fields=LINK_FIELDS))
    edges = P.discover_pages(links, K.MAX_SERIES_PAGES)
    return P.follow_pages(roots, edges, K.MAX_SERIES_PAGES)


_PART = "TRIM(REPEAT(CONCAT('Unique part ', CAST(n AS STRING), ' of the long story here. '), 20))"
_TEXT_OF = "CONCAT('## 第 {0} 页', CHR(10), CHR(10), " + _PART.replace("CAST(n AS STRING)", "'{0}'") + ")"
_RULE = "CHR(10), CHR(10), '---', CHR(10), CHR(10)"


_MERGED = (
    f"CASE WHEN page_id % 10 = 7 THEN '' ELSE CONCAT({_TEXT_OF.format(1)}, {_RULE}, {_TEXT_OF.format(2)}, CASE WHEN page_id % 10 = 3 THEN '' ELSE CONCAT({_RULE}, {_TEXT_OF.format(3)}) END) END"
)
_ARTICLE = (
    f"{_HOME} AS final_url, CASE WHEN page_id % 10 = 7 THEN 's.example' ELSE CONCAT('Series ', CAST(page_id AS STRING)) END AS title, 's.example' AS domain, "
    f"CASE WHEN page_id % 10 <> 7 THEN {_PART.replace('CAST(n AS STRING)', chr(39) + '1' + chr(39))} END AS description, CAST(NULL AS VARCHAR) AS author, "
    "CASE WHEN page_id % 10 <> 7 THEN 'https://s.example/favicon.ico' END AS favicon_url, CAST(NULL AS VARCHAR) AS cover_image_url, "
    "CASE WHEN page_id % 10 = 7 THEN 500 ELSE 200 END AS http_status_code, "
    "CASE page_id % 10 WHEN 3 THEN 'partial' WHEN 7 THEN 'failed' ELSE 'success' END AS extraction_status, "
    "CASE page_id % 10 WHEN 3 THEN 'PAGINATION_PARTIAL' WHEN 7 THEN 'HTTP_SERVER_ERROR' END AS error_code, "
    f"CASE page_id % 10 WHEN 3 THEN '已保存 2 页，另有 1 页抓取失败' WHEN 7 THEN '{K.ERROR_MESSAGES['HTTP_SERVER_ERROR']}' END AS error_message, "
    f"{_MERGED} AS markdown_content, LENGTH({_MERGED}) AS content_length"
)


def merged(spark, sf_dir):
    captures = series(spark, sf_dir)
    roots = captures.where("page_id % 10 = 1").select("url")
    return P.follow_and_merge(roots, None, E.extract(captures, links=True), K.MAX_SERIES_PAGES)


@query(
    f"SELECT {_ROOT} AS root_url, CASE page_id % 10 WHEN 3 THEN 2 WHEN 7 THEN 0 ELSE 3 END AS pages, CASE WHEN page_id % 10 = 3 THEN 1 ELSE 0 END AS failed_pages, {_ARTICLE} FROM pages"
)
def merged_articles(spark, sf_dir):
    return merged(spark, sf_dir).drop("plain_text")


@query(f"SELECT CAST(page_id AS VARCHAR) AS id, {_ARTICLE} FROM pages JOIN documents ON doc_id = page_id WHERE doc_id % 11 = 0")
def merged_articles_stored(spark, sf_dir):
    """The merged articles as the results of the pending bookmarks."""
    stored = T.archive(spark, sf_dir)
    results = merged(spark, sf_dir).withColumn("bookmark_id", F.regexp_extract("root_url", r"a(\d+)\.html", 1))
    rows = C.apply_extractions(stored, results, T.now()).applied
    return rows.select(
        "id", "final_url", "title", "domain", "description", "author", "favicon_url", "cover_image_url",
        "http_status_code", "extraction_status", "error_code", "error_message", "markdown_content", "content_length",
    )


@query(
    T.check(
        f"SELECT series, first_url, pages, COUNT(*) AS members FROM (SELECT series, FIRST_VALUE(url) OVER (PARTITION BY series ORDER BY n, url) AS first_url, COUNT(*) OVER (PARTITION BY series) AS pages FROM "
        f"(SELECT url, CASE WHEN url LIKE '%?page=2%' THEN 2 ELSE COALESCE(TRY_CAST(REGEXP_EXTRACT(path, '/(\\d+)/?$', 1) AS BIGINT), 1) END AS n, "
        f"CONCAT({ORIGIN}, REGEXP_REPLACE(REGEXP_REPLACE(path, '/\\d+/?$', ''), '/$', ''), CASE WHEN url LIKE '%?page=%' THEN '?ref=x' WHEN url LIKE '%utm_source%' THEN '?utm_source=feed' ELSE '' END) AS series "
        "FROM (SELECT url, REGEXP_EXTRACT(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages) p) q) w GROUP BY 1, 2, 3"
    )
)
def series_membership(spark, sf_dir):
    members = P.series_members(pages(spark, sf_dir))
    return members.groupBy("series", "first_url", "pages").agg(F.count("*").alias("members"))


BLOCKS = """
SELECT page_id, CONCAT('https://s.example/a', CAST(page_id AS STRING), '.html') AS first_url, CONCAT(url, ' kept text', CHR(10), CHR(10),
  'Go [1](https://s.example/a', CAST(page_id AS STRING), '_1.html) [2](https://s.example/a', CAST(page_id AS STRING), '_2.html)', CHR(10), CHR(10),
  '**[NEXT](https://s.example/a', CAST(page_id AS STRING), '_2.html)** >', CHR(10), CHR(10),
  'See [part](https://s.example/a', CAST(page_id AS STRING), '_2.html)', CHR(10), CHR(10), CHR(10), '[a](https://x.example/1) [b](https://x.example/2)') AS md FROM pages
"""


@query(
    T.check(
        "SELECT page_id, CONCAT(url, ' kept text', CHR(10), CHR(10), 'See [part](https://s.example/a', CAST(page_id AS STRING), '_2.html)', CHR(10), CHR(10), '[a](https://x.example/1) [b](https://x.example/2)') AS md FROM pages"
    )
)
def paging_blocks_removed(spark, sf_dir):
    df = T.table(spark, sf_dir, BLOCKS).withColumn("series", U.pagination_series_key(F.col("first_url")))
    return df.select("page_id", P.remove_pagination_blocks(F.col("md"), F.col("series")).alias("md"))


# --- redirects and hosts ------------------------------------------------------------------------------------------

# Chains of addresses: 10k+9 leads to 10k+8 and so on down to 10k; some end badly.
REDIRECTS = """
SELECT CONCAT('https://r.example/', CAST(event_id AS STRING)) AS url, CAST(CASE WHEN event_id % 10 = 0 THEN 200 ELSE 302 END AS INT) AS status,
  CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 100 = 13 THEN 'http://127.0.0.1/x' WHEN event_id % 100 = 24 THEN 'ftp://f.example/' WHEN event_id % 100 = 35 THEN NULL
    WHEN event_id % 100 = 41 THEN '/gone' ELSE CONCAT('../', CAST(event_id - 1 AS STRING), '#x') END AS location FROM events
"""
_FINAL = (
    "WITH RECURSIVE log AS ({log}), walk AS (SELECT url, url AS spot, 0 AS hops, status, location, CAST(NULL AS VARCHAR) AS error FROM log UNION ALL "
    "SELECT w.url, CASE WHEN t IS NULL THEN w.spot ELSE t END, w.hops + 1, l.status, l.location, CASE WHEN l.url IS NULL THEN 'UNKNOWN_ERROR' END "
    "FROM (SELECT *, CASE WHEN location LIKE '../%' THEN CONCAT('https://r.example/', REGEXP_EXTRACT(location, '(\\d+)', 1)) WHEN location = '/gone' THEN 'https://r.example/gone' END AS t FROM walk) w "
    "LEFT JOIN log l ON l.url = w.t WHERE w.t IS NOT NULL AND w.hops < 5 AND w.error IS NULL) "
    "SELECT url, ARG_MAX(spot, hops) AS final_url, CAST(MAX(hops) AS INT) AS hops, ARG_MAX(COALESCE(error, CASE WHEN status = 302 THEN CASE WHEN location LIKE 'http:%' THEN 'PRIVATE_NETWORK_BLOCKED' "
    "WHEN location LIKE 'ftp:%' THEN 'UNSUPPORTED_PROTOCOL' WHEN location IS NULL THEN 'HTTP_SERVER_ERROR' ELSE 'TOO_MANY_REDIRECTS' END ELSE '' END), hops) AS error_code FROM walk GROUP BY url"
).replace("{log}", REDIRECTS)


@query(f"SELECT url, final_url, hops, NULLIF(error_code, '') AS error_code FROM ({_FINAL}) f")
def redirect_chains(spark, sf_dir):
    log = T.table(spark, sf_dir, REDIRECTS)
    return S.resolve_redirects(log).select("url", "final_url", "hops", "error_code")


# Hosts of the pages and of the users, with the answers of two name services.
DNS_HOSTS = """
SELECT DISTINCT CONCAT('h', CAST(user_id AS STRING), '.example') AS host FROM events
UNION ALL SELECT '10.0.0.9' UNION ALL SELECT '93.184.216.34' UNION ALL SELECT '[::1]' UNION ALL SELECT 'box.internal'
"""
DNS_ANSWERS = """
SELECT CONCAT('h', CAST(user_id AS STRING), '.example') AS host, CASE WHEN user_id % 4 = 0 THEN CONCAT('198.18.0.', CAST(event_id % 200 AS STRING))
  WHEN user_id % 4 = 1 AND event_id % 40 = 1 THEN '192.168.1.8' WHEN user_id % 4 = 2 THEN CONCAT('2606:2800:220::', CAST(event_id % 7 AS STRING))
  ELSE CONCAT('93.184.216.', CAST(event_id % 50 AS STRING)) END AS address FROM events WHERE user_id % 11 <> 5
"""
TRUSTED_ANSWERS = """
SELECT CONCAT('h', CAST(user_id AS STRING), '.example') AS host, CASE WHEN user_id % 12 = 4 THEN '10.0.0.8' ELSE '93.184.216.34' END AS address FROM events WHERE user_id % 12 <> 8
"""
_VERDICT = (
    "SELECT h.host, CASE WHEN h.host IN ('10.0.0.9', '[::1]', 'box.internal') THEN 'PRIVATE_NETWORK_BLOCKED' WHEN h.host = '93.184.216.34' THEN NULL "
    "WHEN d.host IS NULL THEN 'DNS_FAILED' WHEN d.fake AND t.host IS NULL THEN 'DNS_FAILED' WHEN CASE WHEN d.fake THEN t.bad ELSE d.bad END THEN 'PRIVATE_NETWORK_BLOCKED' END AS error_code, "
    "CASE WHEN d.fake THEN 'trusted' WHEN h.host = '93.184.216.34' THEN 'literal' ELSE 'dns' END AS src FROM dns_hosts h "
    "LEFT JOIN (SELECT host, BOOL_AND(address LIKE '198.18.%') AS fake, BOOL_OR(address LIKE '198.18.%' OR address LIKE '192.168.%') AS bad FROM dns_answers GROUP BY host) d ON d.host = h.host "
    "LEFT JOIN (SELECT host, BOOL_OR(address LIKE '10.%') AS bad FROM trusted_answers GROUP BY host) t ON t.host = h.host"
)
_DNS = {"dns_hosts": DNS_HOSTS, "dns_answers": DNS_ANSWERS, "trusted_answers": TRUSTED_ANSWERS}


def _dns(spark, sf_dir):
    T.given(spark, sf_dir)
    return [spark.sql(q) for q in (DNS_HOSTS, DNS_ANSWERS, TRUSTED_ANSWERS)]


@query(
    T.check(
        "SELECT host, error_code, CASE WHEN error_code IS NULL THEN src END AS source FROM verdicts", verdicts=_VERDICT, **_DNS
    )
)
def host_verdicts(spark, sf_dir):
    return S.host_verdict(*_dns(spark, sf_dir))


@query(
    T.check(
        "SELECT DISTINCT a.host, CASE WHEN a.address LIKE '%:%' THEN 6 ELSE 4 END AS family, a.address FROM (SELECT host, address, 'dns' AS src FROM dns_answers UNION ALL "
        "SELECT host, address, 'trusted' FROM trusted_answers UNION ALL SELECT host, host, 'literal' FROM dns_hosts) a JOIN verdicts v ON v.host = a.host AND v.src = a.src WHERE v.error_code IS NULL",
        verdicts=_VERDICT,
        **_DNS,
    )
)
def connectable_addresses(spark, sf_dir):
    hosts, dns, trusted = _dns(spark, sf_dir)
    return S.safe_addresses(S.host_verdict(hosts, dns, trusted), dns, trusted)


# --- charts -----------------------------------------------------------------------------------------------------------

_SPEC = (
    "CONCAT('{\"title\":\"Sales ', CAST(page_id AS STRING), ' ', k, '\",\"$schema\":\"https://vega.github.io/schema/vega-lite/v6.json\",\"datasets\":{\"rows\":[{\"d\":1,\"v\":', "
    "CAST(page_id AS STRING), '},{\"d\":2,\"v\":', k, '}]},\"data\":{\"name\":\"rows\"},\"mark\":{\"type\":\"line\"}}')"
)
# The given pages with boxes that wait for charts at the end of the article, and the charts of two
# themes, one of them twice and one escaped, in a script behind the article.
CHART_PAGES = f"""
SELECT page_id, url, 200 AS status_code, 'text/html' AS content_type, REPLACE(html, '</article>', CONCAT('<figure><div style="width: 9px; HEIGHT: 400px"></div></figure><figure><div style="height:200px"> </div></figure><figure><div style="height:100px"></div></figure>',
  '</article><script>x([1,"theme":"green",', {_SPEC.replace(" k,", " '1',")}, ',', {_SPEC.replace(" k,", " '1',")}, ',"theme":"PINK",', REPLACE({_SPEC.replace(" k,", " '2',")}, '"', CONCAT(CHR(92), '"')), '])</script>')) AS html FROM pages
"""
_CHART_BASE = "FROM pages CROSS JOIN (SELECT 0 AS c, 'green' AS theme UNION ALL SELECT 1, 'pink') k"
_CHART_TITLE = "CONCAT('Sales ', CAST(page_id AS STRING), ' ', CAST(c + 1 AS STRING))"
_CHART_MARK = f"CONCAT('BOOKMARK-DYNAMIC-CHART-', CAST(c AS STRING), '-', UPPER(SUBSTR(SHA256(CONCAT(CAST(c AS STRING), CHR(0), {_CHART_TITLE})), 1, 12)))"


@query(f"SELECT page_id, c AS chart, {_CHART_TITLE} AS title, theme, {_CHART_MARK} AS placeholder {_CHART_BASE}")
def embedded_charts(spark, sf_dir):
    charts = G.extract_chart_specs(T.table(spark, sf_dir, CHART_PAGES), K.MAX_CHARTS)
    return charts.select("page_id", "chart", "title", "theme", "placeholder")


@query(
    f"SELECT page_id, c AS chart, {_CHART_TITLE} AS title, 'line' AS mark, CAST(r AS INT) AS row, r + 1 AS d, CASE WHEN r = 0 THEN page_id ELSE c + 1 END AS v "
    f"{_CHART_BASE} CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1) rr"
)
def chart_records(spark, sf_dir):
    rows = G.chart_rows(G.extract_chart_specs(T.table(spark, sf_dir, CHART_PAGES)))
    return rows.select(
        "page_id", "chart", "title", "mark", "row",
        F.try_variant_get("record", "$.d", "bigint").alias("d"), F.try_variant_get("record", "$.v", "bigint").alias("v"),
    )


@query(f"SELECT page_id, c AS chart, {_CHART_MARK} AS placeholder, CASE c WHEN 0 THEN 1 ELSE 2 END AS slot {_CHART_BASE}")
def chart_slots_filled(spark, sf_dir):
    captures = T.table(spark, sf_dir, CHART_PAGES)
    matched = G.match_chart_slots(shred_html(captures), G.extract_chart_specs(captures))
    order = F.row_number().over(W.partitionBy("page_id").orderBy("slot_seq")).cast("bigint")
    return matched.select("page_id", "chart", "placeholder", order.alias("slot"))


_DRAWN = "CONCAT('![Sales ', CAST(p.page_id AS STRING), ' {0}](charts/', (SELECT " + _CHART_MARK + " FROM (SELECT p.page_id AS page_id, {0} - 1 AS c) k), '.svg)')"


@query(
    f"SELECT p.page_id, {PLAIN} AS plain_text, CONCAT_WS(CONCAT(CHR(10), CHR(10)), m.markdown, {_DRAWN.format(1)}, {_DRAWN.format(2)}) AS markdown_content, 2 AS charts "
    f"FROM pages p LEFT JOIN ({MARKDOWN}) m ON m.page_id = p.page_id"
)
def extraction_with_charts(spark, sf_dir):
    """From the captured page to the text with its charts in their places, in one job."""
    drawn = lambda chart: F.concat(F.lit("charts/"), chart["placeholder"], F.lit(".svg"))
    rows = E.extract(T.table(spark, sf_dir, CHART_PAGES), chart_url=drawn, max_charts=K.MAX_CHARTS)
    return rows.select("page_id", "plain_text", "markdown_content", F.size("charts").cast("bigint").alias("charts"))


PLACED = """
SELECT doc_id, CAST(doc_id % 4 AS INT) AS kind, source, CONCAT('Start', CHR(10), CHR(10), 'MARK-', CAST(doc_id AS STRING), CHR(10), CHR(10), '## *Chart*  ', UPPER(source), CHR(10), CHR(10), 'The chart ', source, ' in a sentence.', CHR(10), text) AS md FROM documents
"""
_MDT = r"REGEXP_REPLACE(md, '^\s+|\s+$', '', 'g')"


@query(
    T.check(
        "SELECT doc_id, CASE kind WHEN 0 THEN REGEXP_REPLACE(REPLACE(md, CONCAT('MARK-', CAST(doc_id AS STRING), CHR(10)), CONCAT('![Pic](/l/1.png)', CHR(10))), '\\s+$', '') "
        "WHEN 1 THEN REGEXP_REPLACE(REPLACE(md, CONCAT('## *Chart*  ', UPPER(source), CHR(10)), CONCAT('## *Chart*  ', UPPER(source), CHR(10), CHR(10), '![Chart ', source, '](/l/1.png)', CHR(10))), '\\s+$', '') "
        f"WHEN 2 THEN CONCAT({_MDT}, CHR(10), CHR(10), '## Charts', CHR(10), CHR(10), '![Odd 1](/l/1.png)', CHR(10), CHR(10), '![Odd 2](/l/2.png)') "
        f"ELSE CONCAT({_MDT}, CHR(10), CHR(10), '## 图表', CHR(10), CHR(10), '![图](/l/1.png)') END AS md FROM placed",
        placed=PLACED,
    )
)
def placed_charts(spark, sf_dir):
    chart = lambda title, url, mark: F.struct(title.alias("title"), F.lit(url).alias("local_url"), mark.alias("placeholder"))
    none = F.lit(None).cast("string")
    charts = (
        F.when(F.col("kind") == 0, F.array(chart(F.lit("[Pic]"), "/l/1.png", F.concat(F.lit("MARK-"), F.col("doc_id").cast("string")))))
        .when(F.col("kind") == 1, F.array(chart(F.concat(F.lit("Chart "), F.col("source")), "/l/1.png", none)))
        .when(F.col("kind") == 2, F.array(chart(F.lit("Odd 1"), "/l/1.png", none), chart(F.lit("Odd 2"), "/l/2.png", none)))
        .otherwise(F.array(chart(F.lit("图"), "/l/1.png", none)))
    )
    df = T.table(spark, sf_dir, PLACED).withColumn("charts", charts)
    return df.select("doc_id", G.place_charts(F.col("md"), F.col("charts")).alias("md"))
