"""Pages to articles: golden cases on small pages."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import charts, extract, pagination
from folioscope.operators.shred import LINK_FIELDS, pages_to_nodes, shred_html

CAPTURE = "page_id long, url string, html string, status_code int, content_type string"


def article(body, title="Guide", head=""):
    return f"<!doctype html><html><head><title>{title}</title>{head}</head><body>{body}</body></html>"


class Pages:
    """Test pages by name; all of them are extracted in one job."""

    def __init__(self):
        self.captures, self.rows = [], None

    def add(self, html, url="https://example.com/a/b", status=200):
        self.captures.append((len(self.captures), url, html, status, "text/html"))
        return len(self.captures) - 1

    def row(self, spark, key):
        if self.rows is None:
            df = spark.createDataFrame(self.captures, CAPTURE)
            self.rows = {r.page_id: r for r in extract.extract(df).collect()}
        return self.rows[key]


PAGES = Pages()
_KEYS = {}


def run(spark, html, status=200):
    return PAGES.row(spark, _KEYS[(html, status)])


def page(html, status=200):
    """Name a page at import time, so that it is part of the one job."""
    _KEYS[(html, status)] = PAGES.add(html, status=status)
    return html


PROSE = "Old canal boats carried slate past seven locks before the mill was closed. " * 12


OG = page(
    article(
        f"<article><p>{PROSE}</p></article>",
        head='<meta name="twitter:title" content="T"><meta property="og:title" content="OG">',
    )
)


def test_og_title_wins(spark):
    assert run(spark, OG).title == "OG"


NAVIGATION_AND_SIDEBAR_ARE_DROPPED = page(
    article(
        f"<header><nav>Home Login</nav></header><main><article><h2>Part</h2><p>{PROSE}</p>"
        "<aside>Unrelated recommendation</aside></article></main><footer>Imprint</footer>"
    )
)


def test_navigation_and_sidebar_are_dropped(spark):
    row = run(spark, NAVIGATION_AND_SIDEBAR_ARE_DROPPED)
    assert row.extraction_status == "success"
    assert "## Part" in row.markdown_content
    for word in ("Home", "Unrelated", "Imprint"):
        assert word not in row.markdown_content


CODE_KEEPS_LANGUAGE_AND_LINES = page(
    article(
        f"<article><p>{PROSE}</p><pre><code class='language-ts'>let a = 1;\n\n  run(a_b);\n</code></pre></article>"
    )
)


def test_code_keeps_language_and_lines(spark):
    assert "```ts\nlet a = 1;\n\n  run(a_b);\n```" in run(spark, CODE_KEEPS_LANGUAGE_AND_LINES).markdown_content


TABLE_CELLS_TAKE_THEIR_LABEL = page(
    article(
        f"<article><p>{PROSE}</p><table><thead><tr><th>Harbour</th><th>Herring</th></tr></thead><tbody>"
        '<tr><th>Lerwick</th><td><span aria-label="31% share"><span aria-hidden="true">31%</span></span></td></tr>'
        "</tbody></table></article>"
    )
)


def test_table_cells_take_their_label(spark):
    row = run(spark, TABLE_CELLS_TAKE_THEIR_LABEL)
    assert "| Harbour | Herring |\n| --- | --- |\n| Lerwick | 31% |" in row.markdown_content
    assert "share" not in row.markdown_content


LAZY_AND_LINKED_IMAGES = page(
    article(
        f"<article><p>{PROSE}</p><img src='/blank.png' data-src='/assets/pipe.png' alt='Flow'>"
        "<figure><img src='/_next/image?url=https%3A%2F%2Fc.example%2Fa.png&amp;w=2&amp;q=75'>"
        "<figcaption>The augmented one</figcaption></figure><p><a href='https://boats.test/showimage?"
        "https%3A%2F%2Fimg.boats.test%2Fsloop.jpg'><img src='https://img.boats.test/x/blank.png' "
        "data-src='https://img.boats.test/dinghy.jpg' alt='Shot'></a></p></article>"
    )
)


def test_lazy_and_linked_images(spark):
    md = run(spark, LAZY_AND_LINKED_IMAGES).markdown_content
    assert "![Flow](https://example.com/assets/pipe.png)" in md
    assert (
        "![The augmented one](https://example.com/_next/image?url=https%3A%2F%2Fc.example%2Fa.png&w=2&q=75)"
        in md
    )
    assert "![Shot](https://img.boats.test/sloop.jpg)" in md
    assert "blank.png" not in md and "dinghy.jpg" not in md


POOR = [
    (page(article("")), {"CONTENT_TOO_SHORT", "PARSE_FAILED"}),
    (page(article("<form><p>Please sign in</p><input type=password></form>")), {"JS_REQUIRED"}),
    (page(article("<main><h1>登录后继续访问</h1><form><input type='password'></form></main>")), {"JS_REQUIRED"}),
]


@pytest.mark.parametrize("html, codes", POOR)
def test_poor_pages_are_partial(spark, html, codes):
    row = run(spark, html)
    assert row.extraction_status == "partial" and row.error_code in codes


MALFORMED_MARKUP_IS_REPAIRED_AND_MADE_SAFE = page(
    article(
        f"<article><h1>Broken</h1><p>{PROSE}<p>second <b>bold<ul><li>one<li>two</ul>"
        "<script>alert(1)</script><a href='javascript:alert(2)'>bad link</a></article>",
        title="Other",
    )
)


def test_malformed_markup_is_repaired_and_made_safe(spark):
    md = run(spark, MALFORMED_MARKUP_IS_REPAIRED_AND_MADE_SAFE).markdown_content
    assert "-   " in md and "one" in md and "two" in md and "bad link" in md
    assert "alert" not in md and "javascript" not in md


GONE = page("<p>gone</p>", status=404)


def test_failed_fetch_keeps_the_address(spark):
    row = run(spark, GONE, status=404)
    assert (row.extraction_status, row.error_code, row.title) == ("failed", "HTTP_NOT_FOUND", "example.com")
    assert row.markdown_content == "" and row.content_length == 0


COVERED = page(
    article(f"<article><p>{PROSE}</p></article>", "A [b]", '<meta property="og:image" content="/c.png">')
)


def test_cover_is_put_first_when_the_text_has_no_image(spark):
    md = run(spark, COVERED).markdown_content
    assert md.startswith("![A b](https://example.com/c.png)\n\n")


NESTED_LISTS_AND_QUOTES = page(
    article(
        f"<article><p>{PROSE}</p><blockquote><p>q1</p><p>q2</p></blockquote>"
        "<ol start=3><li>one<ul><li>in <b> x </b>y</li></ul></li><li><p>two</p></li></ol></article>"
    )
)


def test_nested_lists_and_quotes(spark):
    md = run(spark, NESTED_LISTS_AND_QUOTES).markdown_content
    assert "> q1\n>\n> q2\n\n3.  one\n    -   in **x** y\n4.  two" in md


def test_nodes_of_a_page_are_consistent():
    nodes = pages_to_nodes(["<div><p>a<p>b<table><tr><td>1<td>2</table></div>x", None, ""]).to_pylist()
    assert nodes[1] == [] and nodes[2][0]["tag"] == "#document"
    page = nodes[0]
    for n in page:
        assert page[n["seq"]] is n
        assert n["parent"] < n["seq"] <= n["last"] < len(page)
        above = page[n["parent"]] if n["seq"] else n
        assert above["last"] >= n["last"] and above["start"] <= n["start"] <= n["stop"] <= above["stop"]
    assert [n["tag"] for n in page] == [
        "#document", "div", "p", "#text", "p", "#text", "table", "tbody", "tr", "td", "#text", "td", "#text", "#text",
    ]


def test_nesting_has_no_limit():
    nodes = pages_to_nodes(["<div>" * 50_000 + "<b>end</b>" + "</div>" * 50_000]).to_pylist()[0]
    assert [n["parent"] for n in nodes[:50_001]] == list(range(-1, 50_000))
    assert nodes[-1]["text"] == "end" and nodes[-1]["parent"] == 50_001
    assert nodes[0]["last"] == nodes[40_000]["last"] == 50_002 and nodes[0]["stop"] == 3


# --- series -----------------------------------------------------------------------------


def links_of(spark, html, url):
    df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return extract.extract_links(shred_html(df))


def test_only_pages_of_the_series_are_followed(spark):
    html = (
        '<a href="/log/day7.htm">1</a><a href="/log/day7_3.htm">3</a><a href="/log/day7_2.htm">2</a>'
        '<a href="/log/day8_2.htm">下一页</a><a href="https://elsewhere.test/page/2">下一页</a>'
    )
    found = pagination.discover_pages(links_of(spark, html, "https://boats.test/log/day7.htm"))
    got = sorted((r.page_number, r.url) for r in found.collect())
    assert got == [
        (2, "https://boats.test/log/day7_2.htm"),
        (3, "https://boats.test/log/day7_3.htm"),
    ]


def test_footnotes_are_no_pages(spark):
    html = '<a href="#citation-1">1</a><a href="#citation-2">2</a>'
    assert pagination.discover_pages(links_of(spark, html, "https://example.com/article/")).isEmpty()


def test_reach_is_whole_or_limited_and_survives_cycles(spark):
    url = lambda n: "https://s.example/a.html" if n == 1 else f"https://s.example/a_{n}.html"
    edges = [(url(a), url(b), b) for a in range(1, 14) for b in (2, a + 1)]
    df = spark.createDataFrame(edges, "page_url string, url string, page_number long").distinct()
    roots = spark.createDataFrame([(url(1),)], "url string")
    for limit, last in ((None, 14), (10, 10)):
        reached = pagination.follow_pages(roots, df, limit).collect()
        assert sorted(r.page_number for r in reached) == list(range(1, last + 1))


def test_a_limited_walk_holds_no_more_than_the_limit(spark):
    """A ring of pages that all link to the next: with a limit each root takes its ten lowest."""
    url = lambda n: f"https://s.example/a_{n}.html"
    edges = [(url(n), url(n % 30 + 1), n % 30 + 1) for n in range(1, 31)]
    df = spark.createDataFrame(edges, "page_url string, url string, page_number long")
    roots = spark.createDataFrame([(url(n),) for n in (1, 15, 28)], "url string")
    rounds, counted = [], pagination.cap

    def cap(found, *rest):
        rounds.append(found.count())
        return counted(found, *rest)

    pagination.cap = cap
    try:
        reached = pagination.follow_pages(roots, df, 10).collect()
    finally:
        pagination.cap = counted
    got = {}
    for r in reached:
        got.setdefault(r.root_url, []).append(r.page_number)
    assert sorted(got[url(1)]) == list(range(1, 11))
    assert sorted(got[url(15)]) == [1, *range(16, 25)] and sorted(got[url(28)]) == [1, *range(1, 10)]
    assert len(rounds) <= 15 and max(rounds) <= 3 * 11


# --- charts --------------------------------------------------------------------------------


def test_escaped_payload_and_records(spark):
    payload = (
        r'push([1,"3a:{\"title\":\"使用占比\",\"$schema\":\"https://vega.github.io/schema/vega-lite/v6.json\",'
        r'\"datasets\":{\"rows\":[{\"date\":\"2025-08-01\",\"share\":0.4}]},\"data\":{\"name\":\"rows\"},\"mark\":\"line\"}"])'
    )
    df = spark.createDataFrame([(1, payload)], "page_id long, html string")
    specs = charts.extract_chart_specs(df)
    assert [(r.title, r.theme) for r in specs.collect()] == [("使用占比", "blue")]
    rows = charts.chart_rows(specs).select("mark", F.to_json("record").alias("r")).collect()
    assert [(r.mark, r.r) for r in rows] == [("line", '{"date":"2025-08-01","share":0.4}')]


def test_charts_beyond_a_limit_are_counted(spark):
    spec = '{"$schema":"https://vega.github.io/schema/vega-lite/v5.json","data":{"values":[%d]},"mark":"bar"}'
    html = " ".join(spec % i for i in [*range(15), 0])
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    capped = charts.extract_chart_specs(df, 12).collect()
    assert sorted((r.chart, r.left_out) for r in capped) == [(i, 3) for i in range(12)]
    every = charts.extract_chart_specs(df).collect()
    assert sorted((r.chart, r.left_out) for r in every) == [(i, 0) for i in range(15)]


def test_charts_inside_the_row_are_those_of_the_table(spark):
    spec = r'{"title":"T%d","$schema":"https://vega.github.io/schema/vega-lite/v5.json","data":{"values":[%d]},"mark":"bar"}'
    pages = [
        (1, '"theme":"PINK",' + " ".join(spec % (i % 9, i % 9) for i in range(15)) + (spec % (7, 70)).replace('"', r'\"')),
        (2, "no chart here"), (3, '{"$schema":"https://vega.github.io/schema/vega-lite/v5.json"}'), (4, None), (5, ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string")
    for limit in (None, 4):
        wanted = charts.extract_chart_specs(df, limit)
        want = {(r.page_id, r.chart, r.title, r.theme, r.placeholder) for r in wanted.collect()}
        inline = df.select("page_id", F.inline(charts.page_charts(charts.chart_objects(F.col("html")), limit)))
        got = {(r.page_id, r.chart, r.title, r.theme, r.placeholder) for r in inline.collect()}
        assert got == want and len(want) == (limit or 10)


@pytest.mark.parametrize(
    "text, chart, expected",
    [
        ("a\n\nMARK\n\n## b", ("T", "/l.svg", "MARK"), "a\n\n![T](/l.svg)\n\n## b"),
        ("## *T*  x\ntext", ("T x", "/l.svg", None), "## *T*  x\n\n![T x](/l.svg)\ntext"),
        ("T x", ("T x", "/l.svg", None), "T x\n![T x](/l.svg)"),
        ("T grew fast.", ("T", "/l.svg", None), "T grew fast.\n\n## Charts\n\n![T](/l.svg)"),
    ],
)
def test_chart_placement(spark, text, chart, expected):
    schema = "md string, charts array<struct<title:string,local_url:string,placeholder:string>>"
    df = spark.createDataFrame([(text, [chart])], schema)
    assert df.select(charts.place_charts(F.col("md"), F.col("charts"))).first()[0] == expected


FOREIGN = page(article(f"<article><h1> Ç  Ç </h1><p>{PROSE}</p></article>", title=" Ç Ç"))
OTHER_FOREIGN = page(article(f"<article><h1>Ç Ö</h1><p>{PROSE}</p></article>", title="Ç Ç"))


def test_heading_without_ascii_words_that_repeats_the_title(spark):
    for html, kept in ((FOREIGN, False), (OTHER_FOREIGN, True)):
        got = PAGES.row(spark, _KEYS[(html, 200)])
        assert got.plain_text.startswith("Ç") is kept and got.markdown_content.startswith("#") is kept


def test_links_need_few_fields_of_a_node():
    page = '<p>x<a rel=next href="/2">Ne<b>x</b>t</a><table><tr><td><a href=/3>3'
    whole = pages_to_nodes([page, None]).to_pylist()
    few = pages_to_nodes([page, None], LINK_FIELDS).to_pylist()
    assert few == [[{k: n[k] for k in LINK_FIELDS} | {"attrs": n["attrs"]} for n in p] for p in whole]
    assert tuple(few[0][0]) == LINK_FIELDS
