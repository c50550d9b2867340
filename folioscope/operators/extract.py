"""From shredded pages to metadata, links, images, main text, Markdown and a verdict.

All operators read the `nodes` column of `shred_html` and work inside the row: no shuffle,
no second parse. A column used by a lambda is bound once with let(), so that merging
projections can never move its computation into the lambda.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import dom
from folioscope.functions import markdown as M
from folioscope.functions import text as X
from folioscope.functions import urls as U
from folioscope.functions.dom import attr
from folioscope.functions.net import error_message, fetch_outcome
from folioscope.functions.text import let
from folioscope.operators.charts import chart_objects, chart_slots, page_charts, place_charts
from folioscope.operators.shred import shred_html

def sealed(df: DataFrame) -> DataFrame:
    """The same rows and columns, behind a step that later filters are not pushed through.

    A filter on a computed column is otherwise rewritten in terms of the inputs, and the
    whole computation of a page would run once more for each column it looks at.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.inline_outer(F.array(row)))


def _rows(df: DataFrame, keep: list, array: Column, key: str) -> DataFrame:
    """One row per element of a computed array of structs; `key` is never null in it.

    The outer form does not add a filter on the array, which would compute it twice.
    """
    return df.select(*keep, F.inline_outer(array)).where(F.col(key).isNotNull())


# --- metadata -----------------------------------------------------------------------


def page_address(pages: DataFrame) -> Column:
    """The address a page was finally found at: the requested one if no other is known."""
    if "final_url" not in pages.columns:
        return F.col("url")
    return F.coalesce("final_url", "url")


def with_base(pages: DataFrame) -> DataFrame:
    """Add `base`, the parsed page address that links are resolved against."""
    return pages.withColumn("base", U.base_url(page_address(pages)))


def metadata(nodes: Column) -> Column:
    """struct<title, description, author, favicon, cover> with links as written."""

    def read(head: Column) -> Column:
        title = dom.first(dom.with_tag(head["heads"], "title"))
        title_text = F.when(title.isNotNull(), X.js_trim(dom.text_of(head["all"], title)))
        icon = dom.first(
            F.filter(
                head["heads"],
                lambda n: (n["tag"] == "link")
                & F.array_contains(F.split(F.lower(attr(n, "rel")), r"\s+"), "icon"),
            )
        )
        meta = lambda key, value: dom.meta_content(head["heads"], key, value)
        return F.struct(
            F.coalesce(meta("property", "og:title"), meta("name", "twitter:title"), title_text).alias(
                "title"
            ),
            F.coalesce(meta("property", "og:description"), meta("name", "description")).alias(
                "description"
            ),
            F.coalesce(meta("name", "author"), meta("property", "article:author")).alias("author"),
            F.coalesce(attr(icon, "href"), F.lit("/favicon.ico")).alias("favicon"),
            F.coalesce(meta("property", "og:image"), meta("name", "twitter:image")).alias("cover"),
        )

    return let(
        F.struct(nodes.alias("all"), dom.with_tag(nodes, "meta", "title", "link").alias("heads")),
        read,
    )


def with_metadata(pages: DataFrame) -> DataFrame:
    """Add page_title, description, author, favicon_url and cover_image_url."""
    return with_resolved(pages, "metadata")


def extract_metadata(pages: DataFrame) -> DataFrame:
    return with_metadata(pages).select(
        "page_id",
        "url",
        F.col("page_title").alias("title"),
        "description",
        "author",
        "favicon_url",
        "cover_image_url",
    )


# --- links, code, cells ----------------------------------------------------------------


def extract_links(pages: DataFrame) -> DataFrame:
    """One row per anchor with an http(s) target; page_url is the page's final address."""
    staged = with_resolved(pages, "anchors")
    asked = F.col("url").alias("requested_url")
    keep = ["page_id", asked, page_address(pages).alias("page_url")]
    return _rows(staged, keep, anchor_rows(), "seq")


def anchor_rows() -> Column:
    """array<struct<seq, url, text, rel>> of a page with its anchors resolved."""
    zipped = F.transform(
        "anchor_seqs",
        lambda s, i: F.struct(s.alias("seq"), F.get("anchor_urls", i).alias("url")),
    )
    usable = F.filter(zipped, lambda a: a["url"].isNotNull())
    return X.let(
        F.struct("nodes", usable.alias("anchors")),
        lambda p: F.transform(
            p["anchors"],
            lambda a: X.let(
                F.get(p["nodes"], a["seq"]),
                lambda n: F.struct(
                    a["seq"].alias("seq"),
                    a["url"].alias("url"),
                    dom.collapsed_text(p["nodes"], n).alias("text"),
                    attr(n, "rel").alias("rel"),
                ),
            ),
        ),
    )


def extract_code(pages: DataFrame) -> DataFrame:
    """One row per code block: language (null when unknown) and text."""
    nodes = F.col("nodes")
    blocks = F.filter(
        nodes, lambda n: (n["tag"] == "code") & (F.get(nodes, n["parent"])["tag"] == "pre")
    )
    rows = F.transform(
        blocks,
        lambda n: F.struct(
            n["seq"].alias("seq"),
            dom.code_language(n).alias("language"),
            F.regexp_replace(dom.text_of(nodes, n), r"\n$", "").alias("code"),
        ),
    )
    return _rows(pages, ["page_id"], rows, "seq")


def repair_cells(pages: DataFrame) -> DataFrame:
    """Table cells whose accessible label carries the value: (page_id, seq, label)."""
    cells = dom.repaired_cells(F.col("nodes"))
    return _rows(pages, ["page_id"], cells, "seq").select("page_id", "seq", "label")


# --- images ---------------------------------------------------------------------------


def image_sources(nodes: Column) -> Column:
    """array<struct<at, seq, current, link, offers, alt>> with addresses as written.

    `offers` lists the other addresses in order of preference: the lazy-loading attributes,
    the enclosing <picture>, the srcset. Elements with a background image and no <img>
    inside count as images; they come at their end.
    """

    def image(n: Column) -> Column:
        picture = dom.enclosing(nodes, n, "picture")
        offered = F.filter(
            F.flatten(
                F.transform(
                    dom.with_tag(dom.below(nodes, picture), "source"),
                    lambda s: F.array(attr(s, "data-srcset"), attr(s, "srcset")),
                )
            ),
            lambda u: F.coalesce(u, F.lit("")) != "",
        )
        figure = dom.enclosing(nodes, n, "figure")
        caption = dom.first(dom.with_tag(dom.below(nodes, figure), "figcaption"))
        anchor = dom.enclosing(nodes, n, "link")
        return F.struct(
            n["seq"].cast("double").alias("at"),
            n["seq"].alias("seq"),
            attr(n, "src").alias("current"),
            attr(anchor, "href").alias("link"),
            F.array(*[attr(n, a) for a in K.LAZY_IMAGE_ATTRIBUTES]).alias("lazy"),
            F.array(
                F.get(offered, F.size(offered) - 1),
                F.coalesce(
                    X.non_empty(attr(n, "data-srcset")), X.non_empty(attr(n, "srcset"))
                ),
            ).alias("srcsets"),
            F.coalesce(
                F.when(X.js_trim(attr(n, "alt")) != "", attr(n, "alt")),
                X.non_empty(F.when(caption.isNotNull(), dom.collapsed_text(nodes, caption))),
            ).alias("alt"),
        )

    def background(n: Column) -> Column:
        label = F.coalesce(
            X.non_empty(X.js_trim(attr(n, "aria-label"))),
            X.non_empty(X.js_trim(attr(n, "title"))),
            F.lit(K.DEFAULT_BACKGROUND_ALT),
        )
        none = F.lit(None).cast("string")
        return F.struct(
            (n["last"] + F.lit(0.5)).cast("double").alias("at"),
            n["seq"].alias("seq"),
            F.regexp_extract(attr(n, "style"), K.BACKGROUND_IMAGE, 2).alias("current"),
            none.alias("link"),
            F.array_repeat(none, _LAZY).alias("lazy"),
            F.array_repeat(none, 2).alias("srcsets"),
            label.alias("alt"),
        )

    def is_background(n: Column) -> Column:
        styled = F.coalesce(attr(n, "style").rlike(K.BACKGROUND_IMAGE), F.lit(False))
        role = (n["tag"] == "figure") | F.coalesce(attr(n, "role") == "img", F.lit(False))
        return styled & role & ~F.exists(dom.below(nodes, n), lambda x: x["tag"] == "img")

    return F.sort_array(
        F.concat(
            F.transform(dom.with_tag(nodes, "img"), image),
            F.transform(F.filter(nodes, is_background), background),
        )
    )


_LAZY = len(K.LAZY_IMAGE_ATTRIBUTES)


def with_resolved(pages: DataFrame, *parts: str) -> DataFrame:
    """Add the columns of the given parts, which all contain links of the page.

    metadata: page_title, description, author, favicon_url, cover_image_url
    anchors:  anchor_seqs, anchor_urls (arrays of equal length)
    images:   images, array<struct<seq, ordinal, src, alt>>; src is null when no usable
              address was found

    The links of all parts are resolved together, in one flat array.
    """
    nodes = F.col("nodes")
    staged = with_base(pages)
    texts = F.array().cast("array<string>")
    written, sizes = [], []
    if "metadata" in parts:
        staged = staged.withColumn("_meta", metadata(nodes))
        written.append(F.array("_meta.favicon", "_meta.cover"))
        sizes.append(F.lit(2))
    if "anchors" in parts:
        anchors = F.filter(nodes, lambda n: (n["tag"] == "a") & attr(n, "href").isNotNull())
        staged = staged.withColumn(
            "_anchors",
            F.transform(
                anchors, lambda n: F.struct(n["seq"].alias("seq"), attr(n, "href").alias("href"))
            ),
        )
        written.append(F.col("_anchors.href"))
        sizes.append(F.size("_anchors"))
    if "images" in parts:
        staged = staged.withColumn("_raw", image_sources(nodes))
        staged = staged.withColumn(
            "_sets", F.transform(F.flatten(F.col("_raw.srcsets")), U.best_srcset)
        )
        lazy = F.flatten(F.col("_raw.lazy"))
        written += [F.col("_raw.current"), F.col("_raw.link"), lazy, F.col("_sets")]
        n = F.size("_raw")
        sizes += [n, n, n * _LAZY, n * 2]
    staged = staged.withColumn("_written", F.concat(texts, *written))
    staged = staged.withColumn(
        "_all", F.transform("_written", lambda h: U.resolve_link(h, F.col("base")))
    )
    slices, start = [], F.lit(1)
    for size in sizes:
        slices.append(F.slice("_all", start, size))
        start = start + size
    added = {}
    if "metadata" in parts:
        added["page_title"] = F.col("_meta.title")
        added["description"] = F.col("_meta.description")
        added["author"] = F.col("_meta.author")
        added["favicon_url"], added["cover_image_url"] = F.get("_all", 0), F.get("_all", 1)
        slices = slices[1:]
    if "anchors" in parts:
        added["anchor_seqs"], added["anchor_urls"] = F.col("_anchors.seq"), slices[0]
        slices = slices[1:]
    if "images" in parts:
        for name, part in zip(("_current", "_link", "_lazy", "_offered"), slices):
            added[name] = part
    staged = staged.withColumns(added)
    if "images" in parts:
        staged = _choose_images(staged)
    return staged.drop("_meta", "_anchors", "_raw", "_sets", "_written", "_all")


def _choose_images(staged: DataFrame) -> DataFrame:
    """Pick the address of each image: linked original, own, lazy, picture, srcset."""
    staged = staged.withColumn("_original", F.transform("_link", U.original_from_viewer))

    def choose(p: Column) -> Column:
        def one(r: Column, k: Column) -> Column:
            usable = lambda name, width: F.get(
                F.filter(F.slice(p[name], k * width + 1, width), lambda u: u.isNotNull()), 0
            )
            current = F.get(p["current"], k)
            return F.struct(
                r["seq"].alias("seq"),
                (k + 1).alias("ordinal"),
                F.coalesce(
                    F.get(p["original"], k),
                    F.when(~U.resolved_is_placeholder(current), current),
                    usable("lazy", _LAZY),
                    usable("offered", 2),
                ).alias("src"),
                F.coalesce(
                    r["alt"], F.concat(F.lit(K.DEFAULT_IMAGE_ALT), (k + 1).cast("string"))
                ).alias("alt"),
            )

        return F.transform(p["raw"], one)

    names = ("raw", "current", "original", "lazy", "offered")
    page = F.struct(*[F.col(f"_{n}").alias(n) for n in names])
    return staged.withColumn("images", X.let(page, choose)).drop(
        "_current", "_link", "_lazy", "_offered", "_original"
    )


def extract_images(pages: DataFrame) -> DataFrame:
    """One row per image of a page; src is null when no usable address was found."""
    found = _rows(with_resolved(pages, "images"), ["page_id"], F.col("images"), "seq")
    return found.select("page_id", F.col("ordinal").cast("bigint").alias("ordinal"), "src", "alt")


# --- main content -----------------------------------------------------------------------


def with_main_content(pages: DataFrame) -> DataFrame:
    """Add main (seq or null), root, kept (array of nodes), repaired, plain_text, paragraphs.

    Without a main block the whole body is kept, minus what is never content.
    """
    nodes = F.col("nodes")
    staged = pages.withColumn("main", dom.main_block(nodes))
    body = dom.first(dom.with_tag(nodes, "body"))["seq"]
    staged = staged.withColumn("root", F.coalesce("main", body, F.lit(0)))
    staged = staged.withColumn("repaired", dom.repaired_cells(nodes))
    repeated = dom.first(
        F.filter(
            F.slice(nodes, F.col("root") + 1, F.get(nodes, F.col("root"))["last"] - F.col("root") + 1),
            lambda n: n["tag"].isin("h1", "h2")
            & dom.heading_repeats_title(dom.collapsed_text(nodes, n), F.col("page_title")),
        )
    )
    dropped = F.filter(
        nodes,
        lambda n: (n["seq"] > F.col("root"))
        & (dom.is_forbidden(n) | (F.col("main").isNotNull() & dom.is_boilerplate(n))),
    )
    whole = lambda first, last: F.struct(first.alias("first"), (last + 1).alias("past"))
    staged = staged.withColumn(
        "_gone",
        F.concat(
            F.transform(dropped, lambda n: whole(n["seq"], n["last"])),
            # Of a repaired cell the cell itself stays.
            F.transform("repaired", lambda r: whole(r["seq"] + 1, r["last"])),
            F.when(
                F.col("main").isNotNull() & repeated["seq"].isNotNull(),
                F.array(whole(repeated["seq"], repeated["last"])),
            ).otherwise(F.expr("cast(array() as array<struct<first:int,past:int>>)")),
        ),
    )
    staged = staged.withColumn(
        "kept",
        let(
            F.struct("nodes", "root", F.col("_gone").alias("gone")),
            lambda p: dom.outside(p["nodes"], p["root"], p["gone"]),
        ),
    )

    def texts(p: Column) -> Column:
        label = lambda n: F.when(
            n["tag"].isin("td", "th"), dom.cell_label(p["nodes"], n)
        )
        return F.array_join(
            F.transform(p["kept"], lambda n: F.coalesce(n["text"], label(n), F.lit(""))), ""
        )

    return staged.withColumns(
        {
            "plain_text": X.collapse_space(let(F.struct("nodes", "kept"), texts)),
            "paragraphs": F.size(
                F.filter("kept", lambda n: (n["tag"] == "p") & (dom.chars(n) > 0))
            ),
        }
    ).drop("_gone")


def main_content(captures: DataFrame) -> DataFrame:
    """(page_id, url, has_main, plain_text, paragraphs) of raw captures."""
    pages = shred_html(captures.select("page_id", "url", "html"))
    titled = pages.withColumn("page_title", metadata(F.col("nodes"))["title"])
    return sealed(
        with_main_content(titled).select(
            "page_id", "url", F.col("main").isNotNull().alias("has_main"), "plain_text", "paragraphs"
        )
    )


def with_markdown(pages: DataFrame) -> DataFrame:
    """Add `markdown` to pages with anchors, images and main content.

    Pages with a column `charts` (see charts.page_charts) get the mark of the nth chart where
    the nth empty box waits for one.
    """
    slots, marks = F.array().cast("array<int>"), F.array().cast("array<string>")
    if "charts" in pages.columns:
        slots = F.slice(chart_slots(F.col("nodes")), 1, F.coalesce(F.size("charts"), F.lit(0)))
        marks = F.transform("charts", lambda c: c["placeholder"])
    pages = pages.withColumn("_slots", F.coalesce(slots, F.array().cast("array<int>")))

    def visible(p: Column) -> Column:
        # Blank elements give no output, except those that hold an image, rule or code.
        media = F.transform(
            F.filter(p["kept"], lambda n: n["tag"].isin("img", "hr", "br")), lambda n: n["seq"]
        )
        extra = F.concat(media, F.transform(p["images"], lambda i: i["seq"]), p["slots"])
        return let(
            extra,
            lambda e: F.filter(
                p["kept"],
                lambda n: (dom.chars(n) > 0)
                | n["text"].isNotNull()
                | n["tag"].isin("td", "th", "tr", "hr", "br")
                | F.exists(e, lambda s: (s >= n["seq"]) & (s <= n["last"])),
            ),
        )

    waiting = F.struct("kept", "images", F.col("_slots").alias("slots"))
    staged = pages.withColumn("kept", let(waiting, visible))
    page = F.struct(
        "nodes", "kept", "root", "images", "anchor_urls",
        F.col("_slots").alias("slots"), F.coalesce(marks, F.array().cast("array<string>")).alias("marks"),
    )
    staged = staged.withColumn("_contexts", M.node_contexts(page))
    return staged.withColumn("markdown", M.document(F.col("_contexts"))).drop("_contexts", "_slots")


# --- full extraction ------------------------------------------------------------------------


def cover_line() -> Column:
    """The Markdown of a cover that is put before the text."""
    alt = F.regexp_replace("title", r"[\[\]]", "")
    return F.concat(F.lit("!["), alt, F.lit("]("), F.col("cover_image_url"), F.lit(")\n\n"))


def extract(
    captures: DataFrame,
    max_bytes: int | None = None,
    chart_url: Callable[[Column], Column] | None = None,
    max_charts: int | None = None,
    links: bool = False,
) -> DataFrame:
    """One extraction row per capture: page_id, url, html, status_code, content_type.

    A capture that was redirected names its last address in `final_url`; all addresses of
    the page are resolved from there. `cover_added` says whether the cover was put first.
    The whole chain is narrow. Failed captures, and those over `max_bytes` where it is given,
    are judged before parsing.

    With `chart_url`, which gives the address of a drawn chart (see charts.page_charts), the
    embedded charts, or the first `max_charts` of a page, are put into the Markdown: into the
    boxes that wait for them, below their titles, or at the end. They come back in `charts`;
    the plain text does not change.

    With `links` the page's links come along in a column of that name (see extract_links).
    """
    size = F.octet_length("html")
    outcome = fetch_outcome(
        F.col("status_code"), F.col("content_type"), size, F.lit(0), F.lit(None).cast("string"),
        F.lit(False), max_bytes,
    )
    judged = captures.select(
        "page_id",
        "url",
        page_address(captures).alias("final_url"),
        "status_code",
        outcome.alias("fetch_error"),
        F.when(outcome.isNull(), F.col("html")).alias("html"),
    )
    if chart_url is not None:
        judged = judged.withColumn("_objects", chart_objects(F.col("html")))
    pages = shred_html(judged)
    if chart_url is not None:
        pages = pages.withColumn("charts", page_charts(F.col("_objects"), max_charts))
    nodes = F.col("nodes")
    resolved = with_resolved(pages, "metadata", "anchors", "images")
    rendered = with_markdown(with_main_content(resolved))
    has_password = F.exists(
        nodes,
        lambda n: (n["tag"] == "input") & F.coalesce(F.lower(attr(n, "type")) == "password", F.lit(False)),
    )
    quality = X.content_quality(
        F.col("plain_text"), F.col("paragraphs"), F.col("main").isNull() & has_password
    )
    first_paragraph = dom.first(
        F.filter("kept", lambda n: (n["tag"] == "p") & (dom.chars(n) > 0))
    )
    heading = dom.first(dom.with_tag(nodes, "h1"))
    domain = U.url_domain(F.col("final_url"))
    judged = rendered.select(
        "page_id",
        "url",
        "final_url",
        "status_code",
        "fetch_error",
        "page_title",
        "description",
        "author",
        "favicon_url",
        "cover_image_url",
        domain.alias("domain"),
        quality.alias("quality"),
        F.col("main").isNotNull().alias("has_main"),
        "plain_text",
        "markdown",
        *(["charts"] if chart_url is not None else []),
        *([anchor_rows().alias("links")] if links else []),
        X.non_empty(dom.collapsed_text(nodes, heading)).alias("heading"),
        X.non_empty(dom.collapsed_text(nodes, first_paragraph)).alias("excerpt"),
    )
    failed = F.col("fetch_error").isNotNull()
    title = F.when(failed, F.coalesce("domain", "final_url")).otherwise(
        F.coalesce("page_title", "heading", "domain")
    )
    shown = judged.withColumn("title", title)
    if chart_url is not None:
        drawn = F.transform(
            "charts",
            lambda c: F.struct(
                c["title"].alias("title"), chart_url(c).alias("local_url"), c["placeholder"].alias("placeholder")
            ),
        )
        shown = shown.withColumn("markdown", place_charts(F.col("markdown"), drawn))
    no_image = ~F.col("markdown").rlike(r"(?i)!\[[^\]]*]\(https?://")
    covered = F.col("cover_image_url").isNotNull() & no_image
    with_cover = F.when(covered, F.concat(cover_line(), F.col("markdown"))).otherwise(
        F.col("markdown")
    )
    shown = shown.withColumn(
        "markdown_content", F.when(failed, F.lit("")).otherwise(X.js_trim(with_cover))
    )
    code = F.coalesce(
        "fetch_error", "quality", F.when(~F.col("has_main"), F.lit("PARSE_FAILED"))
    )
    message = (
        F.when(failed | (F.col("quality") == "JS_REQUIRED"), error_message(code))
        .when(~F.col("has_main"), K.NO_MAIN_BLOCK_TEXT)
        .when(F.col("quality").isNotNull(), K.SHORT_CONTENT_TEXT)
    )
    result = shown.select(
        "page_id",
        "url",
        "final_url",
        "title",
        F.when(~failed, F.coalesce("description", F.when(F.col("has_main"), F.col("excerpt")))).alias(
            "description"
        ),
        F.when(~failed, F.col("author")).alias("author"),
        "domain",
        F.when(~failed, F.col("favicon_url")).alias("favicon_url"),
        F.when(~failed, F.col("cover_image_url")).alias("cover_image_url"),
        "markdown_content",
        F.when(failed, F.lit("")).otherwise(F.col("plain_text")).alias("plain_text"),
        X.content_length(F.col("markdown_content")).alias("content_length"),
        F.when(failed, "failed").when(code.isNotNull(), "partial").otherwise("success").alias(
            "extraction_status"
        ),
        code.alias("error_code"),
        message.alias("error_message"),
        F.col("status_code").alias("http_status_code"),
        (~failed & covered).alias("cover_added"),
        *(["charts"] if chart_url is not None else []),
        *(["links"] if links else []),
    )
    return sealed(result)


# --- audit ------------------------------------------------------------------------------------


def audit_markup(pages: DataFrame) -> DataFrame:
    """Unsafe markup per page: scripts, event attributes, script links, outside SVG links."""
    nodes = F.col("nodes")
    keys = lambda n: F.map_keys(n["attrs"])
    count = lambda test: F.size(F.filter(nodes, test)).cast("bigint")
    is_script_url = lambda v: F.coalesce(
        F.regexp_replace(v, r"[\x00-\x20]", "").rlike(r"(?i)^(?:javascript|vbscript|data:text/html)"),
        F.lit(False),
    )
    inside_svg = lambda n: (n["tag"] == "svg") | (n["inside"]["svg"] >= 0)
    outside = lambda n: F.coalesce(
        ~F.coalesce(attr(n, "href"), attr(n, "xlink:href")).startswith("#"), F.lit(False)
    )
    handlers = F.aggregate(
        nodes,
        F.lit(0).cast("bigint"),
        lambda acc, n: acc
        + F.size(F.filter(keys(n), lambda k: k.startswith("on"))).cast("bigint"),
    )
    return pages.select(
        "page_id",
        count(lambda n: n["tag"] == "script").alias("scripts"),
        handlers.alias("event_attributes"),
        count(lambda n: is_script_url(attr(n, "href")) | is_script_url(attr(n, "src"))).alias(
            "script_links"
        ),
        count(lambda n: outside(n) & inside_svg(n)).alias("svg_outside_links"),
    )
