"""Articles split over several pages: discovery, following and merging."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import text as X
from folioscope.functions import urls as U
from folioscope.functions.net import error_message
from folioscope.operators.extract import cover_line
from folioscope.operators.query import cap
from folioscope.session import ensure_checkpoint_dir, scratch_dir

_MARKDOWN_LINK = r"(?i)\[[^\]]*]\((https?://[^)\s]+)\)"


def discover_pages(links: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Follow-up pages named by the links of a page: (requested_url, page_url, url, page_number).

    links: page_url, seq, url, text, rel and optionally requested_url (see extract_links).
    Pages numbered above `max_pages` are left out where it is given. The cheap text test
    runs before any URL is taken apart.
    """
    if "requested_url" not in links.columns:
        links = links.withColumn("requested_url", F.col("page_url"))
    numeric = F.col("text").rlike(r"^\d{1,3}$")
    candidates = links.where(numeric | U.is_next_link(F.col("text"), F.col("rel"))).where(
        ~F.col("url").rlike("#.") & (F.col("url") != F.col("page_url"))
    )
    following = F.col("page_number") >= 2
    if max_pages is not None:
        following = F.col("page_number").between(2, max_pages)
    numbered = candidates.withColumns(
        {
            "_series": U.pagination_series_key(F.col("url")),
            "_first_series": U.pagination_series_key(F.col("page_url")),
            "page_number": U.pagination_page_number(
                F.col("url"), F.when(numeric, F.col("text"))
            ),
        }
    ).where((F.col("_series") == F.col("_first_series")) & following)
    found = numbered.groupBy("requested_url", "page_url", "url").agg(
        F.max_by("page_number", "seq").alias("page_number")
    )
    return found.select("requested_url", "page_url", "url", "page_number")


def series_members(pages: DataFrame) -> DataFrame:
    """Each page with its series key and the first URL (lowest number) of that series.

    The first page per series comes from a partial aggregate; giving it back to the
    members is a join that adaptive execution splits where one series holds most pages.
    """
    keyed = pages.select(
        "page_id",
        "url",
        U.pagination_series_key(F.col("url")).alias("series"),
        U.pagination_page_number(F.col("url")).alias("page_number"),
    )
    firsts = keyed.groupBy("series").agg(
        F.min(F.struct(F.coalesce("page_number", F.lit(1)).alias("n"), "url"))["url"].alias(
            "first_url"
        ),
        F.count("*").alias("pages"),
    )
    return keyed.join(firsts, "series")


def follow_pages(roots: DataFrame, edges: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages reachable from each root: (root_url, url, page_number), the root being page 1.

    roots: url, as requested. edges: see discover_pages; a page is left by the links that
    were found when its address was requested, wherever that led. Edges are written once,
    so that the pages they come from are parsed once. Every round is a join on the newest
    pages only and ends in a reliable checkpoint, so the plan stays small and a lost
    executor costs one round. It ends when no new page is found.

    With `max_pages`, a root holds its pages of the lowest numbers (then addresses) found so
    far, and only these are left in the next round: no root ever has more, and the walk ends
    when none of them is new. A page that fell out can't come back, as the others stay lower.
    """
    spark = roots.sparkSession
    ensure_checkpoint_dir(spark)
    asked = "requested_url" if "requested_url" in edges.columns else "page_url"
    edges = edges.select(
        F.col(asked).alias("url"), F.col("url").alias("_next"), "page_number"
    ).checkpoint()
    newest = roots.select(
        F.col("url").alias("root_url"), "url", F.lit(1).cast("bigint").alias("page_number")
    ).distinct()
    reached = newest
    while True:
        found = (
            newest.drop("page_number")
            .join(edges, "url")
            .groupBy("root_url", F.col("_next").alias("url"))
            .agg(F.min("page_number").alias("page_number"))
        )
        new = found.join(reached.select("root_url", "url"), ["root_url", "url"], "left_anti")
        if max_pages is None:
            newest = new.checkpoint()
            reached = reached.unionByName(newest)
        else:
            all_found = reached.withColumn("_new", F.lit(False)).unionByName(
                new.withColumn("_new", F.lit(True))
            )
            lowest = cap(all_found, ["root_url"], ["page_number", "url"], max_pages).checkpoint()
            newest, reached = lowest.where("_new").drop("_new"), lowest.drop("_new")
        if newest.isEmpty():
            return reached


def remove_pagination_blocks(md: Column, first_series: Column) -> Column:
    """Markdown without the blocks that only lead to other pages of the series."""

    def keep(block: Column) -> Column:
        links = F.filter(
            F.regexp_extract_all(block, F.lit(_MARKDOWN_LINK), F.lit(1)),
            lambda u: F.coalesce(U.pagination_series_key(u) == first_series, F.lit(False)),
        )
        rest = F.regexp_replace(
            F.regexp_replace(block, _MARKDOWN_LINK, ""), rf"[*_`#>{X.SPACE[1:-1]}-]", ""
        )
        return X.let(
            F.size(links),
            lambda n: F.when(n >= 2, F.lit(False))
            .when(n == 1, (X.utf16_length(rest) > 20) | ~block.rlike(K.NEXT_BLOCK))
            .otherwise(True),
        )

    return X.normalize_markdown(F.array_join(F.filter(F.split(md, r"\n{2,}"), keep), "\n\n"))


#: Columns of a merged article that are those of its first page.
_OF_FIRST = (
    "final_url",
    "title",
    "domain",
    "description",
    "author",
    "favicon_url",
    "cover_image_url",
    "http_status_code",
)


def merge_pages(parts: DataFrame) -> DataFrame:
    """One extraction row per root from its parts.

    parts: root_url, page_number, url, and the columns of extract(); a part whose
    extraction_status is null or failed counts as a page that could not be fetched. What
    describes the article comes from its first page. A root whose first page failed is
    one failed row; nothing was followed from there.

    An article's pages are gathered into one row, which holds the whole text in any case.
    """
    parts = parts.withColumn("_series", U.pagination_series_key(series_address(parts)))
    usable = F.coalesce(F.col("extraction_status") != "failed", F.lit(False))
    is_first = F.col("page_number") == 1
    # Only the first page shows its cover above the text.
    markdown = F.col("markdown_content")
    if "cover_added" in parts.columns:
        shown = F.coalesce(F.col("cover_added") & ~is_first, F.lit(False))
        markdown = F.when(shown, F.substr(markdown, F.length(cover_line()) + 1)).otherwise(markdown)
    row = F.struct(
        "page_number",
        "url",
        remove_pagination_blocks(markdown, F.col("_series")).alias("body"),
        markdown.alias("markdown"),
        F.col("plain_text").alias("plain"),
        F.col("extraction_status").alias("status"),
        F.col("error_code").alias("code"),
        F.col("error_message").alias("message"),
    )
    kept = [c for c in _OF_FIRST if c in parts.columns]
    root = F.struct(*kept, "extraction_status", "error_code", "error_message")
    grouped = parts.groupBy("root_url").agg(
        F.array_sort(F.collect_list(F.when(usable, row))).alias("_parts"),
        F.first(F.when(is_first, root), ignorenulls=True).alias("_root"),
        F.count_if(~usable & ~is_first).alias("failed_pages"),
        F.max("page_number").alias("_last"),
    )
    lost = F.coalesce(F.col("_root.extraction_status") == "failed", F.lit(True))
    first = F.get("_parts", 0)
    single = F.col("_last") == 1
    merged_md = F.array_join(
        F.transform(
            "_parts",
            lambda p: F.concat(
                F.lit("## 第 "), p["page_number"].cast("string"), F.lit(" 页\n\n"), p["body"]
            ),
        ),
        "\n\n---\n\n",
    )
    plain = F.array_join(
        F.filter(F.transform("_parts", lambda p: p["plain"]), lambda t: t != ""), "\n\n"
    )
    incomplete = (F.col("failed_pages") > 0) | F.exists("_parts", lambda p: p["status"] != "success")
    message = F.concat(
        F.lit("已保存 "),
        F.size("_parts").cast("string"),
        F.lit(" 页，另有 "),
        F.col("failed_pages").cast("string"),
        F.lit(" 页抓取失败"),
    )
    some_failed = F.col("failed_pages") > 0
    code = F.coalesce("_root.error_code", F.lit("UNKNOWN_ERROR"))
    merged = grouped.select(
        "root_url",
        *[F.col("_root")[c].alias(c) for c in kept],
        F.when(lost, 0).otherwise(F.size("_parts")).cast("bigint").alias("pages"),
        F.when(lost, 0).otherwise(F.col("failed_pages")).cast("bigint").alias("failed_pages"),
        F.when(lost, "").when(single, first["markdown"]).otherwise(merged_md).alias("markdown_content"),
        F.when(lost, "").when(single, first["plain"]).otherwise(plain).alias("plain_text"),
        F.when(lost, "failed")
        .when(single, first["status"])
        .when(incomplete, "partial")
        .otherwise("success")
        .alias("extraction_status"),
        F.when(lost, code)
        .when(single | (incomplete & ~some_failed), first["code"])
        .when(some_failed, "PAGINATION_PARTIAL")
        .alias("error_code"),
        F.when(lost, F.coalesce("_root.error_message", error_message(code)))
        .when(single | (incomplete & ~some_failed), first["message"])
        .when(some_failed, message)
        .alias("error_message"),
    )
    for name, other in (("final_url", F.col("root_url")), ("domain", U.url_domain(F.col("root_url")))):
        if name in kept:
            merged = merged.withColumn(name, F.coalesce(name, other))
    if "title" in kept:
        merged = merged.withColumn(
            "title", F.coalesce("title", U.url_domain(F.col("root_url")), "root_url")
        )
    return merged.withColumn("content_length", X.content_length(F.col("markdown_content")))


def series_address(parts: DataFrame) -> Column:
    """The address that names a part's series: the first page's last one, if known."""
    if "series_url" not in parts.columns:
        return F.col("root_url")
    return F.coalesce("series_url", "root_url")


def follow_and_merge(
    roots: DataFrame,
    links: DataFrame | None,
    extractions: DataFrame,
    max_pages: int | None = None,
) -> DataFrame:
    """Merged articles of the given roots (url), one row per root.

    extractions: the columns of extract(), url (unique) being the address as requested. The series
    is that of the address a root ended at. A page whose final address left the series
    counts as failed.

    The extractions are needed for the links, for the addresses roots ended at and for the parts:
    they are written once, so that no page is parsed or rendered again for each of these. Without
    `links` those in the extractions' column `links` are followed (see extract); a page that
    failed has none.
    """
    spark = extractions.sparkSession
    folder = scratch_dir(spark)
    extractions.write.parquet(folder)
    extractions = spark.read.parquet(folder)
    if links is None:
        links = extractions.select(
            F.col("url").alias("requested_url"), F.col("final_url").alias("page_url"), F.inline("links")
        )
        extractions = extractions.drop("links")
    ends = extractions.select("url", F.col("final_url").alias("series_url"))
    named = roots.select("url").distinct().join(ends, "url", "left")
    reached = follow_pages(named, discover_pages(links, max_pages), max_pages)
    parts = reached.join(named.withColumnRenamed("url", "root_url"), "root_url").join(
        extractions, "url", "left"
    )
    left_series = F.col("final_url").isNotNull() & (
        U.pagination_series_key(F.col("final_url"))
        != U.pagination_series_key(series_address(parts))
    )
    status = F.when(left_series & (F.col("page_number") > 1), "failed").otherwise(
        F.col("extraction_status")
    )
    return merge_pages(parts.withColumn("extraction_status", status))
