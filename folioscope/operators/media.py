"""Images of stored articles: plan, budget, rewriting, manifests and sizes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import images as I
from folioscope.functions import text as X
from folioscope.operators.query import cap

_CODE = r"```[\s\S]*?```|`[^`\n]*`"
_ALT = r"[^\[\]\\]*+(?:(?:\\.|\[[^\[\]\\]*+\])[^\[\]\\]*+)*+"
_REFERENCE = (
    rf"!\[({_ALT})\]\(\s*(?:<([^<>\n]*)>|([^\s()<>]*+(?:\([^\s()]*\)[^\s()<>]*+)*+))"
    r"""(?:\s+(?:"([^"\\]*+(?:\\.[^"\\]*+)*+)"|'([^'\\]*+(?:\\.[^'\\]*+)*+)'))?\s*\)"""
)
# Code is matched too, so that an image inside code is passed over.
_PIECE = rf"{_CODE}|{_REFERENCE}"
_WEB = "(?i)^https?://"
UNLIMITED = (1 << 63) - 1


def _reference(piece: Column) -> Column:
    group = lambda i: F.regexp_extract(piece, "^" + _REFERENCE + "$", i)
    unescape = lambda c: F.regexp_replace(c, r"\\([\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e])", "$1")
    return F.struct(
        unescape(group(1)).alias("alt"),
        unescape(F.concat(group(2), group(3))).alias("url"),
        unescape(F.concat(group(4), group(5))).alias("title"),
    )


def _pieces(markdown: Column) -> Column:
    return F.regexp_extract_all(markdown, F.lit(_PIECE), F.lit(0))


def image_references(markdown: Column) -> Column:
    """array<struct<alt, url, title>> of the http(s) images of a Markdown text, in order."""
    return F.filter(
        F.transform(_pieces(markdown), _reference),
        lambda r: r["url"].rlike(_WEB),
    )


def localize_references(markdown: Column, local_by_remote: Column) -> Column:
    """Markdown with every image whose URL is a key of the map pointing at its copy."""
    label = lambda c: F.regexp_replace(c, r"([\\\[\]])", r"\\$1")

    def replace(piece: Column) -> Column:
        def render(r: Column) -> Column:
            local = F.try_element_at(local_by_remote, r["url"])
            title = F.when(
                r["title"] != "",
                F.concat(
                    F.lit(' "'), F.regexp_replace(r["title"], r'(["\\])', r"\\$1"), F.lit('"')
                ),
            ).otherwise("")
            return F.when(
                local.isNotNull() & (r["url"] != ""),
                F.concat(F.lit("!["), label(r["alt"]), F.lit("]("), local, title, F.lit(")")),
            ).otherwise(piece)

        return X.let(_reference(piece), render)

    between = F.split(markdown, _PIECE, -1)
    rebuilt = F.transform(
        between,
        lambda part, i: F.concat(
            part, F.coalesce(F.get(F.transform(_pieces(markdown), replace), i), F.lit(""))
        ),
    )
    return F.when(F.cardinality(local_by_remote) > 0, F.array_join(rebuilt, "")).otherwise(markdown)


def distinct_images(bookmarks: DataFrame) -> DataFrame:
    """(bookmark_id, url, position): distinct image addresses, the cover first."""
    cover = F.when(
        F.col("cover_image_url").rlike(_WEB), F.array(F.col("cover_image_url"))
    ).otherwise(F.array().cast("array<string>"))
    body = F.transform(image_references(F.col("markdown_content")), lambda r: r["url"])
    urls = F.array_distinct(F.concat(cover, body))
    # The outer form adds no filter on the array, which would parse the text twice.
    return bookmarks.select(
        F.col("id").alias("bookmark_id"), F.posexplode_outer(urls).alias("position", "url")
    ).where(F.col("url").isNotNull())


def asset_name(url: Column, extension: Column) -> Column:
    return F.concat(X.sha_prefix(url, 24), F.lit("."), extension)


def asset_url(bookmark_id: Column, filename: Column) -> Column:
    return F.concat(F.lit("/api/bookmarks/"), bookmark_id, F.lit("/assets/"), filename)


def checked_downloads(downloads: DataFrame) -> DataFrame:
    """(url, extension, bytes) of the downloads that are images of their declared type.

    downloads: url (unique), body, content_type, error_code. Bodies stay in the scan.
    """
    good = F.col("error_code").isNull() & I.image_body_ok(F.col("body"), F.col("content_type"))
    return downloads.where(good).select(
        "url",
        I.detect_image_type(F.col("body")).alias("extension"),
        F.octet_length("body").cast("bigint").alias("bytes"),
    )


def _budget_fold(items: Column, limit: int) -> Column:
    """Indexes admitted in order while the running total stays within the limit."""
    start = F.struct(
        F.lit(0).cast("bigint").alias("total"),
        F.expr("cast(array() as array<int>)").alias("kept"),
    )

    def step(acc: Column, item: Column) -> Column:
        fits = acc["total"] + item["bytes"] <= limit
        return F.struct(
            F.when(fits, acc["total"] + item["bytes"]).otherwise(acc["total"]).alias("total"),
            F.when(fits, F.concat(acc["kept"], F.array(item["position"])))
            .otherwise(acc["kept"])
            .alias("kept"),
        )

    return F.aggregate(items, start, step)


def byte_budget(images: DataFrame, limit: int) -> DataFrame:
    """images (bookmark_id, position, bytes, …) plus `admitted`.

    A refused image does not count, so a later smaller one may still fit: a fold, not a
    running sum. It runs over all images of a bookmark, two numbers each.
    """
    folded = images.groupBy("bookmark_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "bytes"))).alias("_items")
    )
    kept = folded.select(
        "bookmark_id", F.explode(_budget_fold(F.col("_items"), limit)["kept"]).alias("position")
    ).withColumn("admitted", F.lit(True))
    return images.join(kept, ["bookmark_id", "position"], "left").withColumn(
        "admitted", F.coalesce("admitted", F.lit(False))
    )


def localization_plan(
    bookmarks: DataFrame,
    downloads: DataFrame,
    max_images: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """One row per bookmark with images: local_by_remote, localized, failed, total_bytes.

    The same image may occur in a large share of all bookmarks; the join on its address
    is one that adaptive execution can split. Images beyond the first `max_images` of a
    bookmark, or over its budget of `max_bytes`, stay remote and are counted as failed; by
    default there is no limit.
    """
    distinct = distinct_images(bookmarks)
    counts = distinct.groupBy("bookmark_id").agg(F.count("*").alias("_all"))
    chosen = distinct
    if max_images is not None:
        chosen = cap(distinct, ["bookmark_id"], ["position"], max_images)
    found = chosen.join(checked_downloads(downloads), "url", "left")
    folded = found.groupBy("bookmark_id").agg(
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("bytes").isNotNull(), F.struct("position", "url", "extension", "bytes")
                )
            )
        ).alias("_items")
    )
    budget = _budget_fold(F.col("_items"), UNLIMITED if max_bytes is None else max_bytes)
    done = folded.withColumn("_budget", budget).withColumn(
        "_kept", X.let(F.struct("_items", "_budget.kept"), lambda p: F.filter(
            p["_items"], lambda i: F.array_contains(p["kept"], i["position"])))
    )
    entries = F.transform(
        "_kept",
        lambda i: F.struct(
            i["url"].alias("key"),
            asset_url(F.col("bookmark_id"), asset_name(i["url"], i["extension"])).alias("value"),
        ),
    )
    return done.join(counts, "bookmark_id").select(
        "bookmark_id",
        F.map_from_entries(entries).alias("local_by_remote"),
        F.size("_kept").cast("bigint").alias("localized"),
        (F.col("_all") - F.size("_kept")).cast("bigint").alias("failed"),
        F.col("_budget.total").alias("total_bytes"),
    )


def localize_images(
    bookmarks: DataFrame,
    downloads: DataFrame,
    max_images: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Bookmarks with text and cover pointing at local copies, plus the summary columns."""
    plan = localization_plan(bookmarks, downloads, max_images, max_bytes).withColumnRenamed("bookmark_id", "id")
    empty = F.create_map().cast("map<string,string>")
    joined = bookmarks.join(plan, "id", "left").withColumn(
        "local_by_remote", F.coalesce("local_by_remote", empty)
    )
    zero = F.lit(0).cast("bigint")
    return joined.withColumns(
        {
            "markdown_content": localize_references(
                F.col("markdown_content"), F.col("local_by_remote")
            ),
            "cover_image_url": F.coalesce(
                F.try_element_at("local_by_remote", F.col("cover_image_url")), "cover_image_url"
            ),
            "localized": F.coalesce("localized", zero),
            "failed": F.coalesce("failed", zero),
            "total_bytes": F.coalesce("total_bytes", zero),
        }
    ).withColumn("content_length", X.content_length(F.col("markdown_content")))


def image_summary(bookmarks: DataFrame) -> DataFrame:
    """Distinct local and remote image addresses per bookmark, cover included."""
    md, cover = F.col("markdown_content"), F.coalesce("cover_image_url", F.lit(""))
    local = F.regexp_extract_all(md, F.lit("(?i)" + K.ASSET_URL), F.lit(0))
    mentioned = r"(?i)!\[[^\]]*]\(\s*(?:<(https?://[^>]+)>|(https?://[^)\s]+))"
    remote = F.zip_with(
        F.regexp_extract_all(md, F.lit(mentioned), F.lit(1)),
        F.regexp_extract_all(md, F.lit(mentioned), F.lit(2)),
        lambda bracketed, bare: F.concat(bracketed, bare),
    )
    one = lambda test: F.when(test, F.array(cover)).otherwise(F.array().cast("array<string>"))
    own = cover.startswith("/api/bookmarks/")
    return bookmarks.select(
        F.col("id").alias("bookmark_id"),
        F.size(F.array_union(local, one(own))).cast("bigint").alias("localized"),
        F.size(F.array_union(remote, one(~own & cover.rlike(_WEB)))).cast("bigint").alias("remote"),
    )


# --- files ---------------------------------------------------------------------------


def asset_manifest(files: DataFrame) -> DataFrame:
    """Valid assets of a file listing (path, length): bookmark_id, filename, content_type, bytes.

    files comes from spark.read.format('binaryFile'); the content column is never read.
    """
    parts = F.split("path", "/")
    named = files.select(
        F.element_at(parts, -2).alias("bookmark_id"),
        F.element_at(parts, -1).alias("filename"),
        F.col("length").cast("bigint").alias("bytes"),
    )
    return named.where(
        F.col("filename").rlike(K.ASSET_FILENAME) & F.col("bookmark_id").rlike(K.BOOKMARK_ID)
    ).withColumn("content_type", I.asset_content_type(F.col("filename")))


def assets_to_remove(manifest: DataFrame, removed: DataFrame) -> DataFrame:
    """Assets of bookmarks that a change removed for good (ids, see schema.Change)."""
    return manifest.join(removed.select(F.col("id").alias("bookmark_id")), "bookmark_id", "left_semi")


def storage_usage(files: DataFrame, by: str | None = None) -> DataFrame:
    """Bytes in total, or per value of `by`; files has a `length` column."""
    total = F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("total_bytes")
    return files.groupBy(by).agg(total) if by else files.agg(total)


def readable_assets(
    manifest: DataFrame, bookmarks: DataFrame, now: Column, minutes: int = K.RETENTION_MINUTES
) -> DataFrame:
    """Assets whose bookmark exists and is not deleted for longer than the undo window."""
    limit = now - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    alive = bookmarks.where(F.col("deleted_at").isNull() | (F.col("deleted_at") >= limit)).select(
        F.col("id").alias("bookmark_id")
    )
    valid = manifest.where(F.col("filename").rlike(K.ASSET_FILENAME))
    return valid.join(alive, "bookmark_id", "left_semi")
