"""Reading the archive: filters, search, sorting, paging, tags and cards."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioscope import constants as K
from folioscope.functions import text as X
from folioscope.functions.net import error_message
from folioscope.schema import Archive

SEARCHED = ("title", "url", "final_url", "domain", "markdown_content", "user_note")

# --- filters --------------------------------------------------------------------


def live(df: DataFrame, include_deleted: bool = False) -> DataFrame:
    return df if include_deleted else df.where(F.col("deleted_at").isNull())


def expired(df: DataFrame, now: Column, minutes: int = K.RETENTION_MINUTES) -> DataFrame:
    """Soft-deleted rows whose undo window is over (strictly older)."""
    return df.where(F.col("deleted_at") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES"))


def filter_status(df: DataFrame, status: str | None) -> DataFrame:
    """Values outside the four statuses mean no filter."""
    if status not in K.EXTRACTION_STATUSES:
        return df
    return df.where(F.col("extraction_status") == status)


def text_match(q: str) -> Column:
    test = F.lit(False)
    for name in SEARCHED:
        test = test | F.coalesce(X.contains_ascii_nocase(F.col(name), q), F.lit(False))
    return test


def tagged_with_name(archive: Archive, q: str) -> DataFrame:
    """bookmark_id of links whose tag name contains q; tags are filtered before the join."""
    hits = archive.tags.where(X.contains_ascii_nocase(F.col("name"), q)).select(
        F.col("id").alias("tag_id")
    )
    links = archive.links.select("bookmark_id", "tag_id")
    return links.join(hits, "tag_id", "left_semi")


def search(archive: Archive, q: str | None, df: DataFrame | None = None) -> DataFrame:
    """Rows containing q in a text field or in a tag name (ASCII case ignored).

    The text test runs in the scan and leaves one flag; where the caller wants narrow
    columns, the texts never reach the join with the tagged ids.
    """
    df = archive.bookmarks if df is None else df
    q = (q or "").strip()
    if not q:
        return df
    tagged = (
        tagged_with_name(archive, q)
        .select(F.col("bookmark_id").alias("id"))
        .distinct()
        .withColumn("_tagged", F.lit(True))
    )
    flagged = df.withColumn("_hit", text_match(q)).join(tagged, "id", "left")
    return flagged.where(F.col("_hit") | F.col("_tagged")).drop("_hit", "_tagged")


def filter_tag(archive: Archive, tag_id: str | None, df: DataFrame | None = None) -> DataFrame:
    df = archive.bookmarks if df is None else df
    tag_id = (tag_id or "").strip()
    if not tag_id:
        return df
    ids = archive.links.where(F.col("tag_id") == tag_id).select(F.col("bookmark_id").alias("id"))
    return df.join(ids, "id", "left_semi")


def lookup(df: DataFrame, column: str, keys: DataFrame | list) -> DataFrame:
    """Rows whose `column` is among the keys: a pushed filter for a list, else a semi join."""
    if isinstance(keys, DataFrame):
        return df.join(keys.toDF(column), column, "left_semi")
    return df.where(F.col(column).isin(*keys))


def has_pending(df: DataFrame) -> DataFrame:
    return df.agg(
        F.coalesce(F.bool_or(F.col("extraction_status") == "pending"), F.lit(False)).alias(
            "has_pending"
        )
    )


# --- order and pages --------------------------------------------------------------


def sort_keys(sort: str | None) -> list[Column]:
    """created (default), updated, or title; id breaks ties so pages never overlap."""
    if sort == "title":
        return [X.ascii_lower(F.col("title")).asc(), F.col("id").asc()]
    if sort == "updated":
        return [F.col("updated_at").desc(), F.col("id").asc()]
    return [F.col("created_at").desc(), F.col("id").asc()]


def sort_bookmarks(df: DataFrame, sort: str | None = None) -> DataFrame:
    return df.orderBy(*sort_keys(sort))


def page_bounds(page: int | None, page_size: int | None) -> tuple[int, int]:
    """(offset, size) after clamping."""
    size = min(max(page_size if page_size is not None else K.DEFAULT_PAGE_SIZE, 1), K.MAX_PAGE_SIZE)
    return (max(page or 1, 1) - 1) * size, size


def page(df: DataFrame, number: int | None = None, size: int | None = None, sort=None) -> DataFrame:
    offset, limit = page_bounds(number, size)
    return sort_bookmarks(df, sort).offset(offset).limit(limit)


def next_page(df: DataFrame, after: dict | None, size: int | None = None) -> DataFrame:
    """Keyset form for deep pages (created order): `after` holds the last row seen."""
    if after:
        df = df.where(
            (F.col("created_at") < after["created_at"])
            | ((F.col("created_at") == after["created_at"]) & (F.col("id") > after["id"]))
        )
    return sort_bookmarks(df).limit(page_bounds(1, size)[1])


def matching(archive: Archive, q=None, tag_id=None, status=None) -> DataFrame:
    df = filter_status(live(archive.bookmarks), status)
    return search(archive, q, filter_tag(archive, tag_id, df))


def list_bookmarks(
    archive: Archive, q=None, tag_id=None, status=None, sort=None, number=None, size=None
) -> tuple[DataFrame, DataFrame]:
    """(one page with nested tags, total). The page is chosen on narrow columns.

    At most 100 ids are broadcast back to fetch the wide rows and the links.
    """
    found = matching(archive, q, tag_id, status)
    chosen = page(found, number, size, sort).select("id")
    wide = archive.bookmarks.join(F.broadcast(chosen), "id")
    items = sort_bookmarks(attach_tags(wide, archive, F.broadcast(chosen)), sort)
    return items, found.agg(F.count("*").alias("total"))


def append_page(shown: DataFrame, following: DataFrame) -> DataFrame:
    """The next page without rows already shown."""
    return shown.unionByName(following.join(shown.select("id"), "id", "left_anti"))


# --- tags -------------------------------------------------------------------------


def attach_tags(df: DataFrame, archive: Archive, ids: DataFrame | None = None) -> DataFrame:
    """Add `tags`, an array of (id, name, normalized_name) ordered by id; never null.

    A bookmark has at most 12 tags, so the collected arrays are small. The links of a whole
    archive may be skewed on a popular tag: adaptive execution broadcasts the tags or splits
    that tag's partition by its bytes. The links of a few ids (one page of a list) are few.
    """
    links = archive.links.select("bookmark_id", "tag_id")
    if ids is not None:
        links = links.join(ids.select(F.col("id").alias("bookmark_id")), "bookmark_id", "left_semi")
    tags = archive.tags.select(F.col("id").alias("tag_id"), "name", "normalized_name")
    nested = links.join(tags, "tag_id").groupBy(F.col("bookmark_id").alias("id")).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("tag_id").alias("id"), "name", "normalized_name"))
        ).alias("tags")
    )
    empty = F.expr("cast(array() as array<struct<id:string,name:string,normalized_name:string>>)")
    return df.join(nested, "id", "left").withColumn("tags", F.coalesce("tags", empty))


def tag_usage(archive: Archive) -> DataFrame:
    """tag_id and number of live bookmarks.

    Links are matched to bookmarks on the evenly spread bookmark id, then counted with
    partial aggregation, so a tag on a third of all bookmarks is no hot spot.
    """
    alive = live(archive.bookmarks).select(F.col("id").alias("bookmark_id"))
    return (
        archive.links.select("bookmark_id", "tag_id")
        .join(alive, "bookmark_id", "left_semi")
        .groupBy("tag_id")
        .agg(F.count("*").alias("bookmark_count"))
    )


def list_tags(archive: Archive) -> DataFrame:
    """All tags with their live usage, zeros kept, in display order."""
    usage = tag_usage(archive).withColumnRenamed("tag_id", "id")
    return (
        archive.tags.join(usage, "id", "left")
        .withColumn("bookmark_count", F.coalesce("bookmark_count", F.lit(0).cast("bigint")))
        .orderBy(X.ascii_lower(F.col("name")), "id")
    )


def suggest_tags(archive: Archive, ids: DataFrame, n: int = 6) -> DataFrame:
    """For each bookmark id the first n tags, in list order, that it does not have yet.

    The first n unused tags of a bookmark with m tags are among the first n + m of the list,
    so every row meets as many candidates as the bookmark with the most tags needs.
    """
    wanted = ids.toDF("id")
    used = (
        attach_tags(wanted, archive)
        .withColumn("_used", F.transform("tags", lambda t: F.lower(t["name"])))
        .drop("tags")
    )
    most = used.agg(F.max(F.size("_used"))).first()[0] or 0
    ranked = archive.tags.select(
        "id", "name", X.ascii_lower(F.col("name")).alias("_folded"), F.lower("name").alias("_key")
    )
    head = (
        ranked.orderBy("_folded", "id")
        .limit(n + most)
        .agg(F.array_sort(F.collect_list(F.struct("_folded", "id", "name", "_key"))).alias("_head"))
    )
    used = used.withColumn("_head", head.scalar())
    free = F.filter("_head", lambda t: ~F.array_contains(F.col("_used"), t["_key"]))
    return used.select(
        F.col("id").alias("bookmark_id"),
        F.posexplode(F.slice(free, 1, n)).alias("position", "_tag"),
    ).select(
        "bookmark_id",
        (F.col("position") + 1).cast("bigint").alias("position"),
        F.col("_tag.id").alias("tag_id"),
        F.col("_tag.name").alias("name"),
    )


# --- cards ------------------------------------------------------------------------


def with_card_summary(df: DataFrame, q: str = "") -> DataFrame:
    excerpt = X.matching_excerpt(F.col("user_note"), F.col("plain_text"), F.col("markdown_content"), q)
    return df.withColumn(
        "summary",
        X.summary(excerpt, F.col("description"), F.col("plain_text"), F.col("extraction_status")),
    )


def describe_errors(df: DataFrame) -> DataFrame:
    """Text for the stored error: known code, else the stored message, else a default."""
    return df.withColumn(
        "failure",
        F.coalesce(
            error_message(F.col("error_code")), F.col("error_message"), F.lit(K.DEFAULT_FAILURE_TEXT)
        ),
    )


def cap(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First n rows per key; Spark drops surplus rows before the shuffle (window group limit)."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def overflow(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """How many rows per key lie beyond a cap of n."""
    return df.groupBy(*keys).agg(
        F.greatest(F.count("*") - F.lit(n), F.lit(0)).cast("bigint").alias("overflow")
    )
