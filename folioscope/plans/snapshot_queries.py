"""Registered queries: an archive written in buckets, read and changed by bucket."""

from pyspark.sql import functions as F

from folioscope.operators import changes as W
from folioscope.operators import query as Q
from folioscope.plans import archive_queries as A
from folioscope.plans import tables as T
from folioscope.plans.registry import CHECKS, query
from folioscope.session import scratch_dir
from folioscope.sources.snapshot import write_snapshot

BUCKETS = 16


def stored(spark, sf_dir):
    """The archive of the given tables, written in buckets."""
    return write_snapshot(T.archive(spark, sf_dir), scratch_dir(spark), BUCKETS)


@query(CHECKS["keyword_search"])
def keyword_search_in_snapshot(spark, sf_dir):
    return Q.live(stored(spark, sf_dir).search(A.SEARCH)).select("id", "title")


@query(CHECKS["list_page"])
def list_page_of_snapshot(spark, sf_dir):
    items = stored(spark, sf_dir).list_page(
        q=A.COMBINED, tag_id="de", status="success", sort="updated", number=2, size=20
    )
    rank = F.row_number().over(Q.W.orderBy(F.col("updated_at").desc(), "id")).cast("bigint")
    return items.select("id", A.tag_string(), rank.alias("rank"))


# Edits of a few bookmarks, which fall into some of the buckets.
FEW_PATCHES = "SELECT CAST(doc_id AS STRING) AS bookmark_id, CONCAT('Edited ', lang) AS title FROM documents WHERE doc_id % 90 = 2"
_BUCKET = f"('0x' || SUBSTR(MD5({{0}}), 1, 8))::BIGINT % {BUCKETS}"


def _files(snapshot, table, key):
    """(key, file) of every row."""
    rows = snapshot.table(table)
    return rows.select(F.col(key).alias("id"), F.col("_metadata.file_name").alias("file"))


@query(
    T.check(
        "SELECT b.id, CASE WHEN p.title IS NOT NULL AND b.deleted_at IS NULL THEN p.title ELSE b.title END AS title, "
        f"{_BUCKET.format('b.id')} IN (SELECT {_BUCKET.format('bookmark_id')} FROM few_patches) AS rewritten, FALSE AS links_rewritten "
        "FROM bookmarks b LEFT JOIN few_patches p ON p.bookmark_id = b.id",
        few_patches=FEW_PATCHES,
    )
)
def partial_snapshot(spark, sf_dir):
    """The titles after some edits, and whose files were written again."""
    snapshot = stored(spark, sf_dir)
    before = _files(snapshot, "bookmarks", "id").checkpoint()
    links = _files(snapshot, "links", "bookmark_id").distinct().checkpoint()
    patches = T.table(spark, sf_dir, FEW_PATCHES)
    none = F.lit(None).cast("string")
    full = patches.select("*", none.alias("user_note"), none.alias("markdown_content"))
    snapshot.update(patches, lambda a: W.edit(a, full, T.now()), ("bookmarks",))
    after = _files(snapshot, "bookmarks", "id").withColumnRenamed("file", "now")
    linked = _files(snapshot, "links", "bookmark_id").distinct().withColumnRenamed("file", "now")
    moved = links.join(linked, "id").groupBy("id").agg(F.bool_or(F.col("file") != F.col("now")).alias("links_rewritten"))
    titles = snapshot.table("bookmarks").select("id", "title")
    return (
        titles.join(before.join(after, "id"), "id")
        .join(moved, "id", "left")
        .select(
            "id", "title", (F.col("file") != F.col("now")).alias("rewritten"),
            F.coalesce("links_rewritten", F.lit(False)).alias("links_rewritten"),
        )
    )


@query(
    T.check(
        "SELECT b.id, COALESCE(p.title, b.title) AS title FROM bookmarks b LEFT JOIN few_patches p ON p.bookmark_id = b.id "
        "WHERE b.deleted_at IS NULL AND (p.title IS NOT NULL OR CONTAINS(CONCAT_WS(CHR(10), b.title, b.markdown_content, b.user_note, b.url), 'edited'))",
        few_patches=FEW_PATCHES,
    )
)
def search_after_partial_write(spark, sf_dir):
    """The text index follows the rewritten buckets."""
    snapshot = stored(spark, sf_dir)
    patches = T.table(spark, sf_dir, FEW_PATCHES)
    none = F.lit(None).cast("string")
    full = patches.select("*", none.alias("user_note"), none.alias("markdown_content"))
    snapshot.update(patches, lambda a: W.edit(a, full, T.now()), ("bookmarks",))
    return Q.live(snapshot.search("eDITED")).select("id", "title")
