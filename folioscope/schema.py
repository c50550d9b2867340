"""Schemas of the stored tables and of the intermediate records."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BOOKMARKS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("url", T.StringType()),
        T.StructField("normalized_url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("favicon_url", T.StringType()),
        T.StructField("cover_image_url", T.StringType()),
        T.StructField("markdown_content", T.StringType()),
        T.StructField("plain_text", T.StringType()),
        T.StructField("user_note", T.StringType()),
        T.StructField("extraction_status", T.StringType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("http_status_code", T.IntegerType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("is_content_edited", T.BooleanType()),
        T.StructField("retry_count", T.IntegerType()),
        T.StructField("extracted_at", T.TimestampType()),
        T.StructField("deleted_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

TAGS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("normalized_name", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

LINKS = T.StructType(
    [
        T.StructField("bookmark_id", T.StringType(), False),
        T.StructField("tag_id", T.StringType(), False),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# Values a missing column or a null takes when a table is read or a row is made.
BOOKMARK_DEFAULTS = {
    "markdown_content": "",
    "plain_text": "",
    "user_note": "",
    "extraction_status": "pending",
    "content_length": 0,
    "is_content_edited": False,
    "retry_count": 0,
}

CAPTURES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
    ]
)

# One element per node of a page, in document order; `seq` is also its array index.
# `last` is the seq of the last node below it, `nth` its position among the elements of its
# parent (0 for text). `start` and `stop` are where it begins and ends in the visible non-blank
# characters of the page, `link_start` and `link_stop` the same counting those in links only;
# `links` and `images` count the links and <img> before it. `inside` has the seq of the nearest
# element of each kind around it (-1 for none), `marks` a letter for each list item (l) and
# quote (b) around it.
NODE = T.StructType(
    [
        T.StructField("seq", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("nth", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()),
        T.StructField("link_start", T.IntegerType()),
        T.StructField("link_stop", T.IntegerType()),
        T.StructField("links", T.IntegerType()),
        T.StructField("images", T.IntegerType()),
        T.StructField(
            "inside",
            T.StructType(
                [
                    T.StructField(kind, T.IntegerType())
                    for kind in "figure picture link table svg pre code cell".split()
                ]
            ),
        ),
        T.StructField("marks", T.StringType()),
    ]
)
NODES = T.ArrayType(NODE)


@dataclass(frozen=True)
class Archive:
    """The three stored tables."""

    bookmarks: DataFrame
    tags: DataFrame
    links: DataFrame

    def replace(self, **tables: DataFrame) -> "Archive":
        return Archive(
            tables.get("bookmarks", self.bookmarks),
            tables.get("tags", self.tags),
            tables.get("links", self.links),
        )


@dataclass(frozen=True)
class Change:
    """Result of a batch write: the new archive, what was applied, what was refused.

    `removed` holds the ids of bookmarks that are gone for good, for which stored files
    are to be removed too (see media.assets_to_remove).
    """

    archive: Archive
    applied: DataFrame
    rejects: DataFrame
    removed: DataFrame | None = None
