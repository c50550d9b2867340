"""Reading and writing the stored tables as Parquet snapshots."""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.schema import BOOKMARK_DEFAULTS, BOOKMARKS, LINKS, TAGS, Archive

POINTER = "CURRENT"


def with_defaults(df: DataFrame) -> DataFrame:
    """All bookmark columns in order, with missing columns and nulls set to defaults."""
    present = set(df.columns)
    columns = []
    for field in BOOKMARKS:
        c = F.col(field.name) if field.name in present else F.lit(None)
        if field.name in BOOKMARK_DEFAULTS:
            c = F.coalesce(c, F.lit(BOOKMARK_DEFAULTS[field.name]))
        columns.append(c.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def _fields(df: DataFrame, schema) -> DataFrame:
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def make_archive(bookmarks: DataFrame, tags: DataFrame, links: DataFrame) -> Archive:
    return Archive(with_defaults(bookmarks), _fields(tags, TAGS), _fields(links, LINKS))


def _pointer_path(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def current_snapshot(spark: SparkSession, root: str) -> str:
    """Folder of the snapshot readers see; `root` itself when there is no pointer."""
    path, fs = _pointer_path(spark, root)
    if not fs.exists(path):
        return root
    row = spark.read.schema("snapshot string").json(f"{root}/{POINTER}").first()
    return f"{root}/{row['snapshot']}"


def read_archive(spark: SparkSession, root: str) -> Archive:
    """The archive with its fixed schema; no inference, so only needed columns are read.

    Defaults are filled in for tables written by others. Snapshots of write_archive() are
    complete, and without the fill-in their filters reach the Parquet scan.
    """
    base = current_snapshot(spark, root)
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{base}/{name}")
    bookmarks = read("bookmarks", BOOKMARKS)
    return Archive(
        with_defaults(bookmarks) if base == root else bookmarks,
        read("tags", TAGS),
        read("links", LINKS),
    )


def write_archive(archive: Archive, root: str) -> str:
    """Write a complete new snapshot, then switch the pointer; readers never see a mix.

    Rows are sorted by their lookup key inside each file, so id filters skip row groups.
    """
    spark = archive.bookmarks.sparkSession
    name = uuid.uuid4().hex
    base = f"{root}/{name}"
    archive.bookmarks.sortWithinPartitions("id").write.parquet(f"{base}/bookmarks")
    archive.tags.write.parquet(f"{base}/tags")
    archive.links.sortWithinPartitions("bookmark_id").write.parquet(f"{base}/links")
    switch_snapshot(spark, root, name)
    return base


def switch_snapshot(spark: SparkSession, root: str, name: str) -> None:
    """Point readers at another snapshot: a new file takes the pointer's place by renaming."""
    path, fs = _pointer_path(spark, root)
    hadoop = spark._jvm.org.apache.hadoop.fs
    draft = hadoop.Path(f"{root}/{POINTER}-{name}")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps({"snapshot": name}).encode()))
    stream.close()
    rename = hadoop.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(draft), fs.makeQualified(path), options)
