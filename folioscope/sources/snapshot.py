"""The stored tables in buckets of ids: small writes, reads that skip files, a text index.

Each table is a Parquet folder partitioned by `bucket`, a hash of the bookmark id (of the tag
id for tags), and sorted by id inside with a bloom filter on it. A change reads and rewrites
only the buckets that hold its ids, by dynamic partition overwrite; other files stay as they are.
`grams` lists, for each three-character piece, bookmarks whose texts have it, so that a search
reads only texts that can match.

The rows of a bucket are dealt to tasks and files by their bytes, so a task's share does not
grow with the table. The index is made of the stored rows, where they lie, without a shuffle.

A rewrite stands complete beside the old files before any of them goes; its buckets then take
their places, table after table. Readers that must never see a mix use archive.write_archive(),
which switches whole snapshots. The new files are made some buckets at a time and shuffle files
go after each write, so that no more than the old and the new files and a part of the rows lie
on disk at once.
"""

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import query as Q
from folioscope.schema import BOOKMARKS, LINKS, TAGS, Archive, Change
from folioscope.session import ensure_checkpoint_dir, freed_shuffles

TABLES = {"bookmarks": (BOOKMARKS, "id"), "links": (LINKS, "bookmark_id"), "tags": (TAGS, "id")}
#: A piece is a number: three code points of 21 bits each, the first one highest.
GRAMS = "gram bigint, ids array<string>, bucket int"
GRAM = 3
BITS = 21
#: Stands behind the end of a text, so that every character begins a piece.
PAD = "\x00"
#: So many pairs of a piece and a bookmark, or a few more, are held at a time.
HELD = 2_000_000
LAYOUT = {
    "compression": "zstd",
    "parquet.block.size": str(8 << 20),
    "parquet.page.row.count.limit": "2000",
    # As many bits as the ids of a row group need, and not a megabyte for each.
    "parquet.bloom.filter.adaptive.enabled": "true",
}
#: Bookmarks, and links that change, are dealt to their buckets in up to so many parts.
PARTS = 8
#: Up to so many ids are looked up by a filter in the scan, more by a join.
FEW = 1000


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of an id: the first 32 bits of its MD5, modulo the count of buckets."""
    number = F.conv(F.substring(F.md5(F.coalesce(key, F.lit(""))), 1, 8), 16, 10)
    return (number.cast("bigint") % buckets).cast("int")


def gram_number(piece: str) -> int:
    """The number of a piece; of a shorter text, that of the first piece beginning with it."""
    first, second, third = (ord(c) for c in piece.ljust(GRAM, PAD))
    return (first << 2 * BITS) | (second << BITS) | third


def grams_of(texts: list[str | None]) -> np.ndarray:
    """The distinct three-character pieces of some texts, A-Z lower-cased, in order."""
    joined = "".join((t or "").replace(PAD, " ") + PAD * (GRAM - 1) for t in texts)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    chars[(chars >= ord("A")) & (chars <= ord("Z"))] += ord("a") - ord("A")
    pieces = (chars[:-2] << 2 * BITS) | (chars[1:-1] << BITS) | chars[2:]
    return np.unique(pieces[chars[:-2] != ord(PAD)])


def gram_rows(bookmarks: DataFrame) -> DataFrame:
    """(gram, ids, bucket): bookmarks that have a piece in their searched texts, each once.

    A piece has a row for each bucket and each run of bookmarks that make HELD pairs.
    """

    def listed(found: list[np.ndarray], ids: list[str], bucket: int) -> pa.RecordBatch:
        grams = np.concatenate(found)
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), [len(g) for g in found])
        order = np.argsort(grams, kind="stable")
        grams, first = np.unique(grams[order], return_index=True)
        offsets = pa.array(np.append(first, len(order)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(grams, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(ids, pa.string()).take(pa.array(owner[order]))),
                pa.array(np.full(len(grams), bucket, dtype=np.int32)),
            ],
            names=["gram", "ids", "bucket"],
        )

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            columns = [batch.column(c) for c in Q.SEARCHED]
            for row, (key, bucket) in enumerate(zip(batch.column("id"), batch.column("bucket"))):
                grams = grams_of([c[row].as_py() for c in columns])
                found, ids, pairs = held.setdefault(bucket.as_py(), ([], [], []))
                found.append(grams)
                ids.append(key.as_py())
                pairs.append(len(grams))
            if sum(sum(pairs) for _, _, pairs in held.values()) >= HELD:
                for bucket, (found, ids, _) in held.items():
                    yield listed(found, ids, bucket)
                held = {}
        for bucket, (found, ids, _) in held.items():
            yield listed(found, ids, bucket)

    return bookmarks.select("id", "bucket", *Q.SEARCHED).mapInArrow(indexed, GRAMS)


@dataclass(frozen=True)
class Snapshot:
    """Tables below `root`, in `buckets` buckets each."""

    spark: SparkSession
    root: str
    buckets: int

    def table(self, name: str, wanted: list[int] | None = None) -> DataFrame:
        """A table with its column `bucket`, or only some buckets of it."""
        schema, key = TABLES[name]
        rows = self.spark.read.schema(_ddl(schema) + ", bucket int").parquet(f"{self.root}/{name}")
        rows = rows if wanted is None else rows.where(F.col("bucket").isin(*wanted))
        return rows.where(F.col(key).isNotNull())

    def archive(self, wanted: list[int] | None = None) -> Archive:
        """The stored archive; with `wanted`, bookmarks and links of these buckets only."""
        return Archive(
            self.table("bookmarks", wanted).drop("bucket"),
            self.table("tags").drop("bucket"),
            self.table("links", wanted).drop("bucket"),
        )

    def buckets_of(self, ids: DataFrame) -> list[int]:
        """Numbers of the buckets that hold ids (first column); at most all of them."""
        found = ids.select(bucket_of(F.col(ids.columns[0]), self.buckets).alias("bucket"))
        return sorted(r.bucket for r in found.distinct().collect())

    def lookup(self, ids: list[str]) -> DataFrame:
        """The bookmarks of a few ids: other buckets, row groups and pages are skipped."""
        keys = self.spark.createDataFrame([(i,) for i in ids], "id string")
        return self.table("bookmarks", self.buckets_of(keys)).where(F.col("id").isin(*ids))

    def candidates(self, q: str) -> DataFrame:
        """Ids of the bookmarks that have all pieces of `q` in their texts."""
        rows = self.spark.read.schema(GRAMS).parquet(f"{self.root}/grams")
        q = q.translate(str.maketrans(X.ASCII_UPPER, X.ASCII_LOWER)).replace(PAD, " ")
        pieces = sorted({gram_number(q[i : i + GRAM]) for i in range(len(q) - GRAM + 1)})
        id_ = F.explode("ids").alias("id")
        if not pieces:
            past = gram_number(q) + (1 << BITS * (GRAM - len(q)))
            return rows.where(F.col("gram").between(gram_number(q), past - 1)).select(id_).distinct()
        listed = rows.where(F.col("gram").isin(*pieces)).select(id_)
        found = listed.groupBy("id").agg(F.count("*").alias("n"))
        # More, if ids repeat; the texts are looked through afterwards.
        return found.where(F.col("n") >= len(pieces)).select("id")

    def search(self, q: str) -> DataFrame:
        """Rows containing q in a text field or in a tag name, as query.search() finds them.

        Texts are read where all pieces of q occur, and then looked through; bookmarks with a
        matching tag are read by id. What is looked up by ids in the scan is bounded by FEW.
        """
        q = q.strip()
        archive = self.archive()
        if not q:
            return archive.bookmarks
        tagged = Q.tagged_with_name(archive, q).select(F.col("bookmark_id").alias("id"))
        by_text = self.candidates(q).withColumn("tagged", F.lit(False))
        by_tag = tagged.distinct().withColumn("tagged", F.lit(True))
        ids = by_text.unionByName(by_tag).groupBy("id").agg(F.bool_or("tagged").alias("tagged"))
        few = ids.limit(FEW + 1).collect()
        if len(few) <= FEW:
            if not few:
                return archive.bookmarks.limit(0)
            sure = [r.id for r in few if r.tagged]
            hit = Q.text_match(q) | (F.col("id").isin(*sure) if sure else F.lit(False))
            return self.lookup([r.id for r in few]).where(hit).drop("bucket")
        rows = archive.bookmarks.join(ids, "id")
        return rows.where(F.col("tagged") | Q.text_match(q)).drop("tagged")

    def list_page(
        self, q=None, tag_id=None, status=None, sort=None, number=None, size=None
    ) -> DataFrame:
        """One page with nested tags, as query.list_bookmarks() gives it.

        The page is chosen on narrow columns; its ids, at most K.MAX_PAGE_SIZE, then go into
        the scans of the wide rows and of the links.
        """
        archive = self.archive()
        found = Q.matching(archive, q, tag_id, status)
        ids = [r.id for r in Q.page(found, number, size, sort).select("id").collect()]
        if not ids:
            return Q.attach_tags(archive.bookmarks.limit(0), archive)
        wanted = self.buckets_of(self.spark.createDataFrame([(i,) for i in ids], "id string"))
        links = self.table("links", wanted).where(F.col("bookmark_id").isin(*ids)).drop("bucket")
        wide = self.table("bookmarks", wanted).where(F.col("id").isin(*ids)).drop("bucket")
        return Q.sort_bookmarks(Q.attach_tags(wide, archive.replace(links=links)), sort)

    def update(
        self, ids: DataFrame, change: Callable[[Archive], Change], tables: tuple[str, ...]
    ) -> Change:
        """Apply a change of the bookmarks `ids` (first column) and rewrite what it touches.

        `change` sees the bookmarks and links of the buckets that hold the ids, and all tags;
        these buckets of the named tables are written again, all others keep their files. All
        new files are written, beside the tables, before any file goes; for that the rows of
        the change are computed once for each of up to PARTS parts of the buckets. The archive
        that is returned reads the stored files.
        """
        ensure_checkpoint_dir(self.spark)
        wanted = self.buckets_of(ids)
        result = change(self.archive(wanted))
        with freed_shuffles(self.spark):
            held = lambda rows: rows.select("*").checkpoint()
            applied, rejects = held(result.applied), held(result.rejects)
            removed = None if result.removed is None else held(result.removed)
            after = {"tags": held(result.archive.tags)} if "tags" in tables else {}
            if wanted:
                draft = self._draft()
                try:
                    for name in tables:
                        rows = after.get(name, getattr(result.archive, name))
                        self._write(name, rows, wanted, wanted if name != "tags" else None, draft)
                except BaseException:
                    self._delete(draft)
                    raise
                # If this breaks off, the draft may hold the only copy of a bucket, and stays.
                for name in tables:
                    self._replace(name, draft)
                self._delete(draft)
                if "bookmarks" in tables:
                    self._write_grams(wanted)
        stored = self.archive(wanted)
        after |= {name: getattr(stored, name) for name in tables if name not in after}
        return Change(result.archive.replace(**after), applied, rejects, removed)

    def _write(
        self,
        name: str,
        rows: DataFrame,
        wanted: list[int] | None = None,
        parts: list[int] | None = None,
        root: str | None = None,
    ) -> None:
        """Write rows, of `wanted` buckets or of all, below `root`; `parts` as in _dealt()."""
        schema, key = TABLES[name]
        if "bucket" not in rows.columns:
            rows = rows.withColumn("bucket", bucket_of(F.col(key), self.buckets))
        if wanted is not None and name != "tags":
            # A bucket that lost its last row is written with one that has no id.
            empty = self.spark.createDataFrame([(b,) for b in wanted], "bucket int")
            empty = empty.select(
                *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema), "bucket"
            )
            rows = rows.unionByName(empty)
        for part in _dealt(rows, parts or []):
            self._put(
                # Each bucket goes to its own tasks, as many as its bytes need.
                part.hint("rebalance", F.col("bucket")),
                name, key, root, **{f"parquet.bloom.filter.enabled#{key}": "true"},
            )

    def _drafted(self, rows: DataFrame, draft: str) -> DataFrame:
        """Bookmarks with their bucket, computed once; each file has the rows of a bucket together."""
        bucketed = rows.withColumn("bucket", bucket_of(F.col("id"), self.buckets))
        bucketed.sortWithinPartitions("bucket").write.options(**LAYOUT).parquet(draft)
        return self.spark.read.schema(_ddl(BOOKMARKS) + ", bucket int").parquet(draft)

    def _write_grams(self, wanted: list[int] | None = None) -> None:
        rows = gram_rows(self.table("bookmarks", wanted))
        if wanted is not None:
            empty = self.spark.createDataFrame([(b,) for b in wanted], "bucket int")
            none = (F.lit(None).cast("bigint").alias("gram"), F.lit(None).cast("array<string>").alias("ids"))
            rows = rows.unionByName(empty.select(*none, "bucket"))
        self._put(rows, "grams", "gram")

    def _put(
        self, rows: DataFrame, name: str, key: str, root: str | None = None, **options: str
    ) -> None:
        (
            rows.sortWithinPartitions("bucket", key)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .options(**LAYOUT, **options)
            .partitionBy("bucket")
            .parquet(f"{root or self.root}/{name}")
        )

    def _draft(self) -> str:
        """A new folder beside the tables."""
        return f"{self.root}/_draft/{uuid.uuid4().hex}"

    def _delete(self, folder: str) -> None:
        path, fs = self._files(folder)
        fs.delete(path, True)

    def _files(self, folder: str):
        """(path, its file system) of a folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _replace(self, name: str, draft: str) -> None:
        """Put the buckets of a table below `draft` in the place of those with their numbers."""
        made, fs = self._files(f"{draft}/{name}")
        for bucket in fs.listStatus(made) if fs.exists(made) else ():
            if bucket.isDirectory():
                place, _ = self._files(f"{self.root}/{name}/{bucket.getPath().getName()}")
                fs.delete(place, True)
                fs.mkdirs(place.getParent())
                if not fs.rename(bucket.getPath(), place):
                    raise OSError(f"{bucket.getPath()} could not be moved to {place}")
        self.spark.catalog.refreshByPath(f"{self.root}/{name}")


def _dealt(rows: DataFrame, buckets: list[int]) -> list[DataFrame]:
    """The rows in up to PARTS parts of the buckets; the first has also those of all others."""
    rest = [buckets[k::PARTS] for k in range(1, min(PARTS, len(buckets)))]
    if not rest:
        return [rows]
    first = ~F.col("bucket").isin(sum(rest, []))
    return [rows.where(first), *(rows.where(F.col("bucket").isin(part)) for part in rest)]


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)


def write_snapshot(archive: Archive, root: str, buckets: int = 16) -> Snapshot:
    """Write the whole archive below the new folder `root`; choose buckets of about 100 MB.

    The bookmarks are written twice, so that shuffles of the query that makes them are gone
    before the wide rows go to their buckets, some buckets at a time.
    """
    snapshot = Snapshot(archive.bookmarks.sparkSession, root, buckets)
    with freed_shuffles(snapshot.spark):
        draft = snapshot._draft()
        rows = snapshot._drafted(archive.bookmarks, draft)
        snapshot._write("bookmarks", rows, parts=list(range(buckets)))
        snapshot._delete(draft)
        snapshot._write("links", archive.links)
        snapshot._write("tags", archive.tags)
        snapshot._write_grams()
    meta = snapshot.spark.createDataFrame([(buckets,)], "buckets int")
    meta.coalesce(1).write.mode("overwrite").json(f"{root}/meta")
    return snapshot


def open_snapshot(spark: SparkSession, root: str) -> Snapshot:
    row = spark.read.schema("buckets int").json(f"{root}/meta").first()
    return Snapshot(spark, root, row.buckets)
