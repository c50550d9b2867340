"""WARC archives: written with an index, read back by coalesced byte ranges.

Every record is a gzip member of its own. The index holds archive, offset, length, URL and
digest of each record, so a reader fetches just the ranges it needs, neighbours together.
Archives lie in a folder that all executors reach, by any file system pyarrow knows.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscope.llm.shared import cut

#: Bytes: an archive is closed beyond the first, ranges this close are fetched together, and
#: one fetch is not extended beyond the last.
ARCHIVE_BYTES = 64 << 20
GAP_BYTES = 64 << 10
FETCH_BYTES = 8 << 20
#: Bytes of archives that a reading task is meant to take.
STRETCH_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "page_id bigint, url string, digest string, payload_bytes bigint, record_type string, "
    "archive string, offset bigint, length bigint"
)
RECORD = (
    "page_id bigint, url string, record_type string, payload_bytes bigint, "
    "payload_digest string, refers_to bigint, payload binary"
)


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder, given as a path or an address (`file:/x` too)."""
    scheme, colon, path = folder.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder if path.startswith("//") else f"{scheme}://{path}")


def one_line(value: str) -> str:
    """A header value without the line breaks that would end it."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_of(page: dict, date: str) -> bytes:
    """One WARC record: a response, or a revisit that carries the HTTP header only."""
    payload, revisit = page["payload"] or b"", page["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    name = "" if page["page_id"] is None else page["page_id"]
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{page['digest']}",
    ]
    if page["url"] is not None:
        head.append(f"WARC-Target-URI: {one_line(page['url'])}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{page['refers_to']}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(member: bytes) -> tuple:
    """The columns of RECORD from one gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    sizes = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    number = lambda field: int(fields[field][10:-1]) if fields.get(field, "")[10:-1] else None
    kind = fields["WARC-Type"]
    return (
        number("WARC-Record-ID"),
        fields.get("WARC-Target-URI"),
        kind,
        int(sizes["Content-Length"]),
        fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        number("WARC-Refers-To"),
        body if kind == "response" else None,
    )


@F.arrow_udf(StringType())
def payload_digest(payloads: pa.Array) -> pa.Array:
    """Bare upper-case base32 SHA-1."""
    return pa.array(
        [base64.b32encode(hashlib.sha1(p.as_py() or b"").digest()).decode() for p in payloads]
    )


def with_references(pages: DataFrame, least_bytes: int) -> DataFrame:
    """`pages` (page_id, url, payload) with digest and, for revisits, refers_to.

    The response of each payload is that with the smallest id. Ids and digests alone are
    grouped, with map-side partial minima; the join with one payload in a large share of
    the pages is one that adaptive execution can split.
    """
    digested = pages.withColumn("digest", payload_digest("payload"))
    firsts = (
        digested.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"))
    )
    refers = (F.octet_length("payload") >= least_bytes) & (F.col("first") < F.col("page_id"))
    return digested.join(firsts, "digest", "left").withColumn(
        "refers_to", F.when(refers, F.col("first"))
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
) -> DataFrame:
    """Write a record per row of `pages` below `folder` and return the index (INDEX).

    Of equal payloads of at least `least_bytes` bytes, that with the smallest page id is
    the response and the others revisit it; rows that share this id, and rows without an
    id, are responses too. A null payload is empty, a null URL has no header, line
    breaks in a URL are percent-encoded, and other columns are ignored. An empty table
    writes no archive. Archives get unused names, and the index names those of tasks that
    succeeded only, so a repeated or lost task does no harm.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    types = [pa.int64(), pa.string(), pa.string(), pa.int64()]
    types += [pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [field.split(" ")[0] for field in INDEX.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_folder(folder)
        system.create_dir(top, recursive=True)
        stream, archive, offset = None, "", 0
        for batch in batches:
            found = []
            for at in range(batch.num_rows):
                page = {k: batch[k][at].as_py() for k in ("page_id", "url", "payload", "digest", "refers_to")}
                if stream is None or offset >= ARCHIVE_BYTES:
                    if stream:
                        stream.close()
                    archive, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    stream = system.open_output_stream(f"{top}/{archive}", compression=None)
                pressed = zlib.compressobj(3, zlib.DEFLATED, 31)
                member = pressed.compress(record_of(page, date)) + pressed.flush()
                stream.write(member)
                kind = "response" if page["refers_to"] is None else "revisit"
                found.append(
                    (page["page_id"], page["url"], page["digest"], len(page["payload"]), kind)
                    + (archive, offset, len(member))
                )
                offset += len(member)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found), types)], names=names
                )
        if stream:
            stream.close()

    return cut(with_references(rows, least_bytes).mapInArrow(write, INDEX))


def coalesced(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of (archive, offset, length), sorted, that are fetched together."""
    run: list[tuple[str, int, int]] = []
    for row in rows:
        if run:
            archive, offset, length = run[-1]
            apart = row[0] != archive or row[1] - offset - length > GAP_BYTES
            if apart or row[1] + row[2] - run[0][1] > FETCH_BYTES:
                yield run
                run = []
        run.append(row)
    if run:
        yield run


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records (RECORD) that the rows of `index` name, whichever were selected.

    Rows are dealt by stretches of STRETCH_BYTES of an archive, which a task reads in order, to
    as many tasks as the bytes of the records ask for; the few bytes of an index row say nothing
    about that. An archive of any size is shared by several tasks.
    """
    places = index.select("archive", "offset", "length")
    total = index.agg(F.sum("length")).first()[0] or 0
    cores = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-total // STRETCH_BYTES))
    stretch = F.floor(F.col("offset") / min(STRETCH_BYTES, max(1, total // tasks)))
    ordered = places.repartition(tasks, "archive", stretch).sortWithinPartitions(
        "archive", "offset"
    )
    types = [pa.int64(), pa.string(), pa.string(), pa.int64()]
    types += [pa.string(), pa.int64(), pa.binary()]
    names = [field.split(" ")[0] for field in RECORD.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_folder(folder)
        for batch in batches:
            rows = list(zip(*[batch[k].to_pylist() for k in ("archive", "offset", "length")]))
            opened, file = "", None
            for run in coalesced(rows):
                archive, start, _ = run[0]
                if archive != opened:
                    opened, file = archive, system.open_input_file(f"{top}/{archive}")
                size = run[-1][1] + run[-1][2] - start
                data = file.read_at(size, start)
                found = [parse_record(data[o - start : o - start + n]) for _, o, n in run]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found), types)], names=names
                )

    return ordered.mapInArrow(read, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write `pages` to archives and read all of them back."""
    return read_records(write_archives(pages, folder, **columns), folder)
