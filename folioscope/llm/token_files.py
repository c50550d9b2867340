"""Token ids in Parquet: list columns, ordered by document, laid out for selective reads.

Ids are dictionary-encoded (two bytes each for a vocabulary of 50,000), document ids and
counts delta-encoded. Row groups and pages are small enough that a reader of few documents or
of the counts alone skips the rest by statistics and page indexes.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from folioscope.llm.encode import encoder

SCHEMA = "shard int, doc_id bigint, n_tokens bigint, tokens array<int>"
LAYOUT = {
    "compression": "snappy",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


def encode_documents(
    docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(shard, doc_id, n_tokens, tokens), ordered by document over the shards.

    The raw texts are dealt by range of the id, which samples only cheap rows; then each
    partition, a shard, is encoded in order.
    """
    ordered = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, coder = TaskContext.get().partitionId(), encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, ends = coder.encode_column(batch["text"], end_id)
                ends = np.append(0, ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(batch.num_rows, shard), pa.int32()),
                        batch["doc_id"],
                        pa.array(np.diff(ends), pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(ends, pa.int32()), pa.array(ids.view(np.int32))
                        ),
                    ],
                    names=["shard", "doc_id", "n_tokens", "tokens"],
                )

    return ordered.mapInArrow(encoded, SCHEMA)


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 2, **columns: str) -> None:
    """Write the ids of `docs` with the tokenizers file at `path`, each text closed by `end_id`.

    Null texts are empty (their end id alone), null ids come first, equal ids stand next to
    each other in any order, and an empty table gives files without rows. Other columns are
    ignored. The folder must be new; a lost task writes its shard again.
    """
    encode_documents(docs, path, end_id, **columns).write.options(**LAYOUT).parquet(folder)


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, doc_id, n_tokens, start) without reading any ids."""
    counts = counts_of(spark, folder)
    return with_starts(counts, counts)


def counts_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder).select("shard", "doc_id", "n_tokens")


def with_starts(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Add start, the count of ids of all documents before: of earlier shards and its own.

    `totals` (shard, n_tokens) is summed to a line per shard, and only these lines meet in one
    task. Shards are balanced, so no task gets more than a shard's documents.
    """
    shards = totals.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = (
        Window.partitionBy("shard")
        .orderBy(F.col("doc_id").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("long")
    bases = shards.select("shard", F.coalesce(F.sum("size").over(before), zero).alias("base"))
    return (
        rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), zero))
        .join(bases, "shard")
        .withColumn("start", F.col("base") + F.col("within"))
        .drop("base", "within")
    )


def read_tokens(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, n_tokens, tokens) of all or of the wanted documents (pushed to the files)."""
    rows = spark.read.schema(SCHEMA).parquet(folder).select("doc_id", "n_tokens", "tokens")
    return rows if wanted is None else rows.where(F.col("doc_id").isin(wanted))


def read_summary(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    The ids are read once and shrink to a checksum before anything is shuffled.
    """
    rows = spark.read.schema(SCHEMA).parquet(folder)
    rows = rows.withColumn("ids_crc32", checksum(F.col("tokens"))).drop("tokens")
    return with_starts(rows, counts_of(spark, folder)).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


@F.arrow_udf(LongType())
def crc32_of_ids(lists: pa.Array) -> pa.Array:
    """CRC-32 of each list of ids as little-endian unsigned 32-bit numbers."""
    ids, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    raw = memoryview(ids.astype("<u4").tobytes())
    return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])], pa.int64())


def checksum(tokens: Column) -> Column:
    return crc32_of_ids(tokens)
