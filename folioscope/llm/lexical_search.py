"""Ranked lexical search over a length-stratified index, in whole numbers.

Documents with the same length normaliser m form a stratum; strata are cut into segments of a
bounded number of documents. A segment's postings are grouped by term and count (tf), so the
impact of a posting depends on (m, tf) alone and is computed once for all its documents. The
best impact of each term in a segment bounds what any of its documents can score: segments
are visited by falling bound, until no other can reach the best `top` found so far.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import cut, scratch_folder

#: Bytes that are no part of a term become spaces, A-Z become a-z.
TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20
    for c in range(256)
)
POSTINGS = "m bigint, segment bigint, term string, tf bigint, n_docs bigint, docs array<bigint>"
NAMES = [x.split()[0] for x in POSTINGS.split(", ")]


@dataclass(frozen=True)
class Ranking:
    """What a score is made of: m = base + slope * n / average n, impact = scale * tf / (...)."""

    base: int = 100
    slope: int = 50
    tf_weight: int = 1000
    length_weight: int = 20
    scale: int = 1_000_000_000

    def normaliser(self, n: Column, n_docs: int, n_terms: int) -> Column:
        share = F.expr(f"div({self.slope} * n * {n_docs}L, {max(n_terms, 1)}L)")
        return F.lit(self.base - self.slope).cast("long") + share

    def impact(self, m: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return self.scale * tf // (self.tf_weight * tf + self.length_weight * m)

    def weight(self, df: Column, n_docs: int) -> Column:
        odds = F.lit(2.0 * n_docs + 2.0) / (2.0 * df + 1.0)
        return F.floor(1000.0 * F.ln(odds)).cast("long")


@dataclass(frozen=True)
class Sizes:
    """Bounds of what a task holds: documents and term entries of a segment, postings and query
    terms looked at together, counts of strata sent to all tasks. They don't change results."""

    segment_docs: int = 4096
    segment_entries: int = 2_000_000
    held_postings: int = 4_000_000
    block_terms: int = 100_000
    sent_strata: int = 50_000


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def count_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with a term: each term once, with its count."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms_of(text.as_py())) for text in batch["text"]]
            counts = [np.fromiter(x.values(), np.uint32, len(x)) for x in found]
            has = [k for k, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(has, pa.int64())),
                    pa.array([int(counts[k].sum()) for k in has], pa.int64()),
                    pa.array([b" ".join(found[k]) for k in has], pa.binary()),
                    pa.array([counts[k].tobytes() for k in has], pa.binary()),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(counted, "doc_id bigint, n bigint, terms binary, tfs binary")


@dataclass
class Segment:
    """Documents of one stratum whose postings are being gathered."""

    m: int
    share: int
    ids: list[int | None] = field(default_factory=list)
    numbers: dict[bytes, int] = field(default_factory=dict)
    terms: list[np.ndarray] = field(default_factory=list)
    tfs: list[np.ndarray] = field(default_factory=list)
    entries: int = 0

    def add(self, id_: int | None, terms: bytes, tfs: bytes) -> None:
        numbers = self.numbers
        found = [numbers.setdefault(t, len(numbers)) for t in terms.split(b" ")]
        self.ids.append(id_)
        self.terms.append(np.array(found, dtype=np.int64))
        self.tfs.append(np.frombuffer(tfs, np.uint32).astype(np.int64))
        self.entries += len(found)

    def postings(self, number: int) -> pa.RecordBatch:
        """Rows (m, segment, term, tf, n_docs, docs); the first, without a term, names the ids.

        `docs` are places in that list of ids.
        """
        term, tf = np.concatenate(self.terms), np.concatenate(self.tfs)
        place = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.terms])
        order = np.lexsort((place, tf, term))
        term, tf, place = term[order], tf[order], place[order]
        new = np.append(True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1]))
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(term)))
        spelled = np.array(list(self.numbers), dtype=object)
        ends = np.append(0, np.cumsum(np.append(len(self.ids), counts)))
        values = pa.concat_arrays(
            [pa.array(self.ids, pa.int64()), pa.array(place, pa.int64())]
        )
        rows = len(starts) + 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(rows, self.m), pa.int64()),
                pa.array(np.full(rows, number), pa.int64()),
                pa.array([None, *spelled[term[starts]]], pa.binary()).cast(pa.string()),
                pa.array(np.append(0, tf[starts]), pa.int64()),
                pa.array(np.append(0, counts), pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
            ],
            names=NAMES,
        )


@dataclass(frozen=True)
class Index:
    """The postings in `folder`; counts of documents with a term and of all their terms."""

    folder: str
    n_docs: int
    n_terms: int
    ranking: Ranking

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(POSTINGS).parquet(self.folder)


def build_index(
    docs: DataFrame,
    folder: str,
    ranking: Ranking = Ranking(),
    sizes: Sizes = Sizes(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Index:
    """Write the index of all documents to the new folder `folder`.

    A stratum is dealt by hash into as many shares as its documents and term entries ask for,
    so that one of any size spreads and shares hold about equal amounts; a share that is over
    the bounds all the same is cut into segments of its own.

    Null texts have no terms and, like others without a term, are not indexed or counted. Rows
    are documents of their own, whether their ids repeat or are null. An empty table gives an
    empty index; other columns are ignored.
    """
    spark = docs.sparkSession
    counted = scratch_folder(spark, "terms")
    count_terms(docs, id_col, text_col).write.parquet(counted)
    rows = spark.read.parquet(counted)
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = rows.withColumn("m", ranking.normaliser(F.col("n"), n_docs, n_terms))
    entries = F.sum(F.octet_length("tfs") / 4)
    needed = F.greatest(F.count("*") / sizes.segment_docs, 4 * entries / sizes.segment_entries)
    strata = cut(rows.groupBy("m").agg((1 + F.floor(needed)).cast("long").alias("shares")))
    if strata.count() <= sizes.sent_strata:
        strata = F.broadcast(strata)
    spread = F.xxhash64("doc_id", F.crc32("terms"))
    dealt = (
        rows.join(strata, "m")
        .withColumn("share", F.pmod(spread, F.col("shares")))
        .repartition("m", "share")
        .sortWithinPartitions("m", "share", "doc_id")
        .select("m", "share", "doc_id", "terms", "tfs")
    )

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("m", "share", "doc_id", "terms", "tfs")]
            for m, share, id_, terms, tfs in zip(*columns):
                if held and (
                    (m, share) != (held.m, held.share)
                    or len(held.ids) >= sizes.segment_docs
                    or held.entries >= sizes.segment_entries
                ):
                    yield held.postings(number)
                    number, held = number + 1, None
                held = held or Segment(m, share)
                held.add(id_, terms, tfs)
        if held:
            yield held.postings(number)

    dealt.mapInArrow(built, POSTINGS).write.parquet(folder)
    return Index(folder, n_docs, n_terms, ranking)


def query_terms(
    items: DataFrame, index: Index, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """(item_id, term, weight): the terms of each item that the index has, once each."""
    spark = items.sparkSession
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), ascii_uppercase, ascii_lowercase)
    outside = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    terms = items.select(
        F.col(id_col).alias("item_id"), F.explode(F.split(text, outside)).alias("term")
    )
    terms = terms.where("term <> ''").distinct()
    held = index.postings(spark).join(terms.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = index.ranking.weight(F.col("df"), index.n_docs)
    return terms.join(df, "term").select("item_id", "term", weight.alias("weight"))


def in_blocks(queries: DataFrame, most: int) -> Iterator[list]:
    """The rows of `queries` in blocks of whole items, of at most twice `most` rows.

    Only an item with more terms than that makes a larger block, alone or almost so.
    """
    total, items = queries.agg(F.count("*"), F.count_distinct(F.struct("item_id"))).first()
    blocks = 1 + total // most
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")
        largest = queries.groupBy(block).count().agg(F.max("count")).first()[0] or 0
        if largest <= 2 * most or blocks > 64 * items:
            break
        blocks *= 2
    for number in range(blocks):
        rows = queries.where(block == number).collect()
        if rows:
            yield rows


class Block:
    """The queries of a block: terms are numbered, items are runs of (term, weight)."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda x: (x.item_id is None, str(x.item_id)))
        self.numbers = {t: k for k, t in enumerate(dict.fromkeys(x.term for x in rows))}
        self.items = list(dict.fromkeys(x.item_id for x in rows))
        counts = Counter(x.item_id for x in rows)
        self.terms = np.array([self.numbers[x.term] for x in rows])
        self.weights = np.array([x.weight for x in rows], dtype=np.int64)
        self.starts = np.append(0, np.cumsum([counts[x] for x in self.items]))


class Visited:
    """A segment's postings for the terms of a block."""

    def __init__(self, m: int, size: int):
        self.m, self.ids, self.size = m, np.zeros(0), size
        self.terms: list[int] = []
        self.tfs: list[int] = []
        self.docs: list[np.ndarray] = []

    def prepare(self, block: Block, ranking: Ranking) -> np.ndarray:
        """Order the postings by term; the bound of each item's scores here."""
        impacts = ranking.impact(np.int64(self.m), np.array(self.tfs, dtype=np.int64))
        order = np.argsort(np.array(self.terms), kind="stable")
        term = np.array(self.terms)[order]
        sizes = np.array([len(self.docs[k]) for k in order])
        # Postings of a term follow each other, so a term is one run of documents and impacts.
        self.flat = np.concatenate([self.docs[k] for k in order])
        self.impacts = np.repeat(impacts[order], sizes)
        ends = np.append(0, np.cumsum(sizes))
        count = len(block.numbers)
        self.first = ends[np.searchsorted(term, np.arange(count))]
        self.past = ends[np.searchsorted(term, np.arange(count), side="right")]
        best = np.zeros(count, dtype=np.int64)
        np.maximum.at(best, np.array(self.terms), impacts)
        self.docs = []
        return np.add.reduceat(block.weights * best[block.terms], block.starts[:-1])

    def scores(self, block: Block, item: int) -> np.ndarray:
        total = np.zeros(self.size, dtype=np.int64)
        for k in range(block.starts[item], block.starts[item + 1]):
            run = slice(self.first[block.terms[k]], self.past[block.terms[k]])
            total[self.flat[run]] += block.weights[k] * self.impacts[run]
        return total


class Best:
    """The best documents of one item so far: by falling score, then by id, null last."""

    def __init__(self, top: int):
        self.top = top
        self.scores = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int64)
        self.nulls = np.zeros(0, dtype=bool)

    def least(self) -> int:
        """Scores below can't enter; equal ones can, by a smaller id."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        may = np.flatnonzero(scores >= self.least())
        scores = np.append(self.scores, scores[may])
        ids, nulls = np.append(self.ids, ids[may]), np.append(self.nulls, nulls[may])
        order = np.lexsort((ids, nulls, -scores))[: self.top]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


def search_block(index: Index, postings: DataFrame, rows: list, top: int, sizes: Sizes):
    """(item number, task, doc_id, score): the best of each task for the items of a block."""
    spark = postings.sparkSession
    block, ranking = Block(rows), index.ranking
    shared = spark.sparkContext.broadcast(block)
    wanted = spark.createDataFrame([(t,) for t in block.numbers], "term string")
    met = postings.join(F.broadcast(wanted), "term", "left_semi").select(NAMES)
    named = postings.where("term IS NULL").select(NAMES)
    dealt = (
        met.unionByName(named)
        .repartition("m", "segment")
        .sortWithinPartitions("m", "segment", F.col("term").asc_nulls_first(), "tf")
    )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, task = shared.value, TaskContext.get().partitionId()
        best = [Best(top) for _ in block.items]
        held: list[Visited] = []
        entries, now, key = 0, None, None

        def visit() -> None:
            """Each item goes through the segments held by falling bound."""
            some = [x for x in held if x.terms]
            if not some:
                return
            bounds = np.stack([x.prepare(block, ranking) for x in some])
            for item, found in enumerate(best):
                for k in np.argsort(-bounds[:, item], kind="stable"):
                    if bounds[k, item] < found.least():
                        break
                    found.add(some[k].scores(block, item), some[k].ids, some[k].nulls)

        for batch in batches:
            values, ends = batch["docs"].values, batch["docs"].offsets.to_numpy()
            columns = [batch[c].to_pylist() for c in ("m", "segment", "term", "tf")]
            for k, (m, segment, term, tf) in enumerate(zip(*columns)):
                docs = values[ends[k] : ends[k + 1]]
                if term is None:
                    if entries >= sizes.held_postings:
                        visit()
                        held, entries = [], 0
                    now = Visited(m, len(docs))
                    now.nulls = docs.is_null().to_numpy(zero_copy_only=False)
                    now.ids = docs.fill_null(0).to_numpy()
                    held.append(now)
                    entries += len(docs)
                else:
                    now.terms.append(block.numbers[term])
                    now.tfs.append(tf)
                    now.docs.append(docs.to_numpy().copy())
                    entries += len(docs)
        visit()
        for item, found in enumerate(best):
            if len(found.scores):
                count = len(found.scores)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(count, item), pa.int64()),
                        pa.array(np.full(count, task), pa.int64()),
                        pa.array(found.ids, pa.int64(), mask=found.nulls),
                        pa.array(found.scores, pa.int64()),
                    ],
                    names=["item", "task", "doc_id", "score"],
                )

    found = dealt.mapInArrow(searched, "item bigint, task bigint, doc_id bigint, score bigint")
    return best_of(best_of(found, top, "item", F.expr("task div 64")), top, "item"), block.items


def best_of(found: DataFrame, top: int, *group) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(
    index: Index,
    items: DataFrame,
    top: int = 50,
    sizes: Sizes = Sizes(),
    id_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item with a score above 0.

    A score sums weight * impact over the terms that item and document share; equal scores
    are ranked by id, documents without one last. Rows with one item id (or none) are one
    item with all their terms; null texts have none. Items without a hit have no rows.

    Items are searched in blocks of about `block_terms` terms, each against the whole index;
    a block is what tasks are sent, its size does not depend on the documents.
    """
    spark = items.sparkSession
    queries = cut(query_terms(items, index, id_col, text_col))
    postings = index.postings(spark)
    kind = items.schema[id_col].dataType
    answers = None
    for rows in in_blocks(queries, sizes.block_terms):
        found, ids = search_block(index, postings, rows, top, sizes)
        named = spark.createDataFrame(
            list(enumerate(ids)), f"item bigint, item_id {kind.simpleString()}"
        )
        ranked = found.join(F.broadcast(named), "item").select(
            "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"
        )
        answers = ranked if answers is None else answers.unionByName(ranked)
    if answers is None:
        schema = f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint"
        answers = spark.createDataFrame([], schema)
    return answers
