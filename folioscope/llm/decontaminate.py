"""Benchmark decontamination by winnowing.

The smallest k-gram hash of every run of consecutive k-grams is a fingerprint. A run covers
exactly one window, and its choice depends on the window's words alone, so any window shared
by a document and a test item contains a fingerprint that both sides select at the same place.
Equal fingerprints are joined and extended word by word to the shared span.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import cut

#: A word is a run of 0-9, A-Z, a-z and anything beyond ASCII; A-Z counts as a-z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)
FILTER_BITS = 1 << 22
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Winnowing:
    """Windows of `window` words; fingerprints are hashes of `gram` words."""

    window: int = 10
    gram: int = 5


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, given the words' hashes."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    mixed = np.full(count, size, dtype=np.uint64)
    for k in range(size):
        mixed = (mixed ^ words[k : k + count]) * MIX
        mixed ^= mixed >> np.uint64(29)
    return mixed


def select(grams: np.ndarray, run: int) -> np.ndarray:
    """Positions of the leftmost smallest hash of each `run` consecutive ones, ascending."""
    count = len(grams) - run + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = grams[:count].copy(), np.zeros(count, dtype=np.int64)
    for k in range(1, run):
        less = grams[k : k + count] < best
        best[less] = grams[k : k + count][less]
        at[less] = k
    chosen = np.zeros(len(grams), dtype=bool)
    chosen[at + np.arange(count)] = True
    return np.flatnonzero(chosen)


def fingerprints(
    words: list[bytes], how: Winnowing, sizes: list[int]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, positions, hashes): winnowed grams, then all grams of the short `sizes`."""
    if not sizes and len(words) < how.window:
        return
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    if len(words) >= how.window:
        grams = gram_hashes(hashes, how.gram)
        at = select(grams, how.window - how.gram + 1)
        yield how.window, at, grams[at]
    for size in sizes:
        grams = gram_hashes(hashes, size)
        yield size, np.arange(len(grams)), grams


def around(words: list[bytes], at: int, size: int, how: Winnowing) -> tuple[int, str]:
    """Words before the gram and, as one text, the gram with all words a window could add."""
    if size < how.window:
        return 0, b" ".join(words[at : at + size]).decode()
    before = min(at, how.window - how.gram)
    return before, b" ".join(words[at - before : at + how.window]).decode()


def item_prints(items: DataFrame, how: Winnowing) -> DataFrame:
    """(size, hash, item_id, before, context) of test items (item_id as string, text).

    An item shorter than a window is a window of its own size.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist()):
                words = words_of(text)
                short = [len(words)] if 0 < len(words) < how.window else []
                for size, places, hashes in fingerprints(words, how, short):
                    for at, value in zip(places.tolist(), hashes.view(np.int64).tolist()):
                        rows.append((size, value, item, *around(words, at, size, how)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), PRINT_TYPES)], names=PRINT_NAMES
                )

    return items.mapInArrow(
        prints, "size int, hash bigint, item_id string, before int, context string"
    ).distinct()


PRINT_NAMES = ["size", "hash", "item_id", "before", "context"]
PRINT_TYPES = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string()]
ROW_NAMES = ["row", "doc_id", "n_words", "size", "hash", "at", "before", "context"]
ROW_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]


def filter_words(prints: DataFrame) -> np.ndarray:
    """Which values the hashes take modulo FILTER_BITS, as bits: always half a megabyte."""
    place = F.pmod("hash", F.lit(FILTER_BITS))
    found = (
        prints.select(
            F.shiftright(place, 6).alias("word"),
            F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
            .alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    )
    table = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    for row in found:
        table[row["word"]] = row["bits"] & (1 << 64) - 1
    return table


def possible_hits(docs: DataFrame, how: Winnowing, sizes: list[int], table: np.ndarray):
    """Per row of (row, doc_id, text): a line with n_words, and a line per possible hit."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist())
            for (row, doc), text in zip(ids, batch["text"]):
                words = words_of(text.as_py())
                rows.append((row, doc, len(words), None, None, None, None, None))
                for size, places, hashes in fingerprints(words, how, sizes):
                    bit = hashes & np.uint64(FILTER_BITS - 1)
                    known = table[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)
                    hit = known.astype(bool)
                    values = hashes[hit].view(np.int64).tolist()
                    for at, value in zip(places[hit].tolist(), values):
                        context = around(words, at, size, how)
                        rows.append((row, doc, None, size, value, at, *context))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), ROW_TYPES)], names=ROW_NAMES
                )

    return docs.mapInArrow(
        scan,
        "row bigint, doc_id bigint, n_words bigint, size int, hash bigint, at bigint, "
        "before int, context string",
    )


def extend(joined: DataFrame, how: Winnowing) -> DataFrame:
    """(row, items, first, past): the spans shared around equal fingerprints."""
    names = ["row", "items", "first", "past"]
    types = [pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64()]

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                ours, theirs = x["context"].split(" "), x["item_context"].split(" ")
                i, j = x["before"], x["item_before"]
                gram = how.gram if x["size"] == how.window else x["size"]
                if ours[i : i + gram] != theirs[j : j + gram]:
                    continue
                left = 0
                while left < min(i, j) and ours[i - left - 1] == theirs[j - left - 1]:
                    left += 1
                right = gram
                most = min(len(ours) - i, len(theirs) - j)
                while right < most and ours[i + right] == theirs[j + right]:
                    right += 1
                if left + right >= x["size"]:
                    rows.append((x["row"], x["items"], x["at"] - left, x["at"] + right))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names
                )

    return joined.mapInArrow(spans, "row bigint, items array<string>, first bigint, past bigint")


def union_length(spans: Column) -> Column:
    """Positions covered by sorted spans (first, past)."""
    zero = F.lit(0).cast("long")
    return F.aggregate(
        spans,
        F.struct(zero.alias("n"), zero.alias("past")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(zero, s["past"] - F.greatest(s["first"], a["past"]))).alias("n"),
            F.greatest(a["past"], s["past"]).alias("past"),
        ),
        lambda a: a["n"],
    )


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    how: Winnowing = Winnowing(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, items) per row of `docs`.

    n_hit counts the words inside an occurrence of a window of any item, `items` is the
    array of these items' ids, sorted as strings. Every shared window is found. Null texts
    have no words; ids may repeat or be null (items without an id hit words but are not
    listed); empty tables and other columns are no special case.

    Only fingerprints that pass a bit filter of fixed size leave the scan, each with the
    few words around it, so texts are read once and never shuffled. However large the
    benchmark, the join decides; its document side can be split where one passage is in a
    large share of the documents.
    """
    prints = cut(
        item_prints(
            items.select(
                F.col(item_id_col).cast("string").alias("item_id"),
                F.col(item_text_col).alias("text"),
            ),
            how,
        )
    )
    short = [x["size"] for x in prints.select("size").distinct().collect()]
    sizes = sorted(s for s in short if s < how.window)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
    )
    scanned = cut(possible_hits(rows, how, sizes, filter_words(prints)))
    # A passage of very many items meets a document once for each of its surroundings.
    contexts = prints.groupBy(
        "size", "hash", F.col("before").alias("item_before"), F.col("context").alias("item_context")
    ).agg(F.collect_set("item_id").alias("items"))
    joined = (
        scanned.where(F.col("hash").isNotNull())
        .select("row", "size", "hash", "at", "before", "context")
        .join(contexts, ["size", "hash"])
    )
    hits = (
        extend(joined, how)
        .groupBy("row")
        .agg(
            F.sort_array(F.collect_set(F.struct("first", "past"))).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    return (
        scanned.where(F.col("hash").isNull())
        .select("row", "doc_id", "n_words")
        .join(hits, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce(union_length(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
