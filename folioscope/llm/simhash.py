"""SimHash near-duplicates: pivot distance tables discard pairs, XOR verifies the rest.

Fingerprints within `radius` bits agree on all but `radius` of eight bytes, so every such
pair meets under at least one choice of agreeing bytes (28 choices for two bits). Rows that
agree there differ in the other bytes only: a meeting place holds at most 256 ** radius
different fingerprints, by arithmetic, whatever the data. Inside it, each fingerprint has a
row of Hamming distances to fixed reference fingerprints; a pair whose rows differ by more
than `radius` in any coordinate is discarded (triangle inequality), the others are verified.
"""

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import connected_components
from folioscope.llm.shared import cut

BLOCKS = 8
PIVOTS = 24
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints spread evenly: the hashes of the first numbers."""
    return np.array(
        [xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(count)], dtype=np.uint64
    )


def fingerprint_of(text: str, size: int) -> int:
    """SimHash of the word shingles of a whole text, as an unsigned number."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    shingles = max(1, len(words) - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, shingles, 1 << 15):
        hashes = np.array(
            [
                xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED)
                for i in range(start, min(start + (1 << 15), shingles))
            ],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > shingles, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, size: int) -> Column:
    """The fingerprint of a text as a signed 64-bit number; null counts as no words."""

    @F.arrow_udf("bigint")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            prints = [fingerprint_of(t.as_py() or "", size) for t in batch]
            yield pa.array(np.array(prints, dtype=np.uint64).view(np.int64))

    return hashed(text)


def meeting_places(prints: DataFrame, radius: int) -> DataFrame:
    """(choice, place, print): every print under every choice of bytes that may differ."""
    choices = list(combinations(range(BLOCKS), radius))
    masks = [
        ~reduce(lambda m, b: m | 0xFF << 8 * b, free, 0) & (1 << 64) - 1 for free in choices
    ]
    table = F.array(
        *[
            F.struct(
                F.lit(i).cast("int").alias("choice"),
                F.lit(int(np.uint64(m).view(np.int64))).cast("long").alias("mask"),
            )
            for i, m in enumerate(masks)
        ]
    )
    return prints.select("print", F.explode(table).alias("m")).select(
        F.col("m.choice").alias("choice"),
        F.col("print").bitwiseAND(F.col("m.mask")).alias("place"),
        "print",
    )


def close_pairs(prints: np.ndarray, place: np.ndarray, radius: int) -> tuple[np.ndarray, ...]:
    """Indices of the pairs within `radius` bits among prints of equal `place`.

    Rows are ordered by place and first coordinate, so that a row's candidates follow it
    directly until that coordinate differs too much; the other coordinates come next.
    """
    table = np.bitwise_count(prints[:, None] ^ pivots()[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], place))
    prints, place, table = prints[order], place[order], table[order]
    left, lefts, rights = np.arange(len(prints)), [], []
    step = 1
    while True:
        left = left[: np.searchsorted(left, len(prints) - step)]
        right = left + step
        near = (place[left] == place[right]) & (table[right, 0] - table[left, 0] <= radius)
        left, right = left[near], right[near]
        if not len(left):
            break
        same = (np.abs(table[left] - table[right]) <= radius).all(axis=1)
        a, b = left[same], right[same]
        close = np.bitwise_count(prints[a] ^ prints[b]) <= radius
        lefts.append(order[a[close]])
        rights.append(order[b[close]])
        step += 1
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *lefts]), np.concatenate([none, *rights])


def find_links(places: DataFrame, radius: int) -> DataFrame:
    """(a, b): each pair of different prints within `radius` bits, once."""
    choices = np.zeros((len(list(combinations(range(BLOCKS), radius))), BLOCKS), dtype=bool)
    for row, free in zip(choices, combinations(range(BLOCKS), radius)):
        row[list(free)] = True

    def first_choice(difference: np.ndarray) -> np.ndarray:
        """The first choice whose free bytes hold all differing bits."""
        differs = difference.view(np.uint8).reshape(-1, 8) != 0
        fits = ~(differs[:, None, :] & ~choices[None, :, :]).any(axis=2)
        return fits.argmax(axis=1)

    def links(choice: np.ndarray, place: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(
            np.append(0, (place[1:] != place[:-1]) | (choice[1:] != choice[:-1]))
        )
        counts = np.bincount(group)
        several = counts[group] > 1
        choice, group, prints = choice[several], group[several], prints[several]
        left, right = close_pairs(prints.view(np.uint64), group, radius)
        # A pair meets under every choice that frees its differing bytes: report it once.
        once = first_choice(prints[left] ^ prints[right]) == choice[left]
        a, b = prints[left[once]], prints[right[once]]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(n).to_numpy() for n in ("choice", "place", "print")]
            now = [np.concatenate(x) for x in zip(held, now)] if held else now
            # The last place may go on in the next batch; it is bounded (see above).
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            start = int(np.argmax(last))
            held = [x[start:].copy() for x in now]
            if start:
                yield links(*[x[:start] for x in now])
        if held:
            yield links(*held)

    ordered = places.repartition("choice", "place").sortWithinPartitions("choice", "place")
    return ordered.mapInArrow(search, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 3,
    radius: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of `docs`.

    Two rows are linked if the SimHashes of their word shingles differ in at most `radius`
    bits; component_id is the smallest id reachable over links, the row's own included.
    Rows with equal fingerprints are one node, so a group of copies of any size costs its
    rows once; no pair of rows is ever emitted. A text without words (or null) has
    fingerprint zero and is linked like any other. Rows without an id have a component if
    a linked row has an id, else null. Repeated rows are answered one by one; other columns
    are ignored.
    """
    hashed = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            fingerprint(F.col(text_col), shingle_words).alias("print"),
        )
    )
    prints = cut(hashed.groupBy("print").agg(F.min("doc_id").alias("low")))
    links = find_links(meeting_places(prints.select("print"), radius), radius)
    roots = connected_components(links)
    linked = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "root", F.coalesce("root", "print")
    )
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = linked.join(lowest, "root").select("print", "component_id")
    return hashed.join(classes, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
