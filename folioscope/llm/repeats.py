"""Substring dedup by level-wise doubling.

A window of `window` words can only repeat if what it contains does. Level one looks at short
windows and, of each full window, only at the one with the smallest hash: equal windows choose
the same one, so a part of the places is enough. Where that occurs in one document alone the
full window is given up; the others are looked at again with twice the length, and so on up
to the full length or until no candidate is left. With the default sizes that are 7 and 13
words. Longer levels add nothing: all words of a longer repeat lie in repeated windows of
this length.

Documents are dealt into parts by hash, as many as their count and bytes ask for. A part sends
each hash once, sorted into arrays by range, to the bucket that compares it: a passage found in
a third of all documents reaches its bucket once per part, and what is shuffled is eight bytes
per candidate.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import cut

#: Size of a part: documents and bytes of their texts on average.
PART_DOCS = 2000
PART_BYTES = 64 << 20
#: Words of the windows of level one.
FIRST = 7
PARTS_PER_BUCKET = 4
MIX = np.uint64(0x9E3779B97F4A7C15)
TURN = np.uint64(0xD6E8FEB86659FD93)


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a window from the hashes of two windows that cover it."""
    mixed = (left ^ right * TURN) * MIX
    mixed ^= mixed >> np.uint64(32)
    mixed *= MIX
    return mixed ^ mixed >> np.uint64(29)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` words, by doubling from the words' hashes."""
    hashes, size = words, 1
    while size < length:
        step = min(size, length - size)
        hashes = pair(hashes[: max(0, len(hashes) - step)], hashes[step:])
        size += step
    return hashes


def extended(hashes: np.ndarray, size: int, longer: int) -> np.ndarray:
    """Hashes of the windows of `longer` words, at most twice `size`, from those of `size`."""
    step = longer - size
    return pair(hashes[: max(0, len(hashes) - step)], hashes[step:])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def smallest(hashes: np.ndarray, run: int) -> np.ndarray:
    """For each `run` consecutive hashes the position of the leftmost smallest."""
    count = max(0, len(hashes) - run + 1)
    best, at = hashes[:count].copy(), np.arange(count)
    for k in range(1, run):
        less = hashes[k : k + count] < best
        best[less] = hashes[k : k + count][less]
        at[less] = np.flatnonzero(less) + k
    return at


def lengths(window: int, first: int) -> list[int]:
    """Words of the windows of each level, the last being the full length."""
    sizes = [min(first, window)]
    while sizes[-1] < window:
        sizes.append(min(2 * sizes[-1], window))
    return sizes


class Part:
    """The documents of a part that have an id and at least one window."""

    def __init__(self, table: pa.Table, window: int):
        self.window = window
        self.rows = []
        for at, (doc, text) in enumerate(zip(table["doc_id"].to_pylist(), table["text"])):
            words = [] if doc is None else (text.as_py() or "").encode().split()
            if len(words) >= window:
                self.rows.append((at, doc, word_hashes(words)))

    def candidates(
        self, sizes: list[int], known: list[np.ndarray]
    ) -> tuple[np.ndarray, np.ndarray]:
        """(hash, doc) of the windows to compare on the level after those of `known`.

        `known` has the repeated hashes of the levels before; a full window is still looked at
        if the window that it chose was among them on each level.
        """
        found = []
        for _, doc, words in self.rows:
            alive = np.arange(len(words) - self.window + 1)
            hashes = window_hashes(words, sizes[0])
            for level, size in enumerate(sizes):
                if level:
                    hashes = extended(hashes, sizes[level - 1], size)
                place = smallest(hashes, self.window - size + 1)[alive]
                if level == len(known):
                    found.append((hashes[np.unique(place)], doc))
                    break
                alive = alive[among(hashes, known[level])[place]]
                if not len(alive):
                    break
        return stacked(found)

    def removed(
        self, sizes: list[int], hashes: np.ndarray, lows: np.ndarray
    ) -> Iterator[tuple[int, np.ndarray]]:
        """(row, which words to remove): those in windows that a smaller document has."""
        for at, doc, words in self.rows:
            full = window_hashes(words, sizes[0])
            for size, longer in zip(sizes, sizes[1:]):
                full = extended(full, size, longer)
            place = np.flatnonzero(among(full, hashes))
            place = place[lows[np.searchsorted(hashes, full[place])] < doc]
            if len(place):
                edges = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edges, place, 1)
                np.add.at(edges, place + self.window, -1)
                yield at, np.cumsum(edges[:-1]) > 0


def stacked(found: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    hashes = np.concatenate([h for h, _ in found])
    return hashes, np.repeat(np.array([d for _, d in found]), [len(h) for h, _ in found])


def among(hashes: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted array."""
    if not len(ordered):
        return np.zeros(len(hashes), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)] == hashes


def lowest(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes with their smallest document and whether there are several."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
    last = np.append(first[1:], len(hashes))[: len(first)] - 1
    return hashes[first], docs[first], docs[first] != docs[last]


SENT = "bucket int, part int, hashes binary, lows binary, several binary"
BACK = "part int, hashes binary, lows binary"


def sent(part: int, buckets: int, hashes: np.ndarray, docs: np.ndarray) -> pa.Table:
    """A row for each bucket that gets hashes of this part."""
    hashes, lows, several = lowest(hashes, docs)
    # The upper half of a hash names its bucket, so each bucket's share is a slice.
    to = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    names, starts = np.unique(to, return_index=True)
    slices = [slice(a, b) for a, b in zip(starts, np.append(starts[1:], len(to)))]
    columns = [
        pa.array(names.astype(np.int32)),
        pa.array(np.full(len(names), part, dtype=np.int32)),
        pa.array([hashes[s].tobytes() for s in slices], pa.binary()),
        pa.array([lows[s].tobytes() for s in slices], pa.binary()),
        pa.array([several[s].tobytes() for s in slices], pa.binary()),
    ]
    return pa.table(columns, names=["bucket", "part", "hashes", "lows", "several"])


def compared(table: pa.Table) -> pa.Table:
    """For each part the hashes of this bucket that it must know, with their smallest document.

    Those are the hashes that occur in several documents, of this part or of others.
    """
    read = lambda name, kind: [
        np.frombuffer(x.as_py(), dtype=kind) for x in table[name]
    ]
    hashes, lows, several = read("hashes", np.uint64), read("lows", np.int64), read("several", bool)
    sizes = [len(h) for h in hashes]
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    first = np.append(True, every[order][1:] != every[order][:-1])
    group = np.empty(len(every), dtype=np.int64)
    group[order] = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    low = np.minimum.reduceat(np.concatenate(lows)[order], starts)
    many = np.logical_or.reduceat(np.concatenate(several)[order], starts)
    many |= np.diff(np.append(starts, len(every))) > 1
    known, parts, ends = [], table["part"].to_pylist(), np.cumsum([0, *sizes])
    for part, start, end, own in zip(parts, ends, ends[1:], hashes):
        mine = group[start:end]
        keep = many[mine]
        if keep.any():
            known.append((part, own[keep].tobytes(), low[mine[keep]].tobytes()))
    columns = list(zip(*known)) or [(), (), ()]
    types = (pa.int32(), pa.binary(), pa.binary())
    return pa.table(
        [pa.array(c, t) for c, t in zip(columns, types)], names=["part", "hashes", "lows"]
    )


def known_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All hashes sent back to a part, sorted, with their smallest documents."""
    join = lambda name: b"".join(x.as_py() for x in table[name])
    hashes = np.frombuffer(join("hashes"), dtype=np.uint64)
    lows = np.frombuffer(join("lows"), dtype=np.int64)
    order = np.argsort(hashes)
    return hashes[order], lows[order]


def nullable(kind: pa.StructType) -> pa.StructType:
    return pa.struct([field.with_nullable(True) for field in kind])


def remove_repeats(
    docs: DataFrame,
    window: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    rejoin: bool = True,
    part_docs: int = PART_DOCS,
    first: int = FIRST,
) -> DataFrame:
    """(doc_id, n_words, n_removed, text, carried) per row of `docs`.

    A word is removed if it lies in a window of `window` words that also starts in a
    document with a smaller id; windows are judged on the given texts. `text` holds the
    words that are left, joined by one space; with `rejoin` off, a text that loses nothing
    is returned as it came. `carried` is a struct of the columns `carry`.

    Null texts have no words. Rows with a null id lose nothing and take nothing from
    others, so they are answered where they are, however many there are; rows that repeat
    an id take nothing from each other. Texts shorter than a
    window stay whole, an empty table gives an empty result, and other columns of any name
    are ignored. Windows are compared by 64-bit hashes.
    """
    count, size = docs.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    parts = max(1, -(-count // part_docs), -(-(size or 0) // PART_BYTES))
    buckets = -(-parts // PARTS_PER_BUCKET)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.struct(*[F.col(c) for c in carry], F.lit(None).cast("int").alias("_")).alias("carried"),
    )
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    by_part = rows.where("doc_id is not null").groupBy(part.alias("part"))

    sizes = lengths(window, first)

    def level(key: tuple[pa.Scalar], table: pa.Table, known: pa.Table) -> pa.Table:
        """What a part compares next, given the replies to all levels before."""
        if not known.num_rows:
            return sent(0, buckets, *stacked([]))
        replied = known["level"].to_numpy()
        before = [
            known_of(known.filter(pa.array(replied == n)))[0] for n in range(replied.max() + 1)
        ]
        if not all(map(len, before)):
            return sent(0, buckets, *stacked([]))
        return sent(key[0].as_py(), buckets, *Part(table, window).candidates(sizes, before))

    def level_one(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        return sent(key[0].as_py(), buckets, *Part(table, window).candidates(sizes, []))

    def finish(key: tuple[pa.Scalar], table: pa.Table, known: pa.Table) -> pa.Table:
        hashes, lows = known_of(known)
        return answered(
            table, dict(Part(table, window).removed(sizes, hashes, lows)) if len(hashes) else {}
        )

    def unnamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from answered(pa.Table.from_batches([batch]), {}).to_batches()

    def answered(table: pa.Table, gone: dict[int, np.ndarray]) -> pa.Table:
        """A row per document; `gone` has the words to remove by row."""
        counts, lost, texts = [], [], []
        for at, text in enumerate(table["text"]):
            words = (text.as_py() or "").encode().split()
            if at in gone:
                left = [w for w, out in zip(words, gone[at].tolist()) if not out]
            counts.append(len(words))
            lost.append(len(words) - len(left) if at in gone else 0)
            whole = at not in gone and not rejoin
            texts.append(text.as_py() if whole else b" ".join(left if at in gone else words).decode())
        return pa.table(
            [
                table["doc_id"],
                pa.array(counts, pa.int64()),
                pa.array(lost, pa.int64()),
                pa.array(texts, pa.string()),
                table["carried"].cast(nullable(table["carried"].type)),
            ],
            names=["doc_id", "n_words", "n_removed", "text", "carried"],
        )

    def replies(found: DataFrame) -> DataFrame:
        return found.groupBy("bucket").applyInArrow(compared, BACK)

    heard = replies(by_part.applyInArrow(level_one, SENT))
    so_far = heard.withColumn("level", F.lit(0))
    for n in range(1, len(sizes)):
        if n > 1:
            # Replies are written between further levels; without any the search is over.
            so_far = cut(so_far)
            if so_far.where(F.col("level") == n - 1).isEmpty():
                heard = heard.limit(0)
                break
        heard = replies(by_part.cogroup(so_far.groupBy("part")).applyInArrow(level, SENT))
        so_far = so_far.unionByName(heard.withColumn("level", F.lit(n)))
    fulls = heard.groupBy("part")
    schema = rows.schema
    out = (
        f"doc_id {schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, "
        f"text string, carried {schema['carried'].dataType.simpleString()}"
    )
    named = by_part.cogroup(fulls).applyInArrow(finish, out)
    return named.unionByName(rows.where("doc_id is null").mapInArrow(unnamed, out))
