"""Fill-in-the-middle rearrangement of documents by piece tables.

A document is a list of descriptors (buffer, start, stop) over byte buffers that never change:
its own text and the sentinels. Cutting splits a descriptor, an arrangement permutes
descriptors, the inverse permutation restores the text, and hashes are fed descriptor by
descriptor; the text itself is copied once, when an output is written.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Order of prefix (0), middle (1) and suffix (2) in an output, each after its sentinel, if any.
ARRANGEMENTS = {
    "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)),
    "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)),
}
SENTINELS = b"".join(mark for mark, _ in ARRANGEMENTS["psm"])


@dataclass(frozen=True)
class Mix:
    """Shares of the forms: how many of 100 documents are rearranged, and of those go suffix first."""

    rearranged_percent: int = 90
    suffix_first_percent: int = 20
    seed: int = 1


class Pieces:
    """A text as descriptors (buffer, start, stop) over immutable buffers."""

    def __init__(self, buffers: tuple[memoryview, ...], parts: list[tuple[int, int, int]]):
        self.buffers = buffers
        self.parts = parts

    def cut(self, *places: int) -> "Pieces":
        """Split the descriptors at ascending byte places of the text; empty parts stay."""
        parts, at, waiting = [], 0, list(places)
        for buffer, start, stop in self.parts:
            past = at + stop - start
            while waiting and waiting[0] <= past:
                middle = start + waiting.pop(0) - at
                parts.append((buffer, start, middle))
                at, start = at + middle - start, middle
            parts.append((buffer, start, stop))
            at = past
        return Pieces(self.buffers, parts)

    def views(self) -> Iterator[memoryview]:
        for buffer, start, stop in self.parts:
            yield self.buffers[buffer][start:stop]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()

    def join(self) -> bytes:
        return b"".join(self.views())


def of_text(raw: memoryview) -> Pieces:
    return Pieces((raw, memoryview(SENTINELS)), [(0, 0, len(raw))])


def arranged(text: Pieces, form: str) -> Pieces:
    """The output of a text cut into prefix, middle and suffix."""
    parts = []
    for mark, part in ARRANGEMENTS[form]:
        start = SENTINELS.index(mark)
        parts += [(1, start, start + len(mark)), text.parts[part]]
    return Pieces(text.buffers, parts)


def restored(output: memoryview, form: str) -> Pieces:
    """The text of an output: cut beside its sentinels, without them, in the first order again.

    No text holds a sentinel and none arises across a seam, so the first match is the seam.
    """
    whole = of_text(output)
    if form == "plain":
        return whole
    raw, places = bytes(output), []
    for mark, _ in ARRANGEMENTS[form]:
        at = raw.index(mark, places[-1] if places else 0)
        places += [at, at + len(mark)]
    # Before the first sentinel there is an empty part; then sentinels and parts alternate.
    found = whole.cut(*places).parts[2::2]
    order = [part for _, part in ARRANGEMENTS[form]]
    return Pieces(whole.buffers, [found[order.index(part)] for part in range(len(order))])


def raw_texts(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of each text of a column, in place; null is empty."""
    for text in column:
        data = text.as_buffer()
        yield memoryview(b"") if data is None else memoryview(data)


def byte_places(raw: memoryview, chars: list[int]) -> tuple[int, list[int]]:
    """(count of code points, byte place of each of the code points `chars`)."""
    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    n = len(starts)
    cuts = [c % (n + 1) for c in chars]
    return n, [int(starts[c]) if c < n else len(raw) for c in sorted(cuts)]


def drawn(id_: Column, seed: int, group: int) -> Column:
    """The unsigned number in an 8-digit group of the SHA-256 of the seed and the id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * group + 1, 8), 16, 10).cast("long")


OUTPUT = (
    "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
    "output string, output_sha256 string"
)


def fill_in_middle(
    docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256) per row of `docs`.

    The text of n code points is cut at two places drawn from the id, and the parts are put in
    the order of the form: psm is prefix, suffix, middle, spm suffix, prefix, middle, each
    behind its sentinel. Plain are the texts drawn to stay, empty ones, and those that hold a
    sentinel; their output is the text and they have no prefix_chars and middle_chars.

    A null text is empty; a null id draws from the seed alone; repeated rows are treated
    alike, row by row; an empty table gives no rows and other columns are ignored. Both cuts may
    fall on one place: the middle is then empty. Nothing is shuffled; a text is held whole.
    """
    id_ = F.col(id_col)
    rows = docs.select(
        id_.cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        *(drawn(id_, mix.seed, k).alias(f"h{k + 1}") for k in range(4)),
    )

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = zip(*(batch[f"h{k}"].to_pylist() for k in range(1, 5)))
            made = []
            for raw, (first, second, share, order) in zip(raw_texts(batch["text"]), draws):
                held, text = bytes(raw), of_text(raw)
                n, cuts = byte_places(raw, [first, second])
                marked = any(mark in held for mark in (PREFIX, SUFFIX, MIDDLE))
                if not n or marked or share % 100 >= mix.rearranged_percent:
                    made.append((n, "plain", None, None, held, text.sha256()))
                    continue
                form = "spm" if order % 100 < mix.suffix_first_percent else "psm"
                low, high = sorted((first % (n + 1), second % (n + 1)))
                output = arranged(text.cut(*cuts), form)
                made.append((n, form, low, high - low, output.join(), output.sha256()))
            n, form, prefix, middle, output, digest = zip(*made) if made else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()),
                    pa.array(output, pa.binary()).cast(pa.string()),
                    pa.array(digest, pa.string()),
                ],
                names=[x.split()[0] for x in OUTPUT.split(", ")],
            )

    return rows.mapInArrow(outputs, OUTPUT)


def restore(outputs: DataFrame) -> DataFrame:
    """`outputs` (columns output, form, others) with `text` and `restored_sha256` for `output`.

    Only the output and its form are used. A null output is an empty text.
    """
    others = [c for c in outputs.columns if c not in ("text", "restored_sha256")]

    @F.arrow_udf("text string, restored_sha256 string")
    def rebuilt(texts: pa.Array, forms: pa.Array) -> pa.Array:
        found = [
            restored(raw, form or "plain")
            for raw, form in zip(raw_texts(texts), forms.to_pylist())
        ]
        return pa.StructArray.from_arrays(
            [
                pa.array([x.join() for x in found], pa.binary()).cast(pa.string()),
                pa.array([x.sha256() for x in found], pa.string()),
            ],
            names=["text", "restored_sha256"],
        )

    named = outputs.select(*others, rebuilt("output", "form").alias("restored"))
    return named.select(*(c for c in others if c != "output"), "restored.*")
