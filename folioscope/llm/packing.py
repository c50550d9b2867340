"""Vector bin packing of examples into training sequences.

Each partition packs its own examples into a bounded number of open sequences, so nothing is
shuffled. A piece goes to the open sequence whose free room (tokens, segments, loss-bearing
tokens) has the largest dot product with the piece's demand. Where none can take it whole, the
piece is cut to fill one up.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.encode import encoder

OPEN = 48
TOGETHER = 128


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most."""

    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096


@dataclass
class Piece:
    """Ids `start` to `start + length` of an example; loss starts at its id `quiet`."""

    doc: int | None
    start: int
    length: int
    quiet: int
    total: int
    ids: np.ndarray

    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.quiet))

    def split(self, length: int) -> tuple["Piece", "Piece"]:
        left, start = self.length - length, self.start + length
        return (
            Piece(self.doc, self.start, length, self.quiet, self.total, self.ids[:length]),
            Piece(self.doc, start, left, self.quiet, self.total, self.ids[length:]),
        )


class Packer:
    """Open sequences of one partition; closed ones are lists of pieces."""

    def __init__(self, limits: Limits, keep_open: int = OPEN):
        self.most = np.array([limits.tokens, limits.segments, limits.loss_tokens])
        self.free = np.zeros((keep_open, 3), dtype=np.int64)
        self.held: list[list[Piece]] = [[] for _ in range(keep_open)]
        self.free[:] = self.most
        self.closed: list[list[Piece]] = []

    def fitting(self, piece: Piece, room: np.ndarray) -> int:
        """Leading ids of a piece that fit in `room`."""
        if room[1] < 1:
            return 0
        quiet = max(0, piece.quiet - piece.start)
        by_loss = piece.length if piece.loss() <= room[2] else quiet + int(room[2])
        return min(piece.length, int(room[0]), by_loss)

    def add(self, piece: Piece) -> None:
        while piece.length:
            need = np.array([piece.length, 1, piece.loss()])
            score = (self.free / self.most**2) @ need
            score[(self.free < need).any(axis=1)] = -1
            best = int(score.argmax())
            if score[best] < 0:
                # No sequence takes it whole: fill up the fullest one that takes any of it.
                takes = np.array([self.fitting(piece, room) for room in self.free])
                best = int(np.where(takes > 0, self.free[:, 0], np.iinfo(np.int64).max).argmin())
                head, piece = piece.split(int(takes[best]))
            else:
                head, piece = piece, piece.split(piece.length)[1]
            self.place(best, head)

    def place(self, at: int, piece: Piece) -> None:
        self.held[at].append(piece)
        self.free[at] -= [piece.length, 1, piece.loss()]
        if self.free[at, :2].min() < 1 or self.free[at, 2] < 1:
            self.closed.append(self.held[at])
            self.held[at], self.free[at] = [], self.most

    def finish(self) -> None:
        """Pack what is still open, tightly; the last sequences have a power of two of ids.

        Such lengths need no padding, so a remainder of 1,234 ids becomes sequences of
        1,024, 128, 64, 16 and 2.
        """
        rest = [p for pieces in self.held for p in pieces]
        left = sum(p.length for p in rest)
        room, size, pieces = self.most.copy(), 0, []
        for piece in rest:
            while piece.length:
                if not pieces:
                    size = min(int(self.most[0]), 1 << left.bit_length() - 1)
                    room = np.array([size, *self.most[1:]])
                head, piece = piece.split(self.fitting(piece, room))
                pieces.append(head)
                left -= head.length
                room -= [head.length, 1, head.loss()]
                if room[:2].min() < 1 or room[2] < 1:
                    self.closed.append(pieces)
                    pieces = []
        if pieces:
            self.closed.append(pieces)


def pack(
    docs: DataFrame,
    path: str,
    limits: Limits = Limits(),
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    quiet_col: str | None = None,
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) per piece.

    The ids of a text are those of the tokenizers file at `path`, then `end_id`. Each id is
    in exactly one piece; `ids` holds a piece's ids as little-endian 32-bit numbers.
    `quiet_col` names the count of leading ids that bear no loss (a prompt), else all bear
    it. Sequences are full, or a power of two long, unless their segments or loss-bearing
    tokens ran out first. sequence_id numbers them inside each partition.

    A null text is empty and is packed as its end id alone; null or repeated ids are carried
    through row by row; an empty table gives no pieces; other columns are ignored. A text of
    any length is cut as needed; only open sequences are held besides one batch.
    """
    quiet = F.coalesce(F.col(quiet_col), F.lit(0)) if quiet_col else F.lit(0)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        quiet.cast("long").alias("quiet"),
    )
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(limits), TaskContext.get().partitionId() << 40

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = []
            for pieces in packer.closed:
                offset = 0
                for p in pieces:
                    ids = p.ids.tobytes()
                    rows.append((p.doc, p.start, p.length, p.total, number, offset, ids))
                    offset += p.length
                number += 1
            packer.closed = []
            if rows:
                types = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
                )

        coder = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                docs, starts = batch["doc_id"].to_pylist(), batch["quiet"].to_pylist()
                ids, ends = coder.encode_column(batch["text"], end_id)
                ids, first = ids.astype("<u4"), 0
                for doc, quiet, past in zip(docs, starts, ends.tolist()):
                    count = past - first
                    # A copy, so that an open piece does not hold the ids of its whole batch.
                    packer.add(Piece(doc, 0, count, quiet, count, ids[first:past].copy()))
                    first = past
                    if len(packer.closed) >= 256:
                        yield from closed()
        packer.finish()
        yield from closed()

    return rows.mapInArrow(
        packed,
        "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, ids binary",
    )
