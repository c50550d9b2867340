"""Token counts by rank-synchronous merging of ragged numpy arrays.

The byte-level BPE is read from its published vocabulary file. New pre-tokens of a batch
become one flat array of symbols; in each round every unfinished sequence applies its own
lowest-rank pair, at all places at once. The symbols that survive are the tokens.
"""

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the byte-level BPE: how it cuts a text into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that stand for themselves in the vocabulary; the others follow 255.
PRINTABLE = ((33, 126), (161, 172), (174, 255))
NEVER = np.iinfo(np.int32).max
#: Pieces remembered by a Python worker; when full, it starts anew (results are the same).
MEMORY = 700_000


def byte_alphabet() -> list[str]:
    """The vocabulary's character for each byte."""
    own = {b for low, high in PRINTABLE for b in range(low, high + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Merger:
    """Counts the tokens of byte strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        order = np.argsort(left << 32 | right)
        self.keys = (left << 32 | right)[order]
        self.ranks = order.astype(np.int32)
        self.results = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)[order]
        self.first = np.array([ids[c] for c in byte_alphabet()], dtype=np.int64)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cut_special = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")
        self.cut = regex.compile(PRE_TOKENS)
        self.memory: dict[str, int] = {}

    def merge(self, sequences: list[bytes]) -> np.ndarray:
        """Tokens in each (non-empty) byte sequence."""
        counts = np.zeros(len(sequences), dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(sequences), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
        while len(symbols):
            keys = symbols[:-1] << 32 | symbols[1:]
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = (self.keys[found] == keys) & (owner[:-1] == owner[1:])
            ranks = np.append(np.where(known, self.ranks[found], NEVER), NEVER)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(starts, len(symbols)))
            lowest = np.minimum.reduceat(ranks, starts)
            done = lowest == NEVER
            counts[owner[starts[done]]] = lengths[done]
            chosen = np.flatnonzero((ranks == np.repeat(lowest, lengths)) & (ranks != NEVER))
            # In a run such as a-a-a the pairs overlap: take every second one from its left.
            run = np.append(True, np.diff(chosen) != 1) if len(chosen) else np.zeros(0, bool)
            place = np.arange(len(chosen))
            chosen = chosen[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            symbols[chosen] = self.results[found[chosen]]
            stay = np.repeat(~done, lengths)
            stay[chosen + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return counts

    def measure(self, texts: list[str]) -> list[int]:
        """Tokens of each text, without any memory."""
        parts: list[str] = []
        ends, extra = [], []
        for text in texts:
            special = len(self.cut_special.findall(text)) if self.special else 0
            for piece in self.cut_special.split(text) if special else (text,):
                parts += self.cut.findall(piece)
            ends.append(len(parts))
            extra.append(special)
        new = list(dict.fromkeys(parts))
        tokens = dict(zip(new, self.merge([p.encode() for p in new]).tolist()))
        sums = np.concatenate([[0], np.cumsum([tokens[p] for p in parts], dtype=np.int64)])
        ends = np.array(ends, dtype=np.int64)
        return (sums[ends] - sums[np.append(0, ends)[:-1]] + np.array(extra, np.int64)).tolist()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text.

        No pre-token crosses a place before a single space between two visible characters,
        so the words cut there are counted (each with its space) once and remembered.
        """
        cut = [text.split(" ") for text in texts]
        new = {w for ws in cut for w in ws[1:] if w not in self.memory}
        if len(self.memory) + len(new) > MEMORY:
            self.memory.clear()
            new = {w for ws in cut for w in ws[1:]}
        new = list(new)
        for word, n in zip(new, self.measure([" " + w for w in new])):
            self.memory[word] = ODD if beside_blank(word) else n
        heads = self.measure([ws[0] for ws in cut])
        totals = []
        for ws, head in zip(cut, heads):
            if len(ws) > 1:
                ws[0], first = "", ws[0]
                head += sum(map(self.memory.__getitem__, ws[1:]))
                head = ODD if beside_blank(first) else head
            totals.append(head)
        odd = [i for i, n in enumerate(totals) if n < 0]
        for i, n in zip(odd, self.measure([texts[i] for i in odd])):
            totals[i] = n
        return totals


#: Marks a word next to further white space, where a text can't be cut; any sum with it is negative.
ODD = -(1 << 60)


def beside_blank(word: str) -> bool:
    return not word or word[0].isspace() or word[-1].isspace()


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def portions(texts: list[str], size: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of whole texts of about `size` characters, to bound what is held as words."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text by the vocabulary file at `path`, which every executor can read."""

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = merger(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.to_pylist()]
            counts = [n for part in portions(texts) for n in counter.count(part)]
            yield pa.array(counts, type=pa.int64())

    return count(text)


def count_tokens(
    docs: DataFrame,
    path: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of `docs`, without a shuffle.

    Special strings inside a text count as one token each. A null text counts as empty (no
    bytes, no tokens); null or repeated ids are carried through row by row; an empty table
    gives an empty result and other columns are ignored. Texts are counted whole: one
    pre-token of n bytes costs n for each rank that occurs in it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        token_count(text, path).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
