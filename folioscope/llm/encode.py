"""Token ids by byte-level pair merging, with a memory of words; equal to the tokenizers library.

Both kinds of public vocabulary files used here treat the words of a text independently if
the text is cut before single spaces. The ids of all words seen lie in one flat array; a batch
of texts becomes one list of word numbers and its ids one gather from that array. Words that
are new to a worker are cut into pre-tokens, whose pairs are merged in all of them at once;
whatever is not plain Latin goes through the library. The memory is bounded: it is emptied
when full, which costs time only.

A column of plain Latin texts never becomes Python strings: its pre-tokens are cut in the bytes of
the whole batch, of files for words after lower-casing them in place, and looked up by their bytes
in a table of numpy arrays.
"""

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from folioscope.llm.token_counts import PRE_TOKENS, beside_blank, byte_alphabet

#: Words and parts of words remembered by a worker.
MEMORY = 700_000
#: Up to here letters, case and composition are the same in all versions of Unicode.
LATIN_END = "ɐ"
#: Marks that often end a word; one or more of them are one pre-token in both kinds of files.
TAILS = ".,;:!?)"
NEVER = np.iinfo(np.int64).max
MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = -1

# Classes of characters, by byte or by the bytes of two-byte letters and signs.
STRANGE, SPACE, BLANK, LETTER, DIGIT, SIGN = range(6)


def byte_classes() -> np.ndarray:
    """Class of each byte; strange are those that the cut by bytes does not know."""
    table = np.full(256, STRANGE, dtype=np.uint8)
    for byte in range(33, 127):
        char = chr(byte)
        table[byte] = LETTER if char.isalpha() else DIGIT if char.isdigit() else SIGN
    table[32], table[[9, 10, 13]] = SPACE, BLANK
    # U+0080 to U+023F; what follows a first byte is set with it.
    table[0xC2:0xC9] = LETTER
    table[0x80:0xC0] = LETTER
    return table


CLASSES = byte_classes()
#: Classes of U+0080 to U+00FF by the last byte, for the first bytes C2 and C3.
SIGNS_C2 = np.full(256, SIGN, dtype=np.uint8)
SIGNS_C2[[0xAA, 0xB5, 0xBA]] = LETTER
SIGNS_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = DIGIT
SIGNS_C2[0x80:0xA1] = STRANGE
#: What files for words do to a text, and how they cut it; blanks are in no pre-token.
WORD_STEPS = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of a pre-token that are a key; longer ones are known by a dictionary.
KEY_WORDS = 3
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def lower_case() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both bytes of each two-byte letter in lower case, by code point, and which have other sizes."""
    lower = [chr(code).lower().encode() for code in range(0x240)]
    fits = np.array([len(x) == 2 for x in lower])
    pairs = np.array([tuple(x) if len(x) == 2 else (0, 0) for x in lower], dtype=np.uint8)
    return pairs[:, 0], pairs[:, 1], fits


LOWER_BYTES = np.frombuffer(bytes(range(256)).lower(), np.uint8)
LOWER_FIRST, LOWER_LAST, LOWER_FITS = lower_case()


class Merges:
    """The pair merges of a vocabulary file, applied to many byte strings at once."""

    def __init__(self, model: dict):
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        results = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.table(left << 32 | right, results)
        self.inner = np.array([ids[c] for c in byte_alphabet()], dtype=np.int64)
        self.final = np.array([ids[c + suffix] for c in byte_alphabet()], dtype=np.int64)

    def table(self, keys: np.ndarray, results: np.ndarray) -> None:
        """A hash table of the pairs with free slots between them: key, rank, merged symbol."""
        self.shift = np.uint64(64 - max(4, len(keys).bit_length() + 2))
        size = 1 << 64 - int(self.shift)
        self.keys = np.full(size + len(keys), -1, dtype=np.int64)
        self.ranks = np.full(len(self.keys), NEVER, dtype=np.int64)
        self.results = np.zeros(len(self.keys), dtype=np.int64)
        waiting, slots = np.arange(len(keys)), self.slots(keys)
        while len(waiting):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[waiting[free]]
            placed = self.keys[slots] == keys[waiting]
            self.ranks[slots[placed]] = waiting[placed]
            self.results[slots[placed]] = results[waiting[placed]]
            waiting, slots = waiting[~placed], slots[~placed] + 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * MIX >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each pair, or a free one."""
        slots = self.slots(keys)
        held = self.keys[slots]
        other = np.flatnonzero((held != keys) & (held >= 0))
        while len(other):
            slots[other] += 1
            held = self.keys[slots[other]]
            other = other[(held != keys[other]) & (held >= 0)]
        return slots

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, count of ids of each); words are not empty."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        return self.merge_bytes(np.frombuffer(b"".join(words), np.uint8), sizes)

    def merge_bytes(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of the given sizes that stand one after the other in `raw`.

        Each round applies every word's lowest-rank pair wherever it stands in the word.
        """
        symbols, ends = self.inner[raw], np.cumsum(sizes)
        symbols[ends - 1] = self.final[raw[ends - 1]]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.zeros(len(sizes), dtype=np.int64)
        done_symbols, done_owners = [], []
        while len(symbols):
            keys = symbols[:-1] << 32 | symbols[1:]
            found = self.find(keys)
            ranks = np.append(self.ranks[found], NEVER)
            ranks[:-1][owner[:-1] != owner[1:]] = NEVER
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(starts, len(symbols)))
            lowest = np.minimum.reduceat(ranks, starts)
            ready = lowest == NEVER
            if ready.any():
                counts[owner[starts[ready]]] = lengths[ready]
                over = np.repeat(ready, lengths)
                done_symbols.append(symbols[over])
                done_owners.append(owner[over])
            chosen = np.flatnonzero((ranks == np.repeat(lowest, lengths)) & (ranks != NEVER))
            if not len(chosen):
                break
            # In a run such as a-a-a the pairs overlap: take every second one from its left.
            place = np.arange(len(chosen))
            first = np.maximum.accumulate(np.where(np.append(True, np.diff(chosen) != 1), place, 0))
            chosen = chosen[(place - first) % 2 == 0]
            symbols[chosen] = self.results[found[chosen]]
            stay = np.repeat(~ready, lengths)
            stay[chosen + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        if not done_symbols:
            return np.zeros(0, dtype=np.uint32), counts
        order = np.argsort(np.concatenate(done_owners), kind="stable")
        return np.concatenate(done_symbols)[order].astype(np.uint32), counts


class Memory:
    """Runs of ids in one flat array, by number."""

    def __init__(self):
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.counts = np.zeros(1 << 14, dtype=np.int64)
        self.used = self.size = 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Append runs; the number of the first."""
        first, past, used = self.size, self.size + len(counts), self.used + len(ids)
        while past > len(self.starts):
            self.starts = np.append(self.starts, np.zeros_like(self.starts))
            self.counts = np.append(self.counts, np.zeros_like(self.counts))
        while used > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.used : used] = ids
        self.counts[first:past] = counts
        self.starts[first:past] = self.used + np.cumsum(counts) - counts
        self.size, self.used = past, used
        return first

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the runs `numbers`, one after the other, count of each)."""
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[numbers] - (ends - counts), counts)
        return self.ids[at], counts


class Table:
    """Numbers of short byte strings, which are keys of whole 64-bit words; no lookup can err."""

    def __init__(self, most: int):
        bits = max(8, most.bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros((KEY_WORDS, 1 << bits), dtype=np.uint64)
        self.numbers = np.full(1 << bits, -1, dtype=np.int32)
        self.claims = np.zeros(1 << bits, dtype=np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[0] * MIX
        for part in keys[1:]:
            mixed ^= mixed >> np.uint64(32)
            mixed = (mixed ^ part) * MIX
        return (mixed >> self.shift).astype(np.int64)

    def held(self, slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        same = self.numbers[slots] >= 0
        for held, part in zip(self.keys, keys):
            same &= held[slots] == part
        return same

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each key or -1, its slot or a free one)."""
        slots = self.slots(keys)
        numbers = self.numbers[slots]
        other = np.flatnonzero(~self.held(slots, keys) & (numbers >= 0))
        while len(other):
            slots[other] = slots[other] + 1 & self.mask
            numbers[other] = self.numbers[slots[other]]
            other = other[~self.held(slots[other], keys[:, other]) & (numbers[other] >= 0)]
        return numbers.astype(np.int64), slots

    def add(self, keys: np.ndarray, slots: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Number absent keys from `first` on, equal ones alike: (number of each, row of each new
        number). `slots` are the free ones that find() gave."""
        numbers, rows = np.zeros(len(slots), dtype=np.int64), np.arange(len(slots))
        fresh = [rows[:0]]
        while len(rows):
            free = np.flatnonzero(self.numbers[slots] < 0)
            self.claims[slots[free]] = rows[free]
            free = free[self.claims[slots[free]] == rows[free]]
            new, taken = rows[free], slots[free]
            self.keys[:, taken] = keys[:, new]
            self.numbers[taken] = first + np.arange(len(new))
            first += len(new)
            fresh.append(new)
            same = self.held(slots, keys[:, rows])
            numbers[rows[same]] = self.numbers[slots[same]]
            rows, slots = rows[~same], slots[~same] + 1 & self.mask
        return numbers, np.concatenate(fresh)


class Encoder:
    """Encodes texts to ids, without added begin or end tokens."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"] or {}
        steps = before.get("pretokenizers", [before])
        self.marks = {x["content"][:2] for x in spec["added_tokens"]}
        self.by_word = spec["normalizer"] is not None and steps[0].get("type") == "Split"
        self.by_byte = spec["normalizer"] is None and steps[0].get("type") == "ByteLevel"
        self.added = [x["content"].encode() for x in spec["added_tokens"]]
        if self.by_word:
            self.by_column = (
                [x["type"] for x in spec["normalizer"].get("normalizers", [])] == WORD_STEPS
                and steps[0]["pattern"].get("Regex") == WORD_PATTERN
            )
        else:
            self.by_column = self.by_byte and before == steps[0] and not before["add_prefix_space"]
        self.cut = regex.compile(steps[0]["pattern"]["Regex"] if self.by_word else PRE_TOKENS)
        self.merges = Merges(spec["model"]) if self.by_word or self.by_byte else None
        self.forget()

    def forget(self) -> None:
        self.memory = Memory()
        #: Numbers of words as they stand between spaces; behind a space, of the first of a text.
        self.words: dict[str, int] = {}
        #: Numbers of pre-tokens without a space before them.
        self.parts: dict[str, int] = {}
        #: The memory of columns: short pre-tokens, long ones, and their ids.
        self.table: Table | None = None
        self.long: dict[bytes, int] = {}
        self.column_memory = Memory()

    def library(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts by the library."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint32) for x in found]

    def learn(self, words: list[str]) -> None:
        """Give numbers to new words."""
        known, parts, size = self.words, self.parts, self.memory.size
        lower, blank = self.by_word, " " * self.by_byte
        fresh: list[str] = []
        # Words of several pre-tokens, the numbers of these, how many each has.
        joined, numbers, sizes = [], [], []
        foreign: list[tuple[str, str]] = []

        def number(part: str, among: dict[str, int], spelled: str) -> int:
            found = among.get(part)
            if found is None:
                found = among[part] = size + len(fresh)
                fresh.append(spelled)
            return found

        for word in words:
            if word[:1] == " ":
                text, lead, alike = word[1:], "", parts
            else:
                text, lead, alike = word, blank, known
            latin = text.isascii() or max(text) < LATIN_END
            if latin and lower:
                text = text.lower()
            if latin and text.isalpha():
                known[word] = number(text, alike, lead + text)
                continue
            core = text.rstrip(TAILS)
            if latin and core.isalpha():
                tail = text[len(core) :]
                found = [number(core, alike, lead + core), number(tail, parts, tail)]
            elif lead and beside_blank(text):
                known[word] = ODD
                continue
            elif not latin or any(mark in text for mark in self.marks):
                foreign.append((word, lead + text))
                continue
            else:
                found = [number(x, parts, x) for x in self.cut.findall(lead + text)]
            joined.append(word)
            numbers += found
            sizes.append(len(found))
        if fresh:
            self.memory.add(*self.merges.merge([x.encode() for x in fresh]))
        if joined:
            ids, counts = self.memory.gather(np.array(numbers, dtype=np.int64))
            ends = np.append(0, np.cumsum(counts))[np.cumsum([0, *sizes])]
            first = self.memory.add(ids, np.diff(ends))
            known.update(zip(joined, range(first, first + len(joined))))
        if foreign:
            runs = self.library([text for _, text in foreign])
            first = self.memory.add(np.concatenate(runs), np.array([len(x) for x in runs]))
            known.update((w, first + k) for k, (w, _) in enumerate(foreign))

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other, each closed by `end_id`; where each ends)."""
        close = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        if not (self.by_word or self.by_byte):
            return joined_runs(self.library(texts), close)
        cut = [text.split(" ") for text in texts]
        odd = []
        if self.by_byte:
            for k, words in enumerate(cut):
                if len(words) > 1 and beside_blank(words[0]):
                    odd.append(k)
                words[0] = " " + words[0]
        words = list(chain.from_iterable(cut))
        found = list(map(self.words.get, words))
        if self.memory.size > MEMORY:
            self.forget()
            found = [None] * len(words)
        missing = [k for k, n in enumerate(found) if n is None]
        if missing:
            self.learn(list(dict.fromkeys([words[k] for k in missing])))
            for k in missing:
                found[k] = self.words[words[k]]
        numbers = np.array(found, dtype=np.int64)
        ends = np.cumsum([len(w) for w in cut])
        # Text k is odd if a number below zero is among its own.
        strange = np.unique(np.searchsorted(ends, np.flatnonzero(numbers == ODD), side="right"))
        odd = sorted({*odd, *strange.tolist()})
        numbers[numbers == ODD] = 0
        ids, counts = self.memory.gather(numbers) if self.memory.size else (close[:0], numbers * 0)
        ends = np.append(0, np.cumsum(counts))[np.append(0, ends)]
        if not odd:
            past = ends[1:]
            closed = np.insert(ids, np.repeat(past, len(close)), np.tile(close, len(texts)))
            return closed, past + len(close) * np.arange(1, len(texts) + 1)
        runs = [ids[a:b] for a, b in zip(ends, ends[1:])]
        for k, run in zip(odd, self.library([texts[k] for k in odd])):
            runs[k] = run
        return joined_runs(runs, close)

    def encode_column(
        self, texts: pa.Array, end_id: int | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The same as encode() for a column of texts; null is empty."""
        if not len(texts):
            return joined_runs([], np.zeros(0, dtype=np.uint32))
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_column:
            return self.encode(texts.to_pylist(), end_id)
        data, edges = bytes_of(texts)
        classes = classes_of(data)
        if self.by_word:
            classes[no_lower_case(data)] = STRANGE
        strange = np.flatnonzero(classes == STRANGE)
        odd = set((np.searchsorted(edges, strange, side="right") - 1).tolist())
        raw = data.tobytes()
        if any(mark in raw for mark in self.added):
            several = [raw[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist())]
            odd |= {k for k, t in enumerate(several) if any(mark in t for mark in self.added)}
        odd = np.array(sorted(odd), dtype=np.int64)
        if len(odd):
            # Only what the cut by bytes knows may become a key.
            stays = np.ones(len(texts), dtype=bool)
            stays[odd] = False
            data, edges = bytes_of(pc.if_else(pa.array(stays), texts, ""))
            classes = classes_of(data)
        if self.by_word:
            data, starts, edges = words_of(data, classes, edges)
        else:
            starts = pre_token_starts(data, classes, edges)
        ids, counts = self.ids_of(data, starts)
        past = np.append(0, np.cumsum(counts))[np.searchsorted(starts, edges)]
        close = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        if not len(odd):
            closed = np.insert(ids, np.repeat(past[1:], len(close)), np.tile(close, len(texts)))
            return closed, past[1:] + len(close) * np.arange(1, len(texts) + 1)
        runs = [ids[a:b] for a, b in zip(past, past[1:])]
        others, ends = self.encode(texts.take(pa.array(odd)).to_pylist())
        for k, a, b in zip(odd, [0, *ends], ends):
            runs[k] = others[a:b]
        return joined_runs(runs, close)

    def ids_of(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each) of the pre-tokens that start at `starts` and fill `data`."""
        if self.table is None or self.column_memory.size > MEMORY:
            self.table, self.long, self.column_memory = Table(2 * MEMORY), {}, Memory()
        sizes = np.diff(np.append(starts, len(data)))
        keys = keys_of(data, starts, sizes)
        numbers, slots = self.table.find(keys)
        is_long = np.flatnonzero(sizes > 8 * KEY_WORDS)
        numbers[is_long] = 0
        absent = np.flatnonzero(numbers < 0)
        # A batch of very many new pre-tokens is taken in parts, so that the table never fills.
        if self.column_memory.size + len(absent) + len(is_long) > 2 * MEMORY and len(starts) > 1:
            half = len(starts) // 2
            at = starts[half]
            parts = self.ids_of(data[:at], starts[:half]), self.ids_of(data[at:], starts[half:] - at)
            return tuple(np.concatenate(x) for x in zip(*parts))
        if len(absent):
            found, fresh = self.table.add(keys[:, absent], slots[absent], self.column_memory.size)
            numbers[absent] = found
            fresh = absent[fresh]
            spelled = spread(data, starts[fresh], sizes[fresh])
            self.column_memory.add(*self.merges.merge_bytes(spelled, sizes[fresh]))
        if len(is_long):
            ends = starts[is_long] + sizes[is_long]
            words = [data[a:b].tobytes() for a, b in zip(starts[is_long], ends)]
            new = [w for w in dict.fromkeys(words) if w not in self.long]
            if new:
                first = self.column_memory.add(*self.merges.merge(new))
                self.long.update(zip(new, range(first, first + len(new))))
            numbers[is_long] = [self.long[w] for w in words]
        return self.column_memory.gather(numbers)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each starts and the last ends) of large strings without nulls."""
    _, offsets, held = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8) if held else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def classes_of(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    classes = CLASSES[data]
    first = np.flatnonzero((data >= 0xC2) & (data <= 0xC8))
    last = data[first + 1]
    found = np.where(data[first] == 0xC2, SIGNS_C2[last], np.uint8(LETTER))
    found[(data[first] == 0xC3) & ((last == 0x97) | (last == 0xB7))] = SIGN
    classes[first] = classes[first + 1] = found
    return classes


def pre_token_starts(data: np.ndarray, classes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where PRE_TOKENS cuts the texts that lie in `data` between `edges`.

    A space belongs to the word behind it. Of several blanks before a word the last stands
    alone, or is that space; the others, like all at the end of a text, are one pre-token.
    """
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    text = np.zeros(len(data) + 1, dtype=bool)
    text[edges] = True
    blank = (classes == SPACE) | (classes == BLANK)
    before = np.append(np.uint8(STRANGE), classes[:-1])
    start = (before != classes) & ((before != SPACE) | blank) & ~(blank & np.append(False, blank[:-1]))
    # The last blank before a word.
    start[:-1] |= blank[:-1] & ~blank[1:] & ~text[1:-1]
    start |= text[:-1]
    # The quote of 's and the like is not part of a longer run or behind a space.
    cut_endings(data, classes, text, start)
    return np.flatnonzero(start)


def words_of(
    data: np.ndarray, classes: np.ndarray, edges: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case without blanks, where WORD_PATTERN cuts them, where each text starts)."""
    if not len(data):
        return data, np.zeros(0, dtype=np.int64), edges
    data = lowered(data)
    text = np.zeros(len(data) + 1, dtype=bool)
    text[edges] = True
    filled = (classes != SPACE) & (classes != BLANK)
    start = np.append(True, classes[1:] != classes[:-1]) | text[:-1]
    # Each digit is a pre-token; the last byte of a two-byte one is none.
    start |= (classes == DIGIT) & ((data < 0x80) | (data >= 0xC0))
    start &= filled
    cut_endings(data, classes, text, start)
    start &= filled
    before = np.append(0, np.cumsum(filled))
    return data[filled], before[np.flatnonzero(start)], before[edges]


def two_byte_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where two-byte characters up to U+023F start, their code points)."""
    first = np.flatnonzero((data >= 0xC2) & (data <= 0xC8))
    return first, (data[first].astype(np.int64) & 0x1F) << 6 | data[first + 1] & 0x3F


def no_lower_case(data: np.ndarray) -> np.ndarray:
    """Where a character starts whose lower case has another number of bytes."""
    first, codes = two_byte_codes(data)
    return first[~LOWER_FITS[codes]]


def lowered(data: np.ndarray) -> np.ndarray:
    found = LOWER_BYTES[data]
    first, codes = two_byte_codes(data)
    found[first], found[first + 1] = LOWER_FIRST[codes], LOWER_LAST[codes]
    return found


def cut_endings(
    data: np.ndarray, classes: np.ndarray, text: np.ndarray, start: np.ndarray
) -> None:
    """Make 's and the like pre-tokens, where the quote starts one already."""
    quote = np.flatnonzero((data[:-1] == 39) & start[:-1] & (classes[1:] == LETTER))
    quote = quote[~text[quote + 1]]
    if len(quote):
        one = data[quote + 1]
        two = data[np.minimum(quote + 2, len(data) - 1)]
        two[text[quote + 2]] = 0
        short = np.isin(one, list(b"stmd"))
        longer = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
        longer |= (one == ord("l")) & (two == ord("l"))
        taken = quote[short | longer]
        past = taken + np.where(short, 2, 3)[short | longer]
        start[taken + 1] = False
        start[past[past < len(data)]] = True


def keys_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first bytes of each pre-token as whole words, zeros behind its end."""
    padded = np.append(data, np.zeros(8 * KEY_WORDS, dtype=np.uint8))
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    keys = np.zeros((KEY_WORDS, len(starts)), dtype=np.uint64)
    keys[0] = words[starts] & FIRST_BYTES[np.minimum(sizes, 8)]
    for k in range(1, KEY_WORDS):
        more = np.flatnonzero(sizes > 8 * k)
        keys[k, more] = words[starts[more] + 8 * k] & FIRST_BYTES[np.minimum(sizes[more] - 8 * k, 8)]
    return keys


def spread(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of the given runs, one after the other."""
    ends = np.cumsum(sizes)
    return data[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)]


def joined_runs(runs: list[np.ndarray], close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids, each with `close` behind it, in one array; where each ends."""
    closed = [np.append(run, close) for run in runs]
    ids = np.concatenate(closed) if closed else np.zeros(0, dtype=np.uint32)
    return ids.astype(np.uint32), np.cumsum([len(x) for x in closed], dtype=np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
