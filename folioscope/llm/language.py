"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed to a fixed number of buckets. Document
frequencies are counted over all training texts. The weights are learned by
follow-the-regularised-leader with L1 and L2 penalties on a bounded sample, and the scores are
calibrated by one temperature on a held-back fifth of it.
"""

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = 32
CHUNK = 1 << 19
#: Frequencies of single n-grams are small numbers; this brings an example's length to about one.
SCALE = 16.0
MIX = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"
#: N-grams seen in training texts are remembered under hashes of so many bits.
SEEN_BITS = 24
#: Counts of up to so many labels are sent to all tasks.
SENT_LABELS = 10_000
#: A text of which a smaller share of n-grams was ever seen is in none of the learned languages.
LEAST_SEEN = 0.5


@dataclass(frozen=True)
class Training:
    """Size of the model and of the sample it is fitted on, and the learner's parameters.

    At most `sample_rows` labelled documents, about as many of each label, are used to fit
    weights and temperature; document frequencies come from all training documents.
    """

    bucket_bits: int = 16
    sample_rows: int = 3200
    epochs: int = 3
    rate: float = 0.3
    smoothing: float = 1.0
    l1: float = 0.02
    l2: float = 0.02


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters or marks."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def buckets(text: str, bits: int) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a whole text, in stretches; everything but letters is a space."""
    shift = np.uint64(64 - bits)
    for start in range(0, len(text), CHUNK):
        # A stretch begins two characters early, so that no n-gram is lost between stretches.
        early = min(start, 2)
        part = text[start - early : start + CHUNK].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.where(letters()[codes], codes, SPACE)
        codes = codes[(codes != SPACE) | (np.append(SPACE, codes[:-1]) != SPACE)]
        one = (codes.astype(np.uint64) + np.uint64(1)) * MIX
        two = (one[:-1] ^ codes[1:].astype(np.uint64)) * MIX if len(one) > 1 else one[:0]
        three = (two[:-1] ^ codes[2:].astype(np.uint64)) * MIX if len(two) > 1 else one[:0]
        yield (np.concatenate([one, two, three]) >> shift).astype(np.int64)


def bucket_counts(text: str, bits: int) -> np.ndarray:
    total = np.zeros(1 << bits, dtype=np.int64)
    for stretch in buckets(text, bits):
        total += np.bincount(stretch, minlength=1 << bits)
    return total


class Model:
    """Weights per bucket and label (with the inverse document frequency inside)."""

    def __init__(self, labels: list[str], weights: np.ndarray, bias: np.ndarray, heat: float):
        self.labels, self.weights, self.bias, self.heat = labels, weights, bias, heat

    def predict(self, text: str | None, bits: int) -> tuple[str, float]:
        if not text or not self.labels or not has_letter(text):
            return UNKNOWN, 0.0
        total, count = self.bias * 0, 0
        for stretch in buckets(text, bits):
            total = total + self.weights[stretch].sum(axis=0, dtype=np.float64)
            count += len(stretch)
        shares = softmax((total / count + self.bias) / self.heat)
        best = int(shares.argmax())
        return self.labels[best], float(shares[best])


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max())
    return raised / raised.sum()


def document_frequencies(texts: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """(documents, documents per bucket) of all rows of (text); a line per bucket is collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) + 1, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                seen = np.zeros((1 << bits) + 1, dtype=bool)
                for stretch in buckets(text.as_py() or "", bits):
                    seen[stretch] = True
                seen[-1] = True
                total += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = (
        texts.select("text")
        .mapInArrow(count, "bucket bigint, n bigint")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    found = np.zeros((1 << bits) + 1, dtype=np.int64)
    found[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return int(found[-1]), found[:-1]


def sample(docs: DataFrame, how: Training) -> pa.Table:
    """(lang, place, buckets, counts) of at most `sample_rows` of the rows (doc_id, text, lang).

    Of each label the ids with the smallest hashes are taken. Hashes above a bound that leaves
    a label many more than that are dropped before any are ranked, so that a label that most
    rows have meets in no single task. With more labels than `sample_rows`, the smallest hashes
    of all labels count.
    """
    counts = docs.groupBy("lang").agg(F.count("*").alias("rows"))
    labels = max(1, counts.count())
    most = max(1, how.sample_rows // labels)
    # Of n evenly spread hashes about `spare` are below the bound; less than `most` never.
    spare = most + 10 * most**0.5 + 30
    spread = F.xxhash64("doc_id").alias("place")
    low = (F.col("place") / 2.0**64 + 0.5) * F.col("rows") <= spare
    # Labels are counted, so a small table of them is sent rather than rows dealt by label.
    sent = F.broadcast(counts) if labels <= SENT_LABELS else counts
    placed = docs.select("doc_id", "lang", spread).join(sent, "lang").where(low)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    chosen = (
        placed.withColumn("nth", nth)
        .where(F.col("nth") <= most)
        .select("doc_id", "place")
        .distinct()
        .orderBy("place", "doc_id")
        .limit(how.sample_rows)
        .select("doc_id")
    )
    place = F.xxhash64("doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for text in batch["text"]:
                total = bucket_counts(text.as_py() or "", how.bucket_bits)
                found.append(np.flatnonzero(total))
                sizes.append(total[found[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch["lang"], batch["place"], pa.array(found, INTS), pa.array(sizes, INTS)],
                ["lang", "place", "buckets", "counts"],
            )

    # Bounded by the parameter `sample_rows`, so it may be broadcast and collected.
    return (
        docs.join(F.broadcast(chosen), "doc_id", "left_semi")
        .select("lang", place.alias("place"), "text")
        .mapInArrow(count, "lang string, place bigint, buckets array<int>, counts array<int>")
        .toArrow()
        .sort_by([("place", "ascending")])
        .slice(0, how.sample_rows)
    )


INTS = pa.list_(pa.int32())


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null and lang is not null")


def train(docs: DataFrame, how: Training = Training()) -> Model:
    """Fit on rows (doc_id, text, lang); rows without text or lang teach nothing."""
    docs = learnable(docs)
    number, frequency = document_frequencies(docs, how.bucket_bits)
    idf = SCALE * (1 + np.log((1 + number) / (1 + frequency)))
    rows = sample(docs, how)
    labels = sorted(set(rows["lang"].to_pylist()))
    if not labels:
        return Model([], np.zeros((1, 0)), np.zeros(0), 1.0)
    examples = []
    for lang, found, counts in zip(*[rows[c].to_pylist() for c in ("lang", "buckets", "counts")]):
        if found:
            at, n = np.array(found), np.array(counts, dtype=np.float64)
            # The last input is a constant, for the label's bias.
            inputs = np.append(n / n.sum() * idf[at], 1.0)
            examples.append((np.append(at, 1 << how.bucket_bits), inputs, labels.index(lang)))
    back = [x for i, x in enumerate(examples) if i % 5 == 4]
    fitted = follow_the_leader([x for i, x in enumerate(examples) if i % 5 != 4], len(labels), how)
    heat = temperature([(x @ fitted[at], y) for at, x, y in back])
    weights = (fitted[:-1] * idf[:, None]).astype(np.float32)
    return Model(labels, weights, fitted[-1], heat)


def follow_the_leader(examples: list[tuple], labels: int, how: Training) -> np.ndarray:
    """Weights by FTRL-proximal steps; a weight stays zero until its evidence exceeds l1."""
    shape = ((1 << how.bucket_bits) + 1, labels)
    pull, squares = np.zeros(shape), np.zeros(shape)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        z = pull[at]
        steps = (how.smoothing + np.sqrt(squares[at])) / how.rate + how.l2
        return np.where(np.abs(z) <= how.l1, 0.0, (np.sign(z) * how.l1 - z) / steps)

    for _ in range(how.epochs):
        for at, inputs, label in examples:
            now = weights(at)
            wrong = softmax(inputs @ now)
            wrong[label] -= 1
            slope = inputs[:, None] * wrong[None, :]
            grown = squares[at] + slope**2
            pull[at] += slope - (np.sqrt(grown) - np.sqrt(squares[at])) / how.rate * now
            squares[at] = grown
    return weights(slice(None))


def temperature(scored: list[tuple[np.ndarray, int]]) -> float:
    """The divisor of the scores under which the held-back labels are most likely."""
    heats = np.exp(np.linspace(-4, 4, 161))
    loss = lambda heat: -sum(np.log(softmax(s / heat)[y] + 1e-12) for s, y in scored)
    return float(min(heats, key=loss)) if scored else 1.0


def predict(docs: DataFrame, model: Model, how: Training = Training()) -> DataFrame:
    """(doc_id, lang_pred, score) per row of (doc_id, text), without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t.as_py(), how.bucket_bits) for t in batch["text"]]
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        guess, "doc_id bigint, lang_pred string, score double"
    )


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by checksum of the id; never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(
    docs: DataFrame,
    how: Training = Training(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of `docs`.

    The model is learned from the rows that are not held out and have text, label and id.
    A text that is null or has no letter is `und` with score 0; so is every text if there
    is nothing to learn from. Of labels with equal scores the first in order is taken. Ids may
    repeat or be null, labels may be any strings, and other columns are never looked at.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.col(lang_col).alias("lang"),
    )
    model = train(rows.where(~held_out(F.col("doc_id"))), how)
    return predict(rows, model, how).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def seen_ngrams(texts: DataFrame) -> np.ndarray:
    """Which n-gram hashes occur in the rows of (text), as packed bits: always two megabytes."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SEEN_BITS, dtype=bool)
        for batch in batches:
            for text in batch["text"]:
                if has_letter(text.as_py()):
                    for stretch in buckets(text.as_py(), SEEN_BITS):
                        seen[stretch] = True
        packed = np.packbits(seen, bitorder="little").view(np.int64)
        used = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(packed[used])], ["word", "bits"])

    rows = (
        texts.select("text")
        .mapInArrow(mark, "word bigint, bits bigint")
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    found = np.zeros(1 << SEEN_BITS - 6, dtype=np.int64)
    found[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return found.view(np.uint8)


def seen_share(text: str, seen: np.ndarray) -> float:
    """Share of a text's n-grams that are in the packed bits `seen`."""
    known = count = 0
    for stretch in buckets(text, SEEN_BITS):
        known += int((seen[stretch >> 3] >> (stretch & 7).astype(np.uint8) & 1).sum())
        count += len(stretch)
    return known / count


def with_language(
    docs: DataFrame,
    how: Training = Training(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Rows of `docs` in a language that `identify` learns, with `lang_pred` and `lang_score`.

    The two are what `identify` returns for the row. A text without a letter goes, and so does
    one of whose n-grams less than LEAST_SEEN are in any training text: that share, unlike the
    score, does not depend on the number of labels. If there is nothing to learn from, every
    text with a letter stays, as `und` with score 0. Rows are judged one by one, whatever their
    ids; the model is learned, and held in memory, as `identify` does it.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.col(lang_col).alias("lang"),
    )
    training = rows.where(~held_out(F.col("doc_id")))
    seen = seen_ngrams(learnable(training))
    sent = docs.sparkSession.sparkContext.broadcast((train(training, how), seen, not seen.any()))

    @F.arrow_udf("lang_pred string, lang_score double, fits boolean")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, seen, nothing = sent.value
        for batch in batches:
            texts = [t.as_py() or "" for t in batch]
            found = [model.predict(t, how.bucket_bits) for t in texts]
            fits = [
                has_letter(t) and (nothing or seen_share(t, seen) >= LEAST_SEEN) for t in texts
            ]
            langs, scores = zip(*found) if found else ((), ())
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.bool_())],
                ["lang_pred", "lang_score", "fits"],
            )

    # Not rewritten into the filter, so that a text is judged once.
    verdict = judged.asNondeterministic()(F.col(text_col))
    kept = docs.withColumn("_verdict", verdict).where("_verdict.fits")
    added = {c: F.col("_verdict").getField(c) for c in ("lang_pred", "lang_score")}
    return kept.withColumns(added).drop("_verdict")
