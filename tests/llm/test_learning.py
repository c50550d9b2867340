"""The language learner against plain versions of its parts, and which rows it learns from."""

import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import language, warc
from folioscope.llm.shared import scratch_folder, table

SF = "/root/testdata/sf0.001"
BITS = 10
MASK = (1 << 64) - 1


def plain_buckets(text):
    """Buckets of the n-grams of a text, one after the other."""
    shown = [c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()]
    letters = [c for i, c in enumerate(shown) if c != " " or (i and shown[i - 1] != " ")]
    mix, out = int(language.MIX), []
    for size in (1, 2, 3):
        for i in range(len(letters) - size + 1):
            value = (ord(letters[i]) + 1) * mix & MASK
            for c in letters[i + 1 : i + size]:
                value = (value ^ ord(c)) * mix & MASK
            out.append(value >> 64 - BITS)
    return out


TEXTS = ["Ünder the  tree -- 12 ", "a", "", "!! ?", "日本語 text", "x" * 50, "Éá b\nc"]


def test_ngrams_and_document_frequencies(spark):
    for text in TEXTS:
        found = np.concatenate([np.zeros(0, np.int64), *language.buckets(text, BITS)])
        assert Counter(found.tolist()) == Counter(plain_buckets(text)), text
    rows = spark.createDataFrame([(t,) for t in TEXTS * 3], "text string").repartition(4)
    number, frequency = language.document_frequencies(rows, BITS)
    want = Counter(b for t in TEXTS * 3 for b in set(plain_buckets(t)))
    assert number == len(TEXTS) * 3
    assert {int(b): int(frequency[b]) for b in np.flatnonzero(frequency)} == dict(want)


def plain_steps(examples, labels, how):
    """FTRL-proximal with one weight at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, k):
        if abs(z[i, k]) <= how.l1:
            return 0.0
        sign = math.copysign(1.0, z[i, k])
        return (sign * how.l1 - z[i, k]) / ((how.smoothing + math.sqrt(n[i, k])) / how.rate + how.l2)

    for _ in range(how.epochs):
        for at, inputs, label in examples:
            now = {(i, k): weight(i, k) for i in at for k in range(labels)}
            scores = [sum(x * now[i, k] for i, x in zip(at, inputs)) for k in range(labels)]
            raised = [math.exp(s - max(scores)) for s in scores]
            for k in range(labels):
                wrong = raised[k] / sum(raised) - (k == label)
                for i, x in zip(at, inputs):
                    step = x * wrong
                    grown = n[i, k] + step**2
                    z[i, k] += step - (math.sqrt(grown) - math.sqrt(n[i, k])) / how.rate * now[i, k]
                    n[i, k] = grown
    return weight


def test_follow_the_leader_equals_plain_steps():
    draw = random.Random(1)
    how = language.Training(bucket_bits=4, epochs=3, l1=0.1)
    examples = []
    for _ in range(40):
        at = np.array(sorted(draw.sample(range(16), 5)) + [16])
        inputs = np.array([draw.random() for _ in range(5)] + [1.0])
        examples.append((at, inputs, int(at[0]) % 3))
    found, weight = language.follow_the_leader(examples, 3, how), plain_steps(examples, 3, how)
    want = np.array([[weight(i, k) for k in range(3)] for i in range(17)])
    assert np.allclose(found, want, atol=1e-12)
    assert (want == 0).any() and (want != 0).any()  # the first penalty leaves some out


def test_temperature_is_the_most_likely_one():
    draw = random.Random(2)
    scored = [(np.array([draw.gauss(0, 3) for _ in range(4)]), draw.randrange(4)) for _ in range(200)]

    def loss(heat):
        total = 0.0
        for scores, label in scored:
            top = max(scores)
            total -= (scores[label] - top) / heat - math.log(sum(math.exp((s - top) / heat) for s in scores))
        return total

    found = language.temperature(scored)
    near = [found * f for f in (0.9, 0.97, 1.03, 1.1)]
    assert all(loss(found) <= loss(heat) + 1e-9 for heat in near)
    assert language.temperature([]) == 1.0


def test_the_sample_does_not_depend_on_the_partitions(spark):
    """One label with most rows, then more labels than rows of the sample."""
    many = [(i, f"text {i}", "big") for i in range(900)] + [(1000 + i, "few", "small") for i in range(9)]
    labels = [(i, "text", f"label{i}") for i in range(60)]
    for rows, how in ((many, language.Training(sample_rows=100)), (labels, language.Training(sample_rows=20))):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        places = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("p")).orderBy("p").collect()
        most, taken, want = max(1, how.sample_rows // len({r[2] for r in rows})), Counter(), []
        for x in places:
            taken[x.lang] += 1
            if taken[x.lang] <= most:
                want.append(x.p)
        for parts in (1, 7):
            found = language.sample(docs.repartition(parts), how)
            assert found["place"].to_pylist() == want[: how.sample_rows]


def test_reading_is_dealt_by_bytes(spark):
    pages = table(spark, SF, "pages").select("page_id", "url", "html").coalesce(1)
    folder = scratch_folder(spark, "archives")
    index = warc.write_archives(pages, folder)
    records = warc.read_records(index, folder)
    tasks = records.select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks > 1 and records.count() == pages.count()  # of one archive
