"""The registered corpus queries, and the pipeline stage by stage against plain versions."""

import brute
import corpus_pipeline
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from folioscope.llm import language, queries
from folioscope.llm.shared import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    assert compare(spark, connect(SF), queries.QUERIES[name], queries.CHECKS.get(name), SF) is None


@pytest.fixture(scope="module")
def docs(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    odd = [
        (90_000, None, "en"), (90_001, "", "en"), (90_002, "!!! 123", "en"),
        (90_003, f"The first text {passage}", "en"), (90_004, f"Another one {passage} goes on", "en"),
        (90_005, "hello", None),
    ]
    rows = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    return table(spark, SF, "documents").unionByName(rows, allowMissingColumns=True)


def rows_of(df):
    return {x.doc_id: x for x in df.collect()}


def test_language_stage(spark, docs):
    left = rows_of(corpus_pipeline.identify_language(spark, docs, SF))
    judged = rows_of(language.identify(docs))
    want = {i for i, x in judged.items() if x.lang_pred != "und" and x.score >= 0.3}
    assert set(left) == want and 90_003 in left and 90_002 not in left


def test_near_copies_stage(spark, docs):
    left = rows_of(corpus_pipeline.drop_edited_copies(spark, docs, SF))
    texts = {x.doc_id: x.text for x in docs.collect()}
    for doc, text in texts.items():  # of exact copies the first stays
        first = min(i for i, t in texts.items() if t == text)
        assert doc == first or doc not in left


def test_repeats_stage(spark, docs):
    left = rows_of(corpus_pipeline.cut_repeats(spark, docs, SF))
    for doc, (n_words, n_removed, kept) in brute.without_repeats(
        [(x.doc_id, x.text) for x in docs.collect()], 13
    ).items():
        assert (doc in left) == (n_removed == 0 or n_removed < n_words)
        if n_removed and doc in left:
            assert left[doc].text == kept and left[doc].n_chars == len(kept)
    before = rows_of(docs)
    assert left[90_003] == before[90_003] and left[90_004].text == "Another one goes on"


def test_leaks_stage(spark, docs):
    items = [(x.item_id, x.text) for x in table(spark, SF, "benchmark").collect()]
    hits = brute.contamination([(x.doc_id, x.text) for x in docs.collect()], items)
    left = corpus_pipeline.drop_leaks(spark, docs, SF)
    assert set(rows_of(left)) == {doc for doc, (_, n, _) in hits.items() if not n}


def test_pipeline_runs_its_stages_in_turn(spark):
    rows = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
    want = {x.doc_id for x in rows.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {x.doc_id for x in packed.select("doc_id").distinct().collect()} == want
    lengths = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(x.n == 4096 or x.n & (x.n - 1) == 0 for x in lengths)


def test_pipeline_of_nothing(spark):
    rows = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF)
    assert not rows.collect()
