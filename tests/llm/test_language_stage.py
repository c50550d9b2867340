"""The rejection rule of the pipeline's language stage, whatever the number of labels."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from folioscope.llm import language

GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
SCHEMA = "doc_id long, text string, lang string"


def prose(draw, letters, count=60):
    return " ".join(
        "".join(draw.choice(letters) for _ in range(draw.randint(2, 8))) for _ in range(count)
    )


def corpus(labels):
    """40 texts per label, each label with six Latin letters of its own; Greek is not learned."""
    draw = random.Random(labels)
    latin = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
    alphabets = [draw.sample(latin, 6) for _ in range(labels)]
    rows = [
        (40 * k + i, prose(draw, letters), f"l{k}")
        for k, letters in enumerate(alphabets)
        for i in range(40)
    ]
    mixed = [(90_000, prose(draw, sum(alphabets, []) or latin), None)] if labels < 3 else []
    odd = [(90_001, prose(draw, GREEK), None), (90_002, "!!! 123", None), (90_003, "", None)]
    return rows + mixed + odd + [(90_004, None, None)]


@pytest.mark.parametrize("labels", [0, 1, 2, 30])
def test_only_texts_of_unlearned_scripts_go(spark, labels):
    rows = corpus(labels)
    docs = spark.createDataFrame(rows, SCHEMA)
    left = corpus_pipeline.identify_language(spark, docs, "").collect()
    out = {90_002, 90_003, 90_004} | ({90_001} if labels else set())
    assert sorted(x.doc_id for x in left) == sorted({x[0] for x in rows} - out)


def test_labels_on_held_out_rows_only(spark):
    docs = spark.createDataFrame(corpus(2), SCHEMA).where(language.held_out(F.col("doc_id")))
    wanted = [x.doc_id for x in docs.collect() if x.doc_id < 90_002]
    left = corpus_pipeline.identify_language(spark, docs, "").collect()
    assert wanted and sorted(x.doc_id for x in left if x.lang) == sorted(
        i for i in wanted if i < 90_000
    )


@pytest.mark.parametrize("labels", [0, 1, 3])
def test_texts_that_stay_are_named_as_the_operator_names_them(spark, labels):
    docs = spark.createDataFrame(corpus(labels), SCHEMA)
    twice = docs.unionByName(docs.where("doc_id < 20")).withColumn("note", F.lit("n"))
    left = corpus_pipeline.identify_language(spark, twice, "")
    assert left.columns == ["doc_id", "text", "lang", "note", "lang_pred", "lang_score"]
    found = {x.doc_id: (x.lang_pred, x.score) for x in language.identify(twice).collect()}
    rows = left.collect()
    assert [(x.lang_pred, x.lang_score) for x in rows] == [found[x.doc_id] for x in rows]
    assert len([x for x in rows if x.doc_id < 20]) == (40 if labels else 0)
    named = {x.lang_pred for x in rows if x.lang}
    assert named == {f"l{k}" for k in range(labels)}
    right = [x.lang == x.lang_pred for x in rows if x.lang]
    assert sum(right) >= 0.95 * len(right)
    # A text is judged in one pass over the rows.
    assert str(left._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 1
