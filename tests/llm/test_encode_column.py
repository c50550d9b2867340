"""Ids of whole columns against the tokenizers library."""

import random

import public_tokenizers
import pyarrow as pa
import pytest

from folioscope.llm import encode

LATIN = "  \n\n\t\r''''aszrevltmdAQ019.,;!?-#%\"éäßñ×÷ªµº²¼½£§«»ÿĀſȿ"
OTHERS = LATIN + "ɐ’中😀\u0085\xa0\x0b\x0c\x1c\x00\x7f"
GIVEN = [
    None, "", " ", "\n", "'", "x'", "x's", "x'l", "x'll", "'re", "it's we'll they've I'd 'tis ''s 's",
    "<|endoftext|> a", "a <|endoftext|>", "  two  blanks \n ", "a" * 23, " " + "b" * 24, "é" * 40,
]


def columns() -> list[list[str | None]]:
    draw = random.Random(7)
    texts = ["".join(draw.choices(x, k=draw.randrange(40))) for x in (LATIN, OTHERS) for _ in range(3000)]
    return [GIVEN, texts, *([t] for t in [*GIVEN, *texts[:300]]), []]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_column_has_the_ids_of_the_library(name, monkeypatch):
    # Few remembered pre-tokens, so that the memory is emptied and batches are taken in parts.
    monkeypatch.setattr(encode, "MEMORY", 300)
    coder = encode.Encoder(public_tokenizers.path(name))
    for texts in columns():
        ids, ends = coder.encode_column(pa.array([None, *texts], pa.string()).slice(1), 2)
        wanted = coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [x.ids + [2] for x in wanted]


def test_plain_latin_texts_do_not_become_python_strings(monkeypatch):
    coder = encode.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(coder, "encode", None)
    ids, ends = coder.encode_column(pa.array(["It's größer,\n\nn'est-ce pas?", None]))
    assert coder.tokenizer.decode(ids.tolist()) == "It's größer,\n\nn'est-ce pas?"
    assert ends.tolist() == [len(ids)] * 2


def test_words_of_a_column_do_not_become_python_strings(monkeypatch):
    coder = encode.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["It's GRÖSSER, 'Tis 12\u00b2 n'EST-ce pas?\n\n''s", None, "\u01c5 \u0178x", " \t ", "'S's 'sun"]
    wanted = coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    monkeypatch.setattr(coder, "encode", None)
    ids, ends = coder.encode_column(pa.array(texts), 2)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [x.ids + [2] for x in wanted]


def test_letters_that_grow_in_lower_case_go_through_the_library():
    coder = encode.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["\u0130stanbul ok", "plain", "a \u023a \u023e b", "\u0244 \u0181", None]
    wanted = coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    ids, ends = coder.encode_column(pa.array(texts), 2)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [x.ids + [2] for x in wanted]
