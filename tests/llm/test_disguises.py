"""Disguised words that hold few letters, or none."""

from __future__ import annotations

import pytest

from encaudit.llm import toxicity


@pytest.fixture(scope="module")
def restorer(spark):
    said = "you are an idiot and an ass and an asshole a moron with boobies like a grendel " * 20
    texts = spark.createDataFrame([(1, said)], "doc_id long, text string")
    return toxicity.Restorer(toxicity.letter_counts(texts))


def found(restorer, text):
    return toxicity.document_words(text, restorer.words)


@pytest.mark.parametrize(
    ("shown", "meant"),
    [
        ("1d10t", "idiot"), ("a$$", "ass"), ("a55", "ass"), ("@$$", "ass"), ("@$$h0l3", "asshole"), ("a55h0l3", "asshole"),
        ("b00b1e5", "boobies"), ("1 d 1 0 t", "idiot"), ("m--0--r--0--n", "moron"),
    ],
)
def test_words_of_few_letters_are_restored(restorer, shown, meant):
    assert meant in found(restorer, f"You {shown}, said Grendel.")


@pytest.mark.parametrize("shown", ["455", "$455", "1,055.50", "+1 (017) 555-7713", "50%", "---", "€5", "5:50"])
def test_numbers_are_no_words(restorer, shown):
    assert found(restorer, shown) == set()


@pytest.mark.parametrize(
    ("text", "meant"),
    [
        ("you are a m o r o n", {"a", "moron"}),
        ("a i d i o t", {"a", "idiot"}),
        ("m o r o n i d i o t", {"moron", "idiot"}),
        ("1 d 1 0 t, a m 0 r 0 n!", {"idiot", "moron"}),
        ("m  o  r  o  n", {"moron"}),
        ("m\to\tr\to\tn", {"moron"}),
        ("m\no\nr\no\nn", {"moron"}),
        ("m o r o n", {"moron"}),
        ("(m o r o n).", {"moron"}),
        ("a.m.o.r.o.n", {"a", "moron"}),
    ],
)
def test_spaced_words_are_told_apart(restorer, text, meant):
    assert meant <= found(restorer, text)
