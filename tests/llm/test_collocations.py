"""Collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from encaudit.llm import collocations


def plain(rows, least, first=2000, longest=4, share=80):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    found = []
    for lang, table in counts.items():
        candidates = {gram: n for gram, n in table.items() if len(gram) > 1 and n >= least}
        gone = set()
        for gram, n in candidates.items():
            for size in range(2, len(gram)):
                for at in range(len(gram) - size + 1):
                    inner = gram[at : at + size]
                    if 100 * n >= share * candidates[inner]:
                        gone.add(inner)
        scored = []
        for gram, a in candidates.items():
            if gram not in gone:
                cuts = ((2000000 * a // (table[gram[:k]] + table[gram[k:]]), k) for k in range(1, len(gram)))
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(gram).encode(), table[gram[:k]], table[gram[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


def mined(spark, rows, schema="lang string, text string", parts=3, **options):
    docs = spark.createDataFrame(rows, schema).repartition(parts)
    return sorted(tuple(row) for row in collocations.collocations(docs, **options).collect())


def texts(count, words, seed, langs=("en", "de", None)):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdeé漢", k=rnd.randrange(1, 4))) for _ in range(60)]
    weights = [1 / k for k in range(1, 61)]

    def text():
        said = rnd.choices(vocabulary, weights, k=rnd.randrange(words))
        return "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for w in said)

    return [(rnd.choice(langs), text()) for _ in range(count)]


@pytest.mark.parametrize("dense", [collocations.DENSE, 0])
def test_counts(spark, monkeypatch, dense):
    monkeypatch.setattr(collocations, "DENSE", dense)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 2000)
    rows = texts(120, 120, 1) + [("de", "One two three four. " * 9), ("en", "to be or not to be, " * 7 + "to be")]
    expected = plain(rows, 5)
    assert {len(row[2].split()) for row in expected} == {2, 3, 4}
    assert mined(spark, rows, least=5) == expected


def test_first_and_odd_rows(spark):
    rows = texts(60, 80, 2)
    rows += [(None, None), ("en", ""), ("en", None), ("und", "a b " * 5), ("xx", " \t.,;"), ("tr", "İ ß É " * 4), ("en", "A b" * 3000)]
    assert mined(spark, rows, least=4, first=7) == plain(rows, 4, 7)
    assert mined(spark, [(*row, 1, "x", 2.5) for row in rows], "lang string, text string, n int, chunk string, id double", least=4) == plain(rows, 4)
    assert mined(spark, [], least=4) == mined(spark, [("en", "once only")], least=4) == []


def test_ids_over_several_tiles():
    rnd = np.random.default_rng(3)
    for top in (5, 3000, 1 << 33):
        ids = rnd.integers(0, top, 5000)
        ids[rnd.random(5000) < 0.1] = collocations.GAP
        assert (collocations._unpacked(collocations._packed(ids)) == ids).all()
        pairs = zip(ids[:-1].tolist(), ids[1:].tolist())
        expected = Counter((a, b) for a, b in pairs if collocations.GAP not in (a, b))
        a, b, counts = (side.tolist() for side in collocations._pairs(ids))
        assert dict(zip(zip(a, b), counts)) == expected
        found = Counter()
        for tile, cells, counts in collocations._dense_tiles(ids):
            for cell, n in zip(cells.tolist(), counts.tolist()):
                found[(tile >> 32) << 10 | cell >> 10, (tile & 0xFFFFFFFF) << 10 | cell & 1023] += n
        assert found == {pair: n for pair, n in expected.items() if (pair[0] // 1024 + 1) * (pair[1] // 1024 + 1) <= 16}


def test_counts_beyond_a_word():
    row = (7, 0, np.array([1, 5], "<u4").tobytes(), collocations._packed(np.array([1 << 40, 2])))
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array([v] * 3, t) for v, t in zip(row, types)], ["tile", "salt", "cells", "counts"])
    (tile, cells, counts), = collocations._added_tiles(iter([batch]))
    assert (tile, cells.tolist(), counts.tolist()) == (7, [1, 5], [3 << 40, 6])
