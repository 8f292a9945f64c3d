"""Quality scores: statistics against plain Python, densities against a direct formula, held-out accuracy."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from encaudit.llm import quality

SF_DIR = os.environ.get("TEST_QUALITY_DIR", "/root/testdata/sf0.01")
TEXTS = [
    "", "a", "Once upon a time, there was.\nA second line!\n\nONCE again 42 x9 || ?", "é漢 \x00\x01 É", "###\n###\nthe$ the$ the",
    "one\ntwo\nthree", " \t\n ", "word " * 50, "A.\nA.\nB?\n", 'He said: "no" (twice) - it\'s.',
]


def plain(text):
    data = (text or "").encode()
    words, lines = re.findall(rb"[^ \t\r\x0b\x0c\n]+", data), [part for part in data.split(b"\n") if part]
    n, w, ln = len(data), len(words), len(lines)

    def bytes_of(signs):
        return sum(data.count(bytes([s])) for s in signs) / max(n, 1)

    def share(flags, total):
        return sum(flags) / max(total, 1)

    groups = [bytes(range(65, 91)), bytes(range(48, 58)), b" \t\r\x0b\x0c", b"\n", b".!?", b",;:", b"'\"()-"]
    known = set(b"".join(groups)) | set(range(97, 123))
    groups.append(bytes(c for c in range(0x21, 0x7F) if c not in known))
    groups.append(bytes(c for c in range(0x80) if c < 0x21 and c not in known) + b"\x7f")
    groups.append(bytes(range(0xC0, 256)))
    letter, again = rb"[a-zA-Z\xc0-\xff]", lambda items: sum(c - 1 for c in Counter(items).values())
    lengths = [len(word) for word in words] or [0]
    mean = sum(lengths) / max(w, 1)
    spread = math.sqrt(max(sum(x * x for x in lengths) / max(w, 1) - mean**2, 0))
    signs = groups[7]
    shares = [
        share((not re.search(letter + rb"|\d", x) for x in words), w),
        share((x[-1] in signs and bool(re.search(letter, x)) for x in words), w),
        share((len(re.findall(b"[A-Z]", x)) > 1 and not re.search(b"[a-z]", x) for x in words), w),
        share((bool(re.search(rb"\d", x)) for x in words), w),
        again(x.lower() for x in words) / max(w, 1),
        again(lines) / max(ln, 1),
        share((x[-1] in b".!?'\"()-" for x in lines), ln),
        share((len(re.findall(rb"[^ \t\r\x0b\x0c]+", x)) <= 1 for x in lines), ln),
    ]
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(data).values()) if n else 0.0
    sizes = [math.log1p(x) for x in (n, w, ln, mean, spread, n / max(ln, 1))]
    return [*sizes, *(math.sqrt(bytes_of(g)) for g in groups), *map(math.sqrt, shares), entropy]


def test_statistics():
    found = quality.statistics(pa.array([*TEXTS, None]))
    assert found.shape == (len(TEXTS) + 1, len(quality.NAMES))
    np.testing.assert_allclose(found, [plain(text) for text in [*TEXTS, None]], atol=1e-9)


def test_scores_are_the_posterior():
    rnd = np.random.default_rng(1)
    x = [rnd.normal(k, 1 + k, (400, 3)) @ rnd.normal(size=(3, 3)) for k in (0, 1)]
    model = quality.Discriminant({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in enumerate(x)})
    every = np.concatenate(x)
    z = (every - every.mean(axis=0)) / every.std(axis=0)
    logs = []
    for k in (0, 1):
        mine = z[:400] if k == 0 else z[400:]
        covariance = quality.shrunk(np.cov(mine.T, bias=True), 400)
        off = z - mine.mean(axis=0)
        distance = np.einsum("ij,jk,ik->i", off, np.linalg.inv(covariance), off)
        logs.append(math.log(0.5) - (np.linalg.slogdet(covariance)[1] + distance) / 2)
    expected = 1 / (1 + np.exp(-(logs[1] - logs[0]) / quality.TEMPERATURE))
    np.testing.assert_allclose(model.score(every), expected, atol=1e-9)


def test_shrinkage_lies_between_the_covariance_and_a_sphere():
    covariance = np.diag([1.0, 4.0])
    assert np.allclose(quality.shrunk(covariance, 10**9), np.diag([1 + 1.5 * 0.02, 4 - 1.5 * 0.02]))
    few = quality.shrunk(covariance, 20)
    assert 1 < few[0, 0] < few[1, 1] < 4 and np.isclose(np.trace(few), 5)
    assert (np.linalg.eigvalsh(quality.shrunk(np.zeros((3, 3)), 5)) > 0).all()


def scores(spark, docs, labels, schema="doc_id long, text string"):
    frame = quality.quality(
        spark.createDataFrame(docs, schema).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")
    )
    return sorted((tuple(row) for row in frame.collect()), key=str)


def test_odd_rows(spark):
    good, bad = "It is a plain line of text. And one more.", "### $$$ || A1 B2 ###\n" * 3
    docs = [(k, (good if k % 2 else bad) + "x" * (k % 7)) for k in range(80)]
    labels = [(k, k % 2) for k in range(80)] + [(1, 0), (None, 1), (3, None), (5000, 1)]
    odd = [(None, good), (900, None), (901, ""), (902, good * 3000), (7, good), (7, good)]
    found = scores(spark, docs + odd, labels)
    assert len(found) == len(docs) + len(odd)
    by_id = {row[0]: row for row in found}
    for k, _ in docs:
        assert by_id[k][1] == (zlib.crc32(str(k).encode()) % 5 == 0)
        if k != 7:
            assert by_id[k][3] == k % 2 == int(by_id[k][2] >= 0.3)
    assert by_id[None][1] is False and all(0 <= row[2] <= 1 for row in found)
    assert by_id[900][2] == by_id[901][2]
    wide = [(k, text, 1.0, "x", 2) for k, text in docs]
    assert scores(spark, wide, labels, "doc_id long, text string, quality double, x string, n int") == scores(spark, docs, labels)
    assert {row[2] for row in scores(spark, docs, [(1, 1), (2, 1), (3, 1)])} == {1.0}
    assert {row[2] for row in scores(spark, docs, [])} == {0.0}
    assert scores(spark, [], labels) == []


def test_held_out_rows_teach_nothing(spark):
    docs = [(k, "good text of words here." if k % 2 else "@@@ ### 1 2 3") for k in range(60)]
    labels = [(k, k % 2) for k in range(60)]
    turned = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q) for k, q in labels]
    assert scores(spark, docs, labels) == scores(spark, docs, turned)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "labels"))
    rows = quality.quality(docs, labels).where("held_out").join(labels.where(F.col("quality").isNotNull()), "doc_id").collect()
    good, bad = ([row["score"] for row in rows if row["quality"] == k] for k in (1, 0))
    ordered = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert ordered > 0.97
    assert sum(row["predicted"] == row["quality"] for row in rows) / len(rows) > 0.95
