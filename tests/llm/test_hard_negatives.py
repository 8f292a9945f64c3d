"""Hard negatives against plain loops, with the odd rows that a table may hold."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from encaudit.llm import hard_negatives

SCHEMA = "id long, label int, vector array<double>"


def plain(rows, scale=1.0, positives=5, negatives=10, low=30, high=90, every=10):
    def sound(row):
        return None not in row and all(x is not None and math.isfinite(x * scale) for x in row[2])

    kept = [(one, label, [math.floor(x * scale) for x in v]) for one, label, v in filter(sound, rows)]
    anchors = {}
    for row in sorted(filter(sound, rows), key=lambda row: (row[0], row[1], row[2])):
        anchors.setdefault(row[0], (row[0], row[1], [math.floor(x * scale) for x in row[2]]))
    found = []
    for a, label, v in anchors.values():
        if a % every:
            continue
        score = lambda w: max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(v, w))))
        pairs = sorted((-score(w), one, of != label) for one, of, w in kept if len(w) == len(v))
        for minus, one in [(m, one) for m, one, other in pairs if not other and one != a][:positives]:
            inside = [(m, o) for m, o, other in pairs if other and low * -minus <= -100 * m <= high * -minus]
            found += [(a, one, rank, o, -minus, -m) for rank, (m, o) in enumerate(inside[:negatives], 1)]
    return sorted(found)


def mined(spark, rows, schema=SCHEMA, every=10, **options):
    docs = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(docs, F.col("id") % every == 0, **options).collect())


def vectors(count, width, labels, seed):
    rnd = random.Random(seed)
    return [(k, rnd.randrange(labels), [rnd.uniform(-1, 1.5) for _ in range(width)]) for k in range(count)]


def test_random_vectors_in_several_groups(spark):
    rows = vectors(300, 6, 3, 1)
    expected = plain(rows, 256)
    assert len(expected) > 500
    for groups in (1, 4):
        assert mined(spark, rows, scale=256.0, groups=groups) == expected


def test_ties_and_rows_that_occur_again(spark):
    rnd = random.Random(2)
    rows = [(k, k % 3, [float(rnd.randrange(-1, 3)) for _ in range(3)]) for k in range(120)]
    rows += rows[10:60] + [(20, 2, [1.0, 1.0, 1.0]), (20, 0, [2.0, 0.0, 1.0])]
    assert mined(spark, rows) == plain(rows)
    copies = [(k, int(k > 60), [1.0, 1.0]) for k in range(120)] + [(500, 0, [0.5, 0.4])]
    assert mined(spark, copies, scale=4.0, high=100) == plain(copies, 4.0, high=100)


def test_odd_rows(spark):
    bad = [
        (None, 1, [1.0]), (100, None, [1.0]), (110, 1, None), (120, 1, [1.0, None]), (130, 1, [float("nan"), 1.0]),
        (140, 1, [float("inf"), 1.0]), (150, 1, [1e308, 1.0]), (160, 1, []), (161, 1, []), (162, 0, []), (-10, 0, [1.0]),
        (-11, 0, [3.0]), (-13, 4, [1.0]), (-20, 7, [5.0]), (30, 9, [-1.0, -1.0]), (31, 9, [1.0, 1.0]),
    ]
    rows = bad + vectors(60, 2, 2, 3)[1:]
    assert mined(spark, rows, scale=256.0) == plain(rows, 256)
    assert mined(spark, bad, scale=256.0) == plain(bad, 256) != []
    assert mined(spark, bad[:7], scale=256.0) == mined(spark, [], scale=256.0) == []


def test_scores_beyond_a_long(spark):
    rnd = random.Random(4)
    large = [(k, k % 2, [rnd.choice([1e9, 2e9, 1e12, -3.0, 2.0**70]), float(k)]) for k in range(60)]
    middle = [(k, k % 2, [rnd.uniform(1e8, 9e8), rnd.uniform(1e8, 9e8)]) for k in range(60)]
    for rows in (large, middle):
        assert mined(spark, rows) == plain(rows)


def test_other_columns_and_counts(spark):
    rows = vectors(80, 4, 2, 5)
    wide = [(*row, 1, 2, "x", 0.5) for row in rows]
    schema = SCHEMA + ", anchor int, score int, key string, chosen double"
    options = {"scale": 100.0, "positives": 2, "negatives": 3, "low": 10, "high": 50}
    assert mined(spark, wide, schema, **options) == plain(rows, 100.0, 2, 3, 10, 50)
    assert mined(spark, rows, every=1000, scale=100.0) == plain(rows, 100.0, every=1000)
