"""Which of the labelled documents teach the toxicity scores."""

from __future__ import annotations

import random

from encaudit.llm import toxicity


def test_only_near_copies_with_the_same_label_count_once(spark):
    rnd = random.Random(4)

    def text(n):
        return " ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(n))

    licence, long = text(40), text(200)
    sharing = [(f"{licence} {text(60)}", k % 2) for k in range(30)]
    copies = [(long, 1), (f"{long} b", 1), (f"{long} insult", 0), (f"{long} c {text(4)}", 1)]
    fading = [(f"{text(20)} {long[:700]}", 1)]
    rows = spark.createDataFrame(sharing + copies + fading, "text string, toxic int").repartition(3)
    found = sorted(tuple(row) for row in toxicity.one_of_copies(rows).collect())
    assert found == sorted([*sharing, copies[0], copies[2], *fading])
