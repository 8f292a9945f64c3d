from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from encaudit.functions.contexts import c_like_contexts, line_flags, marker_contexts, python_contexts
from tests import models

M = models.MARK


def contexts_of(spark, texts, function):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(8)
    got = rows.select("n", function(F.col("text")).alias("c")).collect()
    return [list(row["c"]) for row in sorted(got, key=lambda row: row["n"])]


@pytest.mark.parametrize(
    ("extension", "text", "expected"),
    [
        (".h", f"a = b / {M}; // {M} / {M}\n{M}", ["code", "comment", "comment", "code"]),
        (".cs", f"s = \"\\\"{M}\"; /* \"{M} */ c = '\"'; {M} // {M}", ["code", "comment", "code", "comment"]),
        (".c", f"/*/ {M} */ {M} /**/ {M} //", ["comment", "code", "code"]),
        (".cpp", f"x = 1; // tail \\\n{M}", ["code"]),
        (".py", f"s = '#{M}' + \"\\\"#{M}\" #{M}\n{M}", ["code", "code", "comment", "code"]),
        (".py", f"'''# {M}\n\"\"\" {M}''' # {M}", ["code", "code", "comment"]),
        (".py", f"x = \"open {M}\n# {M}", ["code", "code"]),
        (".rst", f".. // {M} #{M}", ["unsupported", "unsupported"]),
        ("", f"{M}{M}", ["unsupported", "unsupported"]),
        (".cs", "", []),
    ],
)
def test_contexts_by_extension(spark, extension, text, expected):
    row = spark.createDataFrame([(text, extension)], "text string, ext string")
    got = row.select(marker_contexts(F.col("text"), F.col("ext")).alias("c")).first()["c"]
    assert list(got) == expected


@pytest.mark.parametrize(
    ("function", "model", "alphabet"),
    [
        (c_like_contexts, models.c_contexts, f"//**\"'\\\n a{M}{M}"),
        (python_contexts, models.python_contexts, f"##\"\"\"'''\\\n a{M}{M}"),
    ],
)
def test_random_texts_match_a_scanner(spark, function, model, alphabet):
    seed = random.Random(7)
    texts = [models.random_text(seed, alphabet, 60) for _ in range(3000)]
    got = contexts_of(spark, texts, function)
    assert got == [model(text) for text in texts]


def test_a_long_file_does_not_overflow_the_matcher(spark):
    text = f'x = "{"a" * 200_000}"; /* {"b " * 200_000}{M} */ ' * 3
    row = spark.createDataFrame([(text,)], "text string")
    assert row.select(c_like_contexts(F.col("text")).alias("c")).first()["c"] == ["comment"] * 3


def flags(spark, text, extension):
    row = spark.createDataFrame([(text, extension)], "text string, ext string")
    return list(row.select(line_flags(F.col("text"), F.col("ext")).alias("f")).first()["f"])


def test_line_flags(spark):
    lamp = "lamp(on); // lit\n  // kept by two\nfog /* thick\nand wet */ = 3;\n/* horn */ sound();"
    assert flags(spark, lamp, ".hpp") == [False, True, False, True, True]
    keepers = "'/*' tower // '\n*/ \" // \n\" //\n\t/*\n\n \t\n  night\n*/*/ day"
    assert flags(spark, keepers, ".cs") == [False, False, False, True, False, False, True, True]
    assert flags(spark, "﻿// first\n  // more\n", ".txt") == [True, True, False]
    assert flags(spark, "# note\nx = 1  # y\n'''\n# text\n'''", ".py") == [True, False, False, True, False]
    assert flags(spark, "# note", ".c") == [False]
    assert flags(spark, f"/* {M}\n{M}*/\n{M}", ".c") == [True, True, False]
