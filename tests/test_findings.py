from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from encaudit.operators.findings import (
    are_lines_commented,
    commented_lines,
    damaged_lines,
    findings,
    with_lines,
)
from tests import models

M = models.MARK


def collected(found):
    return sorted(found.collect(), key=lambda row: (row["path"], row["finding_no"]))


def test_known_files(make_files):
    files = make_files(
        [
            ("/p/volume.h", f"#define RHO 7\n/* ma{M}ch */ int d{M}r;\n".encode("utf-8-sig"), "utf-8"),
            ("/q/route.cs", f"go(); // \u03b1{M}\n".encode("utf-16-be"), "utf-16be"),
            ("/r/narrow.c", b"n = 0; /* la\xef\xbf\xbdt */", "iso-8859-2"),
            ("/s/notes.rst", f"{M}".encode(), "utf-8"),
            ("/t/shift.cpp", b"char k = 'x'; // +-\n", "utf-7"),
            ("/u/sound.py", b"# all well\n", "utf-8"),
            ("/v/cut.md", b"half a character \xe2\x82", "utf-8"),
        ]
    )
    rows = collected(with_lines(findings(files), damaged_lines(files)))
    got = [(row["file_name"], row["comment_context"], row["byte_sequence_file_pos"]) for row in rows]
    assert got == [
        ("volume.h", "comment", 22), ("volume.h", "code", 36), ("route.cs", "comment", 20),
        ("narrow.c", "comment", 12), ("notes.rst", "unsupported", 0),
    ]
    first, second, wide, narrow, alone = rows
    assert (first["line"], first["char_position"], first["absolute_char_index"]) == (2, 5, 19)
    assert (second["char_position"], second["string"]) == (17, f"/* ma{M}ch */ int d{M}r;")
    assert (wide["char_position"], wide["is_commented"]) == (10, True)
    assert (narrow["char_found"], narrow["char_position"], narrow["absolute_char_index"]) == (False, -1, None)
    assert (alone["line"], alone["char_position"], alone["is_commented"]) == (1, 0, False)


def test_line_text_keeps_its_indent_and_string_does_not(make_files):
    files = make_files([("/x.c", f"\t  int a; // {M}\r\nb".encode(), "utf-8")])
    row = with_lines(findings(files), damaged_lines(files)).first()
    assert row["string"] == f"int a; // {M}"
    assert row["line_text"] == f"\t  int a; // {M}"
    assert row["line_text"][row["char_position"]] == M


def random_content(seed, label):
    codec, pattern, visible, _ = models.CODECS[label]
    alphabet = "ab \n\n/*\"'#" + ("\xe9€\U0001f600" if codec.startswith("utf") else "")
    alphabet += "\xe9\xf6" if codec in ("latin-1", "cp1252") else ""
    pieces = []
    for _ in range(seed.randrange(40)):
        pieces.append(models.random_text(seed, alphabet, 6).encode(codec))
        pieces.append(bytes.fromhex(pattern) if seed.random() < 0.7 else b"")
    return models.BOMS.get(label, b"") + b"".join(pieces)


def test_random_files_match_a_model_in_every_charset(make_files):
    seed = random.Random(11)
    rows = []
    for number in range(1200):
        label = seed.choice(["utf-8", "utf-8-sig", "utf-16", "utf-16be", "utf-32", "iso-8859-1", "windows-1252"])
        extension = seed.choice([".c", ".py", ".txt"])
        rows.append((f"/{number}{extension}", random_content(seed, label), label))
    found: dict[str, list] = {}
    for row in collected(findings(make_files(rows).repartition(8))):
        found.setdefault(row["path"], []).append(row)
    for path, content, label in rows:
        expected = models.findings_by_prefix(content, label)
        got = [
            (r["byte_sequence_file_pos"], r["absolute_char_index"], r["line"], r["char_position"], r["char_found"])
            for r in found.get(path, [])
        ]
        assert got == expected, (path, label, content)
        codec = models.CODECS[label][0]
        text = content[len(models.BOMS.get(label, b"")) :].decode(codec, "replace")
        text = text.replace("\xef\xbf\xbd", M)
        model = {"c": models.c_contexts, "y": models.python_contexts}.get(path[-1])
        contexts = model(text) if model else ["unsupported"] * len(expected)
        assert [r["comment_context"] for r in found.get(path, [])] == contexts


def test_malformed_input_is_no_finding_but_shifts_none(make_files):
    seed = random.Random(5)
    rows = []
    for number in range(600):
        label = seed.choice(["utf-8", "utf-16", "ascii"])
        bad = {"utf-8": [b"\xff", b"\xe2\x82a", b"\xc3 "], "utf-16": [b"\x00\xd8", b"\x00\xdc"], "ascii": [b"\x80"]}
        mark = bytes.fromhex(models.CODECS[label][1])
        codec = models.CODECS[label][0]
        content = models.BOMS.get(label, b"")
        for _ in range(seed.randrange(12)):
            content += seed.choice([seed.choice(bad[label]), mark, "x\n".encode(codec), "y".encode(codec)])
        rows.append((f"/{number}.txt", content, label))
    found: dict[str, list] = {}
    for row in collected(findings(make_files(rows).repartition(8))):
        found.setdefault(row["path"], []).append(
            (row["byte_sequence_file_pos"], row["absolute_char_index"], row["line"], row["char_position"], True)
        )
    for path, content, label in rows:
        assert found.get(path, []) == models.findings_by_prefix(content, label), (label, content)


def test_one_file_with_very_many_findings(make_files):
    count = 60_000
    files = make_files([("/hot.txt", (f"a{M}\n" * count).encode(), "utf-8")])
    totals = findings(files).agg(
        F.count("*").alias("n"), F.max("line").alias("line"), F.sum("absolute_char_index").alias("index")
    ).first()
    assert tuple(totals) == (count, count, sum(3 * i + 1 for i in range(count)))


def test_findings_need_no_shuffle(make_files):
    plan = findings(make_files([("/a.c", b"x", "utf-8")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Window" not in plan


def test_commented_lines(spark, make_files):
    files = make_files(
        [
            ("/gear.cs", b"run();\r// stop\r\n  // wait\nrun(); // go\n", "utf-8"),
            ("/tube.h", b"/* one */\n/*\n\ntwo\n*/ f();\n", "utf-8"),
        ]
    )
    lines = {(r["path"], r["line"]): r["is_commented"] for r in commented_lines(files).collect()}
    assert [lines["/gear.cs", n] for n in range(1, 5)] == [False, True, True, False]
    assert lines["/tube.h", 2] and lines["/tube.h", 4] and not lines["/tube.h", 6]
    asked = spark.createDataFrame([("/gear.cs", -1), ("/gear.cs", 3), ("/gear.cs", 50)], "path string, line int")
    answers = {r["line"]: r["is_commented"] for r in are_lines_commented(files, asked).collect()}
    assert answers == {-1: False, 3: True, 50: False}


def test_no_content_above_the_generator(make_files):
    """Or it would be copied for every finding of the file."""
    plan = findings(make_files([("/a.py", f"a{M}".encode(), "utf-8")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Generate ")[0]


def test_words_after_a_very_long_one(make_files):
    """Time is linear in the length of words without damage."""
    files = make_files([("/a.txt", ("a" * 400_000 + f" b{M}c").encode(), "utf-8")])
    started = time.perf_counter()
    row = findings(files, with_word=True).select("word", "word_offset").first()
    assert tuple(row) == (f"b{M}c", 1)
    assert time.perf_counter() - started < 30
