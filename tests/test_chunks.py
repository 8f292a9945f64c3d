"""Files in chunks give what whole files give, wherever they are cut."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from encaudit.functions.charsets import decode_lossy
from encaudit.functions.chunked import C_STATES, PYTHON_STATES, chunk_scan
from encaudit.operators import chunks as parts
from encaudit.operators.findings import findings
from encaudit.sources.chunks import cut_files, read_chunks

FIELDS = ["path", "file_name", "write_charset", "finding_no", "line", "char_position", "char_found",
          "byte_sequence_file_pos", "absolute_char_index", "comment_context", "is_commented"]
MARK = "�"


def rows_of(frame):
    return sorted(tuple(map(str, row)) for row in frame.select(*FIELDS).collect())


def noise(rnd, alphabet, n):
    return "".join(rnd.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def odd_files(spark):
    """Files of all families: valid, damaged and malformed, with marks and without."""
    rnd, rows = random.Random(7), []
    code = ["/", "*", "\\", '"', "'", "\n", "#", MARK, "é", "𝄞", "a", " ", "//", "/*", "*/", '"""', "'''", '""']
    for k in range(10):
        for suffix in ("c", "py", "txt"):
            text = noise(rnd, code, rnd.randrange(400))
            rows.append((f"/{k}.{suffix}", text.encode(), "utf-8"))
            rows.append((f"/le{k}.{suffix}", text.encode("utf-16-le"), "utf-16"))
            rows.append((f"/be{k}.{suffix}", b"\xfe\xff" + text.encode("utf-16-be"), "utf-16"))
            rows.append((f"/u4{k}.{suffix}", b"\xff\xfe\0\0" + text.encode("utf-32-le"), "utf-32"))
            narrow = text.replace("𝄞", "").replace(MARK, "ï¿½").encode("latin-1")
            rows.append((f"/w{k}.{suffix}", narrow, "windows-1252"))
    for k in range(30):
        raw = bytes(rnd.choice([0x41, 0x0A, 0x80, 0xBF, 0xC3, 0xE2, 0x82, 0xEF, 0xBF, 0xBD, 0xF0, 0x9F]) for _ in range(150))
        rows += [(f"/m{k}.txt", raw, "utf-8"), (f"/n{k}.c", raw, "iso-8859-1"), (f"/a{k}.c", raw, "ascii")]
        pairs = b"".join(rnd.choice([b"\x3d\xd8", b"\x00\xdc", b"a\0", b"\xfd\xff", b"\n\0"]) for _ in range(60))
        rows.append((f"/s{k}.txt", pairs + b"x" * (k % 2), "utf-16le"))
    rows += [("/empty.c", b"", "utf-8"), ("/mark.py", b"\xef\xbb\xbf", "utf-8-sig"), ("/none.c", b"\xef\xbf\xbd", None)]
    return spark.createDataFrame([(p, bytearray(c), e) for p, c, e in rows], "path string, content binary, label string")


@pytest.mark.parametrize("size", [16, 64, 1 << 20])
def test_findings_do_not_depend_on_the_cuts(odd_files, size):
    expected = rows_of(findings(odd_files))
    assert len(expected) > 800
    assert rows_of(parts.chunk_findings(cut_files(odd_files, size))) == expected


@pytest.mark.parametrize("size", [16, 60])
def test_texts_join_to_the_text_of_the_file(odd_files, size):
    """Parts of a file are decoded as the whole is, malformed input included."""
    planned = parts._planned(cut_files(odd_files, size))
    text = decode_lossy(F.col("body"), F.col("plan.family")).alias("text")
    pieces = planned.select("path", "chunk_no", text).collect()
    joined = {}
    for row in sorted(pieces, key=lambda row: (row["path"], row["chunk_no"])):
        joined[row["path"]] = joined.get(row["path"], "") + row["text"]
    whole = parts._planned(cut_files(odd_files, 1 << 20)).select("path", text).collect()
    assert joined == {row["path"]: row["text"] for row in whole}


def test_converted_parts(odd_files):
    found = parts.converted_chunks(cut_files(odd_files, 32)).collect()
    held = {}
    for row in sorted(found, key=lambda row: (row["path"], row["chunk_no"])):
        held[row["path"]] = held.get(row["path"], b"") + bytes(row["content"])
    contents = {row["path"]: (bytes(row["content"]), row["label"]) for row in odd_files.collect()}
    codecs = {"utf-16": "utf-16-le", "utf-16le": "utf-16-le"}
    expected = {}
    for path, (content, label) in contents.items():
        try:
            codec = "utf-16" if content[:2] == b"\xfe\xff" else "utf-32" if label == "utf-32" else codecs.get(label, label)
            expected[path] = b"\xef\xbb\xbf" + content.decode(codec).removeprefix("﻿").encode()
        except (UnicodeDecodeError, TypeError):
            pass
    assert held == expected
    refused = {row["path"] for row in parts.undecodable(cut_files(odd_files, 32)).collect()}
    assert refused == set(contents) - set(expected)


def states_after(text, extension):
    """The scanner's state by walking through the text character by character: what it is inside of."""
    at, n = 0, len(text)
    while at < n:
        if extension == ".c" and text.startswith(("//", "/*"), at):
            end = text.find("\n", at) if text[at + 1] == "/" else text.find("*/", at + 2)
            if end < 0:
                return "//" if text[at + 1] == "/" else "/**" if n - at > 2 and text[-1] == "*" else "/*"
            at = end + (1 if text[at + 1] == "/" else 2)
        elif extension == ".c" and text[at] == "/":
            if at + 1 == n:
                return "/"
            at += 1
        elif extension == ".py" and text[at] == "#":
            if (end := text.find("\n", at)) < 0:
                return "#"
            at = end + 1
        elif text[at] in "\"'":
            quote = text[at]
            if extension == ".py" and text.startswith(3 * quote, at):
                if (end := text.find(3 * quote, at + 3)) < 0:
                    body = text[at + 3 :]
                    return quote * (3 + len(body) - len(body.rstrip(quote)))
                at = end + 3
                continue
            start, at = at, at + 1
            while at < n and text[at] != quote:
                at += 2 if text[at] == "\\" else 1
            if at > n:
                return quote + "\\"
            if at == n:
                return quote if extension == ".c" or n - start == 1 else quote + "a"
            at += 1
            if extension == ".py" and at == n and at - start == 2:
                return 2 * quote
        else:
            at += 1
    return ""


@pytest.mark.parametrize(("extension", "states"), [(".c", C_STATES), (".py", PYTHON_STATES)])
def test_states_between_chunks(spark, extension, states):
    rnd = random.Random(11)
    alphabet = ["/", "*", "\\", '"', "'", "\n", "#", "a"]
    texts = ["", *alphabet, *(noise(rnd, alphabet, rnd.randrange(1, 9)) for _ in range(400))]
    frame = spark.createDataFrame([(t, bytearray(t.encode())) for t in texts], "text string, body binary")
    scan = chunk_scan(F.col("body"), F.lit("utf8"), F.lit(extension), F.lit(False))
    found = {row["text"]: {s["before"]: s["after"] for s in row["scan"]["steps"]} for row in frame.select("text", scan.alias("scan")).collect()}
    for text, steps in found.items():
        assert steps == {state: states_after(state + text, extension) for state in states}, text


def test_chunks_of_a_tree(spark, tmp_path):
    text = "one � line // �\n" * 5000
    (tmp_path / "long.cpp").write_bytes(text.encode())
    (tmp_path / "short.cpp").write_bytes(b"x")
    manifest = spark.createDataFrame(
        [(str(tmp_path / name), os.path.getsize(tmp_path / name) if name != "gone.cpp" else 9, "utf-8") for name in ("long.cpp", "short.cpp")]
        + [(str(tmp_path / "gone.cpp"), 9, "utf-8")],
        "path string, length long, label string",
    )
    chunks = read_chunks(manifest, 4096)
    sizes = {row["path"][-8:]: row for row in chunks.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).alias("bytes")).collect()}
    assert (sizes["long.cpp"]["n"], sizes["long.cpp"]["bytes"]) == (-(-len(text.encode()) // 4096), len(text.encode()))
    assert sizes["gone.cpp"]["bytes"] is None
    found = parts.chunk_findings(chunks).orderBy("finding_no").collect()
    assert len(found) == 10_000
    assert [(r["line"], r["char_position"], r["comment_context"]) for r in found[:2]] == [(1, 4, "code"), (1, 14, "comment")]
    assert (found[-1]["finding_no"], found[-1]["line"]) == (10_000, 5000)
    assert found[-1]["absolute_char_index"] == len(text) - 2


def test_no_content_is_shuffled(odd_files):
    """Only totals are ordered along a file; the plan of the scan has no exchange."""
    plan = parts.scanned_chunks(cut_files(odd_files, 64))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
