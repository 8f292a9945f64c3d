from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from encaudit import audit
from encaudit.functions import charsets
from encaudit.functions.kinds import file_kind
from encaudit.operators.encoding import with_converted, with_label, with_plan, with_round_trip, with_text
from encaudit.operators.findings import findings
from tests import models

TEXT = "città è là\nniño größe\n"


@pytest.mark.parametrize(
    ("content", "label"),
    [
        (b"plain ascii\n", "ascii"),
        (TEXT.encode(), "utf-8"),
        (TEXT.encode("utf-8-sig"), "utf-8-sig"),
        (TEXT.encode("utf-16"), "utf-16"),
        (b"\xfe\xff" + TEXT.encode("utf-16-be"), "utf-16"),
        (TEXT.encode("utf-16-le"), "utf-16le"),
        (TEXT.encode("utf-16-be"), "utf-16be"),
        (TEXT.encode("utf-32"), "utf-32"),
        (TEXT.encode("latin-1"), "iso-8859-1"),
        ((TEXT + "“quoted” …").encode("cp1252"), "windows-1252"),
        (b"", None),
        (b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR", None),
        (b"text with \x00 in it", None),
        (b"\x00\x01", None),
        (b"\x00\x01\x02\x03", None),
        (b"\x01\x00\x02\x00", None),
        (b"bad \x81 byte \xff", None),
    ],
)
def test_detection(make_files, content, label):
    files = make_files([("/a.txt", content, None)]).drop("label")
    assert with_label(files).first()["label"] == label


def test_overrides_win_over_detection(spark, make_files):
    files = make_files([("/a", b"abc", None), ("/b", b"abc", None)]).drop("label")
    overrides = spark.createDataFrame([("/a", "windows-1252")], "path string, encoding string")
    got = {r["path"]: r["label"] for r in with_label(files, overrides).collect()}
    assert got == {"/a": "windows-1252", "/b": "ascii"}


def test_label_normalisation_and_families(spark):
    rows = spark.createDataFrame([(" ISO_8859_1\n",), ("UTF-8",), ("koi8_X",)], "label string")
    name = charsets.normalize_label(F.col("label"))
    got = rows.select(name.alias("n"), charsets.family_of(name).alias("f")).collect()
    assert [tuple(r) for r in got] == [("iso-8859-1", "single:latin-1"), ("utf-8", "utf8"), ("koi8-x", None)]


@pytest.mark.parametrize(
    ("content", "label", "expected"),
    [
        (b"a", "UTF_8", ("utf-8", "utf-8", "", 0)),
        (b"\xef\xbb\xbfa", "cp1252", ("utf-8-sig", "utf-8", "EFBBBF", 3)),
        (b"a", "utf-8-sig", ("utf-8-sig", "utf-8", "EFBBBF", 0)),
        (b"\xff\xfea\x00", "utf-8", ("utf-16", "utf-16-le", "FFFE", 2)),
        (b"\xfe\xff\x00a", "utf-8", ("utf-16", "utf-16-be", "FEFF", 2)),
        (b"a\x00", "utf-16", ("utf-16", "utf-16-le", "", 0)),
        (b"a\x00", "utf-16le", ("utf-16le", "utf-16le", "", 0)),
    ],
)
def test_decode_plan(make_files, content, label, expected):
    row = with_plan(make_files([("/a", content, label)])).select(
        "plan.decode_charset", "plan.write_charset", F.hex("plan.bom"), "plan.skip"
    )
    assert tuple(row.first()) == expected


def test_lossy_decoding_matches_python_codecs(make_files):
    seed = random.Random(3)
    codecs = {
        "utf-8": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "utf-32le": "utf-32-le",
        "ascii": "ascii", "windows-1252": "cp1252", "iso-8859-1": "latin-1",
    }
    bits = [b"\xd8", b"\xdc", b"\x00", b"a", b"\xe2", b"\x82", b"\xac", b"\xf0\x9f", b"\xff", b"\x81", b"\xc3", b"\n"]
    rows = []
    for number in range(3000):
        label = seed.choice(list(codecs))
        content = b"q" + b"".join(seed.choice(bits) for _ in range(seed.randrange(12)))
        rows.append((f"/{number}", content, label))
    got = {r["path"]: r["text"] for r in with_text(make_files(rows).repartition(8)).select("path", "text").collect()}
    for path, content, label in rows:
        if label == "utf-32le":
            units = [content[i : i + 4] for i in range(0, len(content), 4)]
            expected = "".join(u.decode("utf-32-le", "replace")[:1] for u in units)
        else:
            expected = content.decode(codecs[label], "replace")
        assert got[path] == expected, (label, content)


def test_conversion_writes_utf8_with_bom_and_isolates_bad_files(make_files):
    quoted = TEXT + "“x”"
    files = make_files(
        [
            ("/latin", TEXT.encode("latin-1"), "iso-8859-1"),
            ("/cp", quoted.encode("cp1252"), "windows-1252"),
            ("/ascii", b"plain", "ascii"),
            ("/utf32", TEXT.encode("utf-32"), "utf-32"),
            ("/undefined", b"\x81", "windows-1252"),
            ("/high", b"\x80", "ascii"),
            ("/odd", b"\xff\xfea", "utf-16"),
            ("/unknown", b"a", "x-none"),
        ]
    )
    got = {r["path"]: r["converted"] for r in with_converted(files).collect()}
    assert bytes(got["/latin"]) == TEXT.encode("utf-8-sig")
    assert bytes(got["/cp"]) == quoted.encode("utf-8-sig")
    assert bytes(got["/ascii"]) == b"\xef\xbb\xbfplain"
    assert bytes(got["/utf32"]) == TEXT.encode("utf-8-sig")
    assert [got[p] for p in ("/undefined", "/high", "/odd", "/unknown")] == [None] * 4


def test_round_trip_of_all_single_bytes_and_charsets(make_files):
    every = bytes(range(256))
    defined = bytes(b for b in range(256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
    astral = "a\xe9\U0001f600\n"
    rows = [
        ("/latin", every, "iso-8859-1"),
        ("/cp", defined, "windows-1252"),
        ("/8", astral.encode("utf-8-sig"), "utf-8"),
        ("/16le", astral.encode("utf-16"), "utf-16"),
        ("/16be", b"\xfe\xff" + astral.encode("utf-16-be"), "utf-16"),
        ("/32", astral.encode("utf-32"), "utf-32"),
    ]
    for row in with_round_trip(make_files(rows)).collect():
        assert bytes(row["rewritten"]) == bytes(row["content"]), row["path"]


def test_byte_offset_agrees_with_findings(make_files):
    text = f"a\xe9{models.MARK}\U0001f600{models.MARK}\n{models.MARK}"
    rows = [(f"/{c}", text.encode(c), c) for c in ("utf-8", "utf-8-sig", "utf-16")]
    files = make_files(rows)
    places = findings(files).select("path", "absolute_char_index", "byte_sequence_file_pos")
    joined = with_text(files).join(places, "path")
    offset = charsets.byte_offset(F.col("text"), F.col("plan"), F.col("absolute_char_index").cast("int"))
    assert joined.where(offset != F.col("byte_sequence_file_pos")).count() == 0
    assert joined.count() == 9


@pytest.mark.parametrize(
    ("content", "kind"),
    [
        (b"", "text"),
        (b"print('x')\n", "text"),
        ("text".encode("utf-16"), "text"),
        ("text".encode("utf-16-le") * 3000, "text"),
        (("\xe9" * 4000).encode("utf-16-be"), "text"),
        (b"\x00\x01payload", "binary"),
        (b"\x01\x02\x03abc", "binary"),
        (b"\x01abcdefgh", "text"),
        (b"a" * 4095 + "\xe9".encode(), "text"),
        (b"a" * 4094 + "€".encode() + b"tail", "text"),
        (b"\xef\xbb\xbf\xff\xff", "binary"),
        (b"caf\xe9", "text"),
        (b"bad \x81\x8d", "binary"),
        (b"a" * 4096 + b"\x00" * 50, "text"),
    ],
)
def test_file_kind(make_files, content, kind):
    files = make_files([("/a", content, None)])
    assert files.select(file_kind(F.col("content"), F.col("length")).alias("k")).first()["k"] == kind


def test_every_single_byte_charset_matches_its_codec(make_files):
    every = bytes(range(256))
    rows = []
    for codec, spellings in charsets.SINGLE_BYTE.items():
        rows += [(f"/{codec}/{number}", every, name) for number, name in enumerate(spellings)]
    files = make_files(rows)
    texts = {r["path"]: r["text"] for r in with_text(files).select("path", "text").collect()}
    converted = {r["path"]: r["converted"] for r in with_converted(files).select("path", "converted").collect()}
    for path, _, _ in rows:
        codec = path.split("/")[1]
        text = every.decode(codec, "replace")
        assert texts[path] == text, codec
        expected = None if models.MARK in text else text.encode("utf-8-sig")
        assert (converted[path] and bytes(converted[path])) == expected, codec
    defined = [(p, every.decode(p.split("/")[1], "ignore").encode(p.split("/")[1]), n) for p, _, n in rows]
    for row in with_round_trip(make_files(defined)).collect():
        assert bytes(row["rewritten"]) == bytes(row["content"]), row["label"]


def test_encodable_characters(spark):
    rows = [("я", "koi8-r"), ("é", "koi8-r"), ("€", "cp1252"), ("\x81", "cp1252"), (models.MARK, "cp1252")]
    table = spark.createDataFrame([(t, f"single:{c}") for t, c in rows], "text string, family string")
    got = table.select(charsets.is_encodable(F.col("text"), F.col("family")).alias("e")).collect()
    assert [r["e"] for r in got] == [True, False, True, False, False]


def test_multi_byte_charsets_convert_when_the_session_allows_them(spark, make_files):
    texts = {"shift_jis": "\u65e5\u672c\u8a9e \u30c6\u30ad\u30b9\u30c8\n", "euc_jp": "\u65e5\u672c\u8a9e\n", "gb18030": "\u4e2d\u6587\U0001f600\n", "gb2312": "\u4e2d\u6587\n", "big5": "\u4e2d\u6587\n", "euc_kr": "\ud55c\uad6d\uc5b4\n"}
    rows = [(f"/{codec}.txt", text.encode(codec), codec.upper()) for codec, text in texts.items()]
    rows += [("/bad.txt", b"\x81", "EUC-KR"), ("/hit.txt", "\u65a4\u62f7".encode("gb2312") + b"\xef\xbf\xbd\xef\xbf\xbd", "gb2312")]
    files = make_files(rows)
    refused = {r["path"]: r["converted"] for r in with_converted(files).collect()}
    assert set(refused.values()) == {None}
    names = ["spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction"]
    try:
        for name in names:
            spark.conf.set(name, "true")
        got = {r["path"]: r["converted"] for r in with_converted(files).collect()}
        for codec, text in texts.items():
            assert bytes(got[f"/{codec}.txt"]) == text.encode("utf-8-sig"), codec
        assert got["/bad.txt"] is None
        overrides = files.selectExpr("path", "label AS encoding")
        done = audit(files.drop("label"), [".txt"], overrides=overrides)
        assert done.results.where("error_skipped").count() == 0
        found = [(r["path"], r["byte_sequence_file_pos"], r["char_found"]) for r in done.findings.collect()]
        assert sorted(found) == [("/hit.txt", n, False) for n in (1, 4, 7)]
    finally:
        for name in names:
            spark.conf.unset(name)
