from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from encaudit import audit
from encaudit.operators import reports
from encaudit.operators.routing import originals_to_back_up, with_action

SUFFIXES = [".cs", ".py", ".cpp"]
# Words, the codec they are stored in, its label, and whether a conversion changes the file.
STORED = [
    ("żółta gęś, jaźń i świt", "iso8859-2", "iso-8859-2", True),
    ("tide pool", "ascii", "ascii", True),
    ("señal débil", "latin-1", "iso-8859-1", True),
    ("„Ærø“ – 7 €", "cp1252", "windows-1252", True),
    ("řeka \u2192 moře", "utf-8", "utf-8", False),
    ("река и море", "utf-8-sig", "utf-8-sig", False),
    ("θάλασσα", "utf-16", "utf-16", False),
]
FORMS = ["{0}\r\nreef = 3\r\n", "tide('{0}')\n\t{0}"]


def stored_files():
    for suffix in SUFFIXES:
        for number, (words, codec, label, changes) in enumerate(STORED):
            for form, template in enumerate(FORMS):
                yield f"/shore{number}/{codec}/f{form}{suffix}", template.format(words), codec, label, changes


def test_every_charset_and_suffix_end_to_end(make_files):
    cases = list(stored_files())
    files = make_files([(path, text.encode(codec), None) for path, text, codec, _, _ in cases]).drop("label")
    done = audit(files, SUFFIXES, checks=True, convert=True)
    converted = {r["path"]: bytes(r["content"]) for r in done.converted.collect()}
    assert converted == {path: text.encode("utf-8-sig") for path, text, _, _, changes in cases if changes}
    assert done.findings.count() == 0
    labels = {r["path"]: r["encoding_before"] for r in done.results.collect()}
    assert labels == {path: label for path, _, _, label, _ in cases}


def actions(make_files, content, label_path="/a.py", **options):
    files = make_files([(label_path, content, None)]).drop("label")
    row = with_action(files, [".py"], **options).first()
    return row["label"], row["action"]


@pytest.mark.parametrize(
    ("path", "content", "options", "expected"),
    [
        ("/a.bin", b"x", {"convert": True}, (None, "skip")),
        ("/a.py", b"", {}, (None, "error")),
        ("/a.py", b"caf\xe9", {"convert": True}, ("iso-8859-1", "convert")),
        ("/a.py", b"\x93x\x94", {}, ("windows-1252", "check")),
        ("/a.PY", b"x", {}, ("ascii", "check")),
        ("/a.py", b"x", {"convert": True}, ("ascii", "convert")),
        ("/a.py", b"x", {"checks": False}, ("ascii", "skip")),
        ("/a.py", b"x", {"repair": True, "convert": True}, ("ascii", "repair")),
        ("/a.py", "\xe9".encode(), {"convert": True, "checks": False}, ("utf-8", "skip")),
        ("/a.py", "x".encode("utf-8-sig"), {"convert": True, "checks": False}, ("utf-8-sig", "skip")),
        ("/a.py", "x".encode("utf-16"), {"convert": True, "checks": False}, ("utf-16", "skip")),
        ("/a.py", "xyz".encode("utf-16-le"), {"convert": True, "checks": False}, ("utf-16le", "skip")),
        ("/a.py", "xyz".encode("utf-16-be"), {"convert": True, "checks": False}, ("utf-16be", "skip")),
        ("/a.py", "x".encode("utf-32"), {"convert": True}, ("utf-32", "convert")),
    ],
)
def test_routing(make_files, path, content, options, expected):
    assert actions(make_files, content, path, **options) == expected


def test_backup_holds_only_files_to_convert_keyed_by_path(make_files):
    rows = [("/x/a.py", b"caf\xe9", None), ("/y/a.py", b"caf\xe8", None), ("/b.py", "\xe9".encode(), None)]
    kept = originals_to_back_up(make_files(rows).drop("label"), [".py"]).collect()
    assert {(r["path"], bytes(r["content"])) for r in kept} == {("/x/a.py", b"caf\xe9"), ("/y/a.py", b"caf\xe8")}


@pytest.fixture(scope="module")
def audited(spark):
    rows = [
        ("/ok.py", "x = 1 # \xe9 �\n�".encode()),
        ("/hidden.c", b"int \xe9 = 1; // \xef\xbf\xbd \n\xef\xbf\xbd"),
        ("/plain.txt", "�".encode("utf-16")),
        ("/skip.bin", b"x"),
        ("/bad.py", b"\x00"),
        ("/odd.py", b"\xff\xfea"),
        ("/unknown.py", b"abc"),
        ("/failed.py", b"\x81"),
    ]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    named = [("/unknown.py", "x-none"), ("/failed.py", "windows-1252")]
    overrides = spark.createDataFrame(named, "path string, encoding string")
    wanted = [".py", ".c", ".txt"]
    return (
        audit(files, wanted, overrides=overrides, with_string=True),
        audit(files, wanted, convert=True, overrides=overrides),
    )


def test_results_keep_errors_in_their_own_rows(audited):
    checked, converted = audited
    got = {r["path"]: (r["action"], r["error_description"]) for r in checked.results.collect()}
    assert got["/unknown.py"] == ("error", "Cannot decode unknown.py from x-none")
    assert got["/bad.py"] == ("error", "Cannot detect encoding of bad.py")
    assert got["/odd.py"] == ("check", None)
    assert got["/failed.py"] == ("check", None)
    assert got["/skip.bin"] == ("skip", None)
    again = {r["path"]: r for r in converted.results.collect()}
    assert again["/failed.py"]["error_description"] == "Cannot convert failed.py from windows-1252"
    assert not again["/failed.py"]["converted"]
    assert again["/hidden.c"]["encoding_after"] == "utf-8(BOM)"


def test_checked_without_findings_differs_from_not_checked(audited):
    rows = {r["path"]: r for r in audited[0].files.select("path", "checked", "findings").collect()}
    assert rows["/odd.py"]["checked"] and rows["/odd.py"]["findings"] == []
    assert not rows["/skip.bin"]["checked"] and rows["/skip.bin"]["findings"] is None


def test_reports(audited):
    tables = audited[0].reports(with_string=True)
    assert [tuple(r) for r in tables["encodings"].collect()] == [
        ("utf-16", 2, ""),
        ("iso-8859-1", 1, ""),
        ("utf-8", 1, ""),
        ("windows-1252", 1, ""),
        ("x-none", 1, ""),
        ("Undetected or skipped early", 2, "Unsupported extension or early processing error"),
    ]
    assert tuple(tables["detection"].first()) == (6, 8)
    assert tables["skipped_count"].first()["skipped_files"] == 1
    assert [tuple(r) for r in tables["skipped"].collect()] == [("skip.bin", "No action was required")]
    assert {r["path"] for r in tables["errors"].collect()} == {"/bad.py", "/unknown.py"}
    comments = {tuple(r) for r in tables["comments"].collect()}
    assert ("ok.py", True, 1, 10, 11, "x = 1 # \xe9 �") in comments
    assert len(comments) == 2
    code = {(r["file"], r["visible"], r["line"]) for r in tables["code"].collect()}
    assert code == {("ok.py", True, 2), ("hidden.c", False, 2)}
    assert [r["file"] for r in tables["unsupported"].collect()] == ["plain.txt"]
    relevant = audited[0].reports(only_relevant=True)
    assert "comments" not in relevant
    assert {r["file"] for r in relevant["code"].collect()} == {"ok.py"}
    done = {tuple(r) for r in audited[1].reports()["converted"].collect()}
    assert done == {("hidden.c", "iso-8859-1", "utf-8(BOM)")}


def test_totals_and_flattening(audited):
    files = audited[0].files
    assert tuple(reports.scan_totals(files.select("path"), audited[0].results).first()) == (8, 8)
    assert reports.flatten_findings(files).count() == audited[0].findings.count() == 5
    assert reports.findings_in_comments(audited[0].findings, only_relevant=True).count() == 0


def test_unreadable_and_oversized_files_give_error_rows(spark):
    files = spark.createDataFrame([("/a.py", None)], "path string, content binary")
    row = audit(files, [".py"]).results.first()
    assert (row["action"], row["error_description"]) == ("error", "Cannot read a.py")


def test_audit_is_one_map_over_the_files(make_files):
    from encaudit.operators.routing import audit_files

    plan = audit_files(make_files([("/a.py", b"x", None)]).drop("label"), [".py"], convert=True)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.where(F.col("converted")).count() == 1
