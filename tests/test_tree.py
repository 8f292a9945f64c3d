from __future__ import annotations

import os

import pytest

from pyspark.sql import functions as F

from encaudit import audit, audit_tree, census, repair_tree
from encaudit.functions import paths
from encaudit.operators.census import census_totals, extension_census, text_extensions
from encaudit.operators.selection import pruned_directories
from encaudit.session import settle
from encaudit.sources import tree
from encaudit.sources.tables import export_files, write_contents
from encaudit.streaming.arrivals import arriving_files, arriving_findings


@pytest.fixture
def folder(tmp_path):
    files = {
        "kelp.py": b"depth = 4\n",
        "LICENCE": b"free\n",
        "wave.cpp": "int crest;\n".encode("utf-16"),
        "shell.dat": b"\x07\x00\x08",
        ".tide.py": b"# low\n",
        "_foam.py": b"# high\n",
        ".jj/store.py": b"s",
        "bay/.jj/vendor/pier.py": b"p",
        "bay/a b+c%20.py": b"# odd name\n",
        "bay/vendor/x/.jj/y.js": b"y",
        "bay/cove/\u00e8.h": b"int e;\n",
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (tmp_path / "bay/cove/vendor").mkdir()
    os.symlink(tmp_path / "bay", tmp_path / "linked")
    os.symlink(tmp_path / "gone", tmp_path / "broken.txt")
    return tmp_path, files


SEEN = {
    "kelp.py", "LICENCE", "wave.cpp", "shell.dat", ".tide.py", "_foam.py", "broken.txt",
    "bay/a b+c%20.py", "bay/cove/\u00e8.h",
}


@pytest.mark.parametrize("form", ["{0}", "{0}/", "file:{0}", "file://{0}", "file://localhost{0}/"])
def test_walk_sees_hidden_files_and_prunes_before_descent(spark, folder, form):
    root, contents = folder
    entries = settle(tree.walk(spark, form.format(root), [" .jj", "vendor", ""]))
    assert {r["relative_path"] for r in entries.where("kind = 'file'").collect()} == SEEN
    skipped = {r["directory"] for r in tree.skipped_directories(entries).collect()}
    assert skipped == {".jj", "bay/.jj", "bay/vendor", "bay/cove/vendor"}
    read = tree.read_contents(entries.where("kind = 'file'")).collect()
    got = {r["relative_path"]: r["content"] for r in read}
    assert got.pop("broken.txt") is None
    assert {name: bytes(content) for name, content in got.items()} == {n: contents[n] for n in got}


def test_stores_of_arrow_take_paths_literally(spark, folder, monkeypatch):
    """A store other than the local one, through Arrow's own handling of URIs."""
    root, contents = folder
    from pyarrow import fs

    def opened(path):
        return fs.SubTreeFileSystem(str(root), fs.LocalFileSystem()), path.partition("://")[2].partition("/")[2]

    monkeypatch.setattr(tree, "_system", opened)
    names = {name for name, *_ in tree._entries("mem://store/bay")}
    assert names == {".jj", "a b+c%20.py", "vendor", "cove"}
    assert tree._read("mem://store/bay/a b+c%20.py", None) == contents["bay/a b+c%20.py"]


def test_wrong_paths_raise(spark, folder, monkeypatch):
    root, _ = folder
    for wrong in (f"{root}/gone", f"file:{root}/gone"):
        with pytest.raises(FileNotFoundError):
            tree.listing_of(spark, wrong)
    with pytest.raises(FileNotFoundError):
        audit_tree(spark, f"{root}/gone", [".py"])
    with pytest.raises(NotADirectoryError):
        tree.walk(spark, f"{root}/kelp.py")
    with pytest.raises(ValueError, match="nowhere://"):
        tree.listing_of(spark, "nowhere://a/b")
    monkeypatch.chdir(root / "bay")
    assert [r["path"] for r in tree.listing_of(spark, "a b+c%20.py").collect()] == [f"{root}/bay/a b+c%20.py"]
    assert tree.listing_of(spark, "cove").count() == 1


def test_unreadable_directories_are_error_rows(spark, folder, monkeypatch):
    root, _ = folder
    level = spark.createDataFrame([(f"{root}/bay/none", "bay/none/", "directory", 0, None)], tree._ENTRY)
    found = level.select("path", "relative_path").mapInArrow(tree._list_level([]), tree._ENTRY).collect()
    assert [(r["relative_path"], r["kind"]) for r in found] == [("bay/none", "unreadable")]
    files = tree.list_files(spark, str(root / "bay")).withColumn("unreadable", F.lit(False))
    gone = files.limit(1).withColumns({"path": F.lit(f"{root}/bay/none"), "unreadable": F.lit(True)})
    listed = tree.read_contents(files).unionByName(gone.withColumn("content", F.lit(None).cast("binary")))
    errors = audit(listed, [".py"]).results.where("error_skipped").collect()
    assert [(r["path"], r["error_description"]) for r in errors] == [(f"{root}/bay/none", "Cannot read none")]


def test_the_root_itself_is_never_pruned(spark, folder):
    root, _ = folder
    listing = tree.list_files(spark, str(root / ".jj"), [".jj"])
    assert [r["relative_path"] for r in listing.collect()] == ["store.py"]


def test_heads_hold_the_first_bytes(spark, folder):
    root, _ = folder
    listing = tree.list_files(spark, str(root)).where("relative_path = 'kelp.py'")
    assert bytes(tree.read_heads(listing, 3).first()["content"]) == b"dep"


def test_single_file_is_not_pruned(spark, folder):
    root, _ = folder
    one = tree.single_file(spark, str(root / ".jj" / "store.py")).first()
    assert (one["path"], one["length"]) == (str(root / ".jj" / "store.py"), 1)


def test_visible_files_by_the_builtin_reader(spark, folder):
    root, _ = folder
    got = tree.scan_visible_files(spark, str(root), ["vendor", "x", "linked"], glob="*.{py,h}")
    names = {r["path"].split(f"{root}/")[1] for r in got.select("path").collect()}
    assert names == {"kelp.py", "bay/a b+c%20.py", "bay/cove/\u00e8.h"}


def test_pruning_the_builtin_reader_happens_before_reading(spark, folder):
    root, _ = folder
    files = tree.scan_visible_files(spark, str(root), ["cove"])
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "Exchange" not in plan


def test_census(spark, folder):
    root, _ = folder
    table = settle(census(spark, str(root), [".jj", "vendor"]))
    rows = {r["extension"]: (r["files"], r["kind"]) for r in table.collect()}
    assert rows == {
        ".py": (4, "text"),
        "(no extension)": (1, "text"),
        ".cpp": (1, "text"),
        ".dat": (1, "binary"),
        ".h": (1, "text"),
        ".txt": (1, "binary"),
    }
    assert tuple(census_totals(table).first()) == (9, 6)


def test_census_order_and_hint(make_files):
    rows = [(f"/{n}.rs", b"r", None) for n in range(3)] + [("/a.odt", b"\x00", None), ("/b.odt", b"o", None)]
    rows += [("/c.odt", b"\x00", None), ("/z.o", b"\x00\x01", None), ("/plain", b"p", None), ("/more", b"m", None)]
    table = extension_census(make_files(rows))
    assert [(r["extension"], r["kind"]) for r in table.collect()] == [
        (".odt", "mixed (1 text / 2 binary)"),
        (".rs", "text"),
        ("(no extension)", "text"),
        (".o", "binary"),
    ]
    assert [r["extension"] for r in text_extensions(table).collect()] == [".odt", ".rs"]


@pytest.mark.parametrize(
    "name",
    ["a.py", ".bashrc", "a.tar.gz", "a.", "a", "..", "..py", "a.B.C", ".a.b", "x.p y", "a\n.c"],
)
def test_extension_agrees_with_splitext(spark, name):
    row = spark.createDataFrame([("/dir.d/" + name,)], "path string")
    expected = os.path.splitext(name)[1].lower()
    assert row.select(paths.extension(F.col("path")).alias("e")).first()["e"] == expected


def test_pruned_directories_report_topmost_only(spark):
    rows = spark.createDataFrame(
        [("a/.git/node_modules/x.py",), ("a/.git/y.py",), ("b/c.py",), (".git",), ("node_modules/.git/z",)],
        "relative_path string",
    )
    got = pruned_directories(rows, [".git", "node_modules"], "relative_path").collect()
    assert {r["directory"] for r in got} == {"a/.git", "node_modules"}
    assert len(got) == 2


def test_exporting_contents(spark, make_files, tmp_path):
    rows = [("/x/a.txt", b"one", None), ("/x/y/a.txt", b"two", None), ("/.z", b"", None)]
    files = make_files(rows)
    export_files(files, str(tmp_path / "out"))
    for path, content, _ in rows:
        assert (tmp_path / "out" / path[1:]).read_bytes() == content
    write_contents(files, str(tmp_path / "backup"))
    kept = {r["path"]: bytes(r["content"]) for r in spark.read.parquet(str(tmp_path / "backup")).collect()}
    assert kept == {path: content for path, content, _ in rows}
    with pytest.raises(Exception, match="leaves the target"):
        export_files(make_files([("../up.txt", b"x", None)]), str(tmp_path / "out"))


def test_findings_of_arriving_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.c").write_bytes("// �\n".encode())
    (source / "two.py").write_bytes("x � # �".encode("utf-16"))
    (source / "three.bin").write_bytes("�".encode())
    stream = arriving_findings(arriving_files(spark, str(source), 1), [".C", ".py"])
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "found"))
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "found")).collect()
    assert sorted((r["file_name"], r["comment_context"], r["byte_sequence_file_pos"]) for r in got) == [
        ("one.c", "comment", 3), ("two.py", "code", 6), ("two.py", "comment", 14),
    ]


def test_auditing_a_tree_opens_only_wanted_files(spark, folder):
    root, files = folder
    done = audit_tree(
        spark, str(root), [".py", ".CPP", ".txt"], [".jj", "vendor"], convert=True, keep_originals=True
    )
    results = {r["path"][len(str(root)) + 1 :]: r for r in done.results.collect()}
    assert {name: r["action"] for name, r in results.items()} == {
        "kelp.py": "convert", "LICENCE": "skip", "wave.cpp": "check", "shell.dat": "skip",
        ".tide.py": "convert", "_foam.py": "convert", "broken.txt": "error",
        "bay/a b+c%20.py": "convert", "bay/cove/è.h": "skip",
    }
    assert results["broken.txt"]["error_description"] == "Cannot read broken.txt"
    originals = {r["path"][len(str(root)) + 1 :]: bytes(r["content"]) for r in done.originals.collect()}
    names = ["kelp.py", ".tide.py", "_foam.py", "bay/a b+c%20.py"]
    assert originals == {name: files[name] for name in names}
    converted = {r["path"][len(str(root)) + 1 :]: bytes(r["content"]) for r in done.converted.collect()}
    assert converted == {name: b"\xef\xbb\xbf" + files[name] for name in names}


def test_auditing_and_repairing_one_file(spark, tmp_path):
    path = tmp_path / "one.txt"
    path.write_bytes("x � y".encode())
    assert audit_tree(spark, str(path), [".txt"]).findings.count() == 1
    assert audit_tree(spark, str(path), [".md"]).results.first()["action"] == "skip"
    named = spark.createDataFrame([(str(path), "cp1252")], "path string, encoding string")
    assert not audit_tree(spark, str(path), [".txt"], overrides=named).findings.first()["char_found"]
    table = "path string, absolute_char_index bigint, rank int, suggestion string"
    proposals = spark.createDataFrame([(str(path), 2, 1, "e")], table)
    done = repair_tree(spark, str(path), [".txt"], proposals=proposals)
    assert bytes(done.contents.first()["content"]) == b"x e y"
    assert path.read_bytes() == "x � y".encode()
