from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from encaudit.functions.suggestions import sanitize_suggestion
from encaudit.operators import repair as steps
from encaudit.operators.findings import damaged_lines, findings, with_lines
from encaudit.operators.skew import lookup_join
from encaudit.plans.repair import repair
from tests.models import MARK

LINE = f"the na{MARK}ve reading\n"


@pytest.mark.parametrize(
    ("answer", "expected"),
    [
        ('{"character":"è"}', "è"),
        (' {"replacement": "e"}\n', "e"),
        ('{"character": 1, "char": "x"}', "x"),
        ('{"character": "ab"}', None),
        ('{"character": "ab", "char": "x"}', None),
        ('{"other": "x"}', None),
        ('"à"', "à"),
        ("e", "e"),
        ("   e ", "e"),
        ("5", None),
        ("true", None),
        ("null", None),
        ('["e"]', None),
        ("", None),
        ("  ", None),
        ("ab", None),
        (MARK, None),
        (f'{{"character":"{MARK}"}}', None),
        ("-", "-"),
        ("\U0001f600", "\U0001f600"),
        ('{"character": "e"', None),
    ],
)
def test_sanitizing(spark, answer, expected):
    row = spark.createDataFrame([(answer,)], "answer string")
    assert row.select(sanitize_suggestion(F.col("answer")).alias("s")).first()["s"] == expected


def proposals(spark, rows):
    return spark.createDataFrame(rows, "path string, absolute_char_index bigint, rank int, suggestion string")


def decisions(spark, rows):
    return spark.createDataFrame(rows, "path string, absolute_char_index bigint, rank int, decision string")


def outcome(done):
    summary = {r["path"]: r for r in done.summary.collect()}
    contents = {r["path"]: bytes(r["content"]) for r in done.contents.collect()}
    return summary, contents


def test_accepted_retried_skipped_and_failed(spark, make_files):
    index = LINE.index(MARK)
    files = make_files(
        [
            ("/sig.txt", LINE.encode("utf-8-sig"), None),
            ("/wide.txt", LINE.encode("utf-16"), None),
            ("/big.txt", b"\xfe\xff" + LINE.encode("utf-16-be"), None),
            ("/retry.txt", LINE.encode(), None),
            ("/none.txt", LINE.encode(), None),
            ("/open.txt", LINE.encode(), None),
            ("/clean.txt", b"nothing here\n", None),
            ("/other.bin", LINE.encode(), None),
        ]
    ).drop("label")
    offered = proposals(
        spark,
        [
            ("/sig.txt", index, 1, "e"),
            ("/wide.txt", index, 1, "è"),
            ("/big.txt", index, 1, "a"),
            ("/big.txt", index, 2, "\U0001f600"),
            ("/retry.txt", index, 1, "1"),
            ("/retry.txt", index, 2, "2"),
            ("/none.txt", index, 1, None),
            ("/open.txt", index, 1, "x"),
        ],
    )
    said = decisions(
        spark,
        [
            ("/sig.txt", index, 1, "apply"),
            ("/wide.txt", index, 1, "apply"),
            ("/big.txt", index, 1, "retry"),
            ("/big.txt", index, 2, "apply"),
            ("/retry.txt", index, 1, "retry"),
            ("/retry.txt", index, 2, "skip"),
            ("/none.txt", index, 1, "apply"),
        ],
    )
    done = repair(files, [".txt"], proposals=offered, decisions=said, automatic=False)
    summary, contents = outcome(done)
    assert contents == {
        "/sig.txt": LINE.replace(MARK, "e").encode("utf-8-sig"),
        "/wide.txt": LINE.replace(MARK, "è").encode("utf-16"),
        "/big.txt": b"\xfe\xff" + LINE.replace(MARK, "\U0001f600").encode("utf-16-be"),
    }
    counters = ["total", "applied", "skipped", "retries", "failed", "remaining"]
    got = {path: tuple(row[c] for c in counters) for path, row in summary.items()}
    assert got == {
        "/sig.txt": (1, 1, 0, 0, 0, 0),
        "/wide.txt": (1, 1, 0, 0, 0, 0),
        "/big.txt": (1, 1, 0, 1, 0, 0),
        "/retry.txt": (1, 0, 1, 1, 0, 1),
        "/none.txt": (1, 0, 0, 0, 1, 1),
        "/open.txt": (1, 0, 0, 0, 0, 1),
        "/clean.txt": (0, 0, 0, 0, 0, 0),
    }
    assert summary["/clean.txt"]["file_skipped"] and not summary["/retry.txt"]["file_skipped"]
    status = {r["path"]: r["status"] for r in done.repairs.collect()}
    assert status["/open.txt"] == "open"


def test_hidden_damage_is_counted_and_left_alone(spark, make_files):
    content = b"old caf\xef\xbf\xbd menu\n"
    files = make_files([("/a.txt", content, None)]).drop("label")
    overrides = spark.createDataFrame([("/a.txt", "cp1252")], "path string, encoding string")
    offered = proposals(spark, [("/a.txt", 7, 1, "e")])
    done = repair(files, [".txt"], proposals=offered, automatic=True, overrides=overrides)
    summary, contents = outcome(done)
    row = summary["/a.txt"]
    assert (row["total"], row["applied"], row["failed"], row["remaining"]) == (1, 0, 0, 1)
    assert contents == {}


def test_unencodable_repair_fails_and_leaves_the_file(spark, make_files):
    files = make_files([("/a.txt", b"z\xef\xbf\xbdro\n", None)]).drop("label")
    overrides = spark.createDataFrame([("/a.txt", "ascii")], "path string, encoding string")
    offered = proposals(spark, [("/a.txt", 1, 1, "é")])
    done = repair(files, [".txt"], proposals=offered, automatic=True, overrides=overrides)
    summary, contents = outcome(done)
    assert (summary["/a.txt"]["failed"], summary["/a.txt"]["applied"]) == (1, 0)
    assert contents == {}


def test_malformed_rest_of_a_repaired_file_is_written_as_read(make_files, spark):
    content = b"\xef\xbb\xbfa \xef\xbf\xbd b \xff\n"
    files = make_files([("/a.txt", content, None)]).drop("label")
    done = repair(files, [".txt"], proposals=proposals(spark, [("/a.txt", 2, 1, "e")]), automatic=True)
    summary, contents = outcome(done)
    assert contents["/a.txt"] == b"\xef\xbb\xbfa e b \xef\xbf\xbd\n"
    assert summary["/a.txt"]["remaining"] == 1


def test_corpus_repair_restores_known_words(spark, make_files):
    clean = spark.createDataFrame([("città perché città peréhé naïve",)], "text string")
    damaged = "citt� perch� na�ve zz�"
    rows = [("/a.txt", damaged.encode(), None), ("/b.txt", damaged.encode("utf-16"), None)]
    done = repair(make_files(rows).drop("label"), [".txt"], clean_texts=clean)
    _, contents = outcome(done)
    fixed = "città perché naïve zz�"
    assert contents == {"/a.txt": fixed.encode(), "/b.txt": fixed.encode("utf-16")}
    assert {r["status"] for r in done.repairs.collect()} == {"applied", "failed"}


def test_candidates_rank_by_the_most_frequent_word(spark):
    texts = spark.createDataFrame([("pèche pèche pêche péché péché péché",)], "text string")
    ranked = steps.candidates(steps.vocabulary(texts)).collect()
    got = {(r["pattern"], r["word_offset"], r["rank"]): (r["suggestion"], r["support"]) for r in ranked}
    assert got == {
        (f"p{MARK}che", 1, 1): ("è", 2),
        (f"p{MARK}che", 1, 2): ("ê", 1),
        (f"p{MARK}ch{MARK}", 1, 1): ("é", 3),
        (f"p{MARK}ch{MARK}", 4, 1): ("é", 3),
    }


def test_gaps_in_decisions_do_not_count_as_retries(spark):
    said = decisions(spark, [("/a", 1, 2, "retry"), ("/b", 1, 1, "retry"), ("/b", 1, 3, "apply")])
    got = {r["path"]: (r["retries"], r["decision"]) for r in steps.decided_ranks(said).collect()}
    assert got == {"/a": (0, None), "/b": (1, None)}


def test_repair_context_and_external_scorer(spark, make_files):
    files = make_files([("/a.c", f"\tint x; // caff{MARK} nero\r\n".encode(), "utf-8"), ("/B", MARK.encode(), "utf-8")])
    found = with_lines(findings(files), damaged_lines(files))
    index = f"\tint x; // caff{MARK}".index(MARK)
    made = proposals(spark, [("/a.c", index, 1, "e"), ("/a.c", index, 2, "é")])
    said = decisions(spark, [("/a.c", index, 1, "retry"), ("/a.c", index, 2, "retry")])
    context = steps.repair_context(found, steps.rejected_suggestions(made, said))
    rows = {r["path"]: r for r in context.collect()}
    assert rows["/a.c"]["left_context"] == "\tint x; // caff"
    assert rows["/a.c"]["right_context"] == " nero"
    assert rows["/a.c"]["rejected"] == "e, é"
    assert (rows["/B"]["extension"], rows["/B"]["rejected"]) == ("unknown", "none")

    def scorer(batch: pd.DataFrame) -> pd.Series:
        return batch["left_context"].map(lambda left: '{"character": "è"}' if left else "too long")

    answers = {r["path"]: r["suggestion"] for r in steps.propose_with(context, scorer, 3).collect()}
    assert answers == {"/a.c": "è", "/B": None}


def test_repair_context_shuffles_each_line_once(spark, make_files):
    """With ``lines`` the texts join last: rows of findings go through their shuffles without them."""
    files = make_files([("/a.c", (f"ab{MARK}cd " * 20).encode() + b"\nno\n" + MARK.encode(), "utf-8")])
    found, lines = findings(files), damaged_lines(files)
    first = found.select(*steps.PLACE).withColumn("rank", F.lit(1))
    made, said = first.withColumn("suggestion", F.lit("e")), first.withColumn("decision", F.lit("retry"))
    rejected = steps.rejected_suggestions(made, said)
    apart = steps.repair_context(found, rejected, lines=lines)
    assert apart.count() == 21
    assert apart.exceptAll(steps.repair_context(with_lines(found, lines), rejected)).count() == 0
    last_join = apart._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1].splitlines()[0]
    assert "line#" in last_join


def test_lookup_join_splits_a_hot_key(spark):
    rows = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 'hot', concat('k', id % 50)) AS key")
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("unused", 3)], "key string, value int")
    joined = lookup_join(rows, lookup, ["key"], ["id"], parts=30)
    plain = rows.join(lookup, "key", "left")
    assert joined.count() == 3000
    assert joined.select("id", "key", "value").exceptAll(plain.select("id", "key", "value")).count() == 0
