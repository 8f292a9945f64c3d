"""The registered queries over whole test tables, and the pipeline."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from encaudit.llm import pii
from tests.llm import plain

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def table(name, *columns):
    return duckdb.sql(f"SELECT {', '.join(columns)} FROM '{SF_DIR}/{name}.parquet'").fetchall()


def run(spark, name, *columns):
    found = queries()[name](spark, SF_DIR)
    return sorted(tuple(row) for row in found.select(*columns or found.columns).collect())


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries() if name.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries()
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding",
    ]


@needs_tables
@pytest.mark.parametrize("name", ["op1_url_filter", "op6_decontamination", "op10_exact_dedup", "op11_hard_negatives", "op12_collocations"])
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for one in ("documents", "pages", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {one} AS SELECT * FROM '{SF_DIR}/{one}.parquet'")
    cursor = connection.execute(oracle_sql()[name])
    columns = [item[0] for item in cursor.description]
    expected = sorted(cursor.fetchall(), key=str)
    assert expected and sorted(run(spark, name, *columns), key=str) == expected


@needs_tables
def test_line_query(spark):
    found = {row[0]: (row[1], list(zip(row[2], row[3]))) for row in run(spark, "op2_line_dedup", "doc_id", "n_lines", "removed", "kept_in")}
    assert found == plain.line_rows(table("documents", "doc_id", "text"))


@needs_tables
def test_token_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for doc, text in table("documents", "doc_id", "text"):
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc, len(ids), plain.sha(np.array(ids, "<u4").tobytes()), plain.sha(decoded)))
    assert run(spark, "op3_bpe") == sorted(expected)


@needs_tables
def test_toxicity_query(spark):
    docs, labels = table("documents", "doc_id", "text"), table("labels", "doc_id", "toxic")
    expected = {doc: round(score, 9) for doc, score in plain.toxic_scores(docs, labels).items()}
    assert {row[0]: round(row[1], 9) for row in run(spark, "op4_toxicity", "doc_id", "score")} == expected


@needs_tables
def test_secret_query(spark):
    found = run(spark, "op5_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert found == plain.secret_rows(table("documents", "doc_id", "text"))


@needs_tables
def test_personal_data_query(spark):
    found = run(spark, "op7_pii", "doc_id", "n_mentions", "replaced", "text")
    texts = dict(table("documents", "doc_id", "text"))
    assert [row[0] for row in found] == sorted(texts)
    real = {mention["entity"] for text in texts.values() for mention in pii.mentions(text)}
    assert real
    given = defaultdict(set)
    for doc, n, spans, text in found:
        mentions = pii.mentions(texts[doc])
        assert n == len(mentions) and (n > 0) == bool(spans) == (text is not None)
        if text is not None:
            shown = pii.mentions(text)
            assert [one["kind"] for one in shown] == [one["kind"] for one in mentions]
            assert not {one["entity"] for one in shown} & real
            for before, after in zip(mentions, shown):
                given[before["kind"], before["entity"]].add(after["entity"])
    assert all(len(after) == 1 for after in given.values())
    assert len({(kind, *after) for (kind, _), after in given.items()}) == len(given)


@needs_tables
def test_repeat_query(spark):
    assert run(spark, "op8_suffix_dedup") == sorted(plain.repeat_rows(table("documents", "doc_id", "text")))


@needs_tables
def test_fingerprint_query(spark):
    assert run(spark, "op9_simhash") == plain.simhash_rows(table("documents", "doc_id", "text"))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Toxic, copied, nearly copied and contaminated documents among clean ones, as tables."""
    rnd = random.Random(12)
    words = [a + b for a in "bra cle dri flo gru pla sto tre".split() for b in "ck m nd rt sp ve x".split()]

    def text(n):
        return " ".join(rnd.choices(words, k=n))

    docs = [(k, "\n".join(text(rnd.randrange(12, 40)) for _ in range(3))) for k in range(120)]
    docs = [(k, f"{t} swinehound" if k % 5 == 0 else t) for k, t in docs]
    items = [(k, text(20)) for k in range(4)]
    docs += [(200 + k, f"{text(30)}\n{items[k][1]} {text(3)}") for k in range(4)]
    docs += [(300, docs[1][1]), (301, docs[2][1] + " " + text(2)), (302, docs[3][1].replace("\n", " ")), (303, ""), (304, None)]
    labels = [(k, 1, int(k % 5 == 0)) for k in range(120)]
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, t, "xx", "src0", len(t or "")) for k, t in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, labels, items


def expected_pipeline(docs, labels, items):
    scores = plain.toxic_scores(docs, [(doc, toxic) for doc, _, toxic in labels])
    docs = [(doc, text) for doc, text in docs if scores[doc] < 0.3]
    kept = []
    for doc, text in docs:
        n, gone = plain.line_rows(docs)[doc]
        dropped = {k for k, _ in gone}
        if not n or len(gone) < n:
            lines = enumerate((text or "").split("\n"))
            kept.append((doc, text if not gone else "\n".join(line for k, line in lines if k not in dropped)))
    stays = {root for _, _, root in plain.simhash_rows(kept)}
    kept = [(doc, text) for doc, text in kept if doc in stays]
    bad = {row[0] for row in plain.contamination_rows(kept, items) if row[5]}
    return {doc: text for doc, text in kept if doc not in bad}


def test_pipeline_matches_plain_python(spark, corpus):
    folder, docs, labels, items = corpus
    expected = expected_pipeline(docs, labels, items)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {row["doc_id"]: row for row in corpus_pipeline.run(spark, folder).collect()}
    assert set(rows) == set(expected)
    assert not {doc for doc in rows if doc < 120 and doc % 5 == 0}
    assert not {200, 201, 202, 203, 300} & set(rows)
    for doc, text in expected.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(rows[doc]["ids"], "<u4").tolist() == ids
        assert rows[doc]["decoded_sha256"] == plain.sha(text or "")


def test_stages_return_the_columns_of_documents(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), folder).count() == 0
    lengths = corpus_pipeline.drop_lines(spark, docs, folder).where("n_chars <> length(coalesce(text, ''))")
    assert lengths.count() == 0
