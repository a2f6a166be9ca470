"""The corpus pipeline, stage by stage, on the smallest table and on odd rows."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def through(spark, docs, tmp_path):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out.append(docs)
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    language, lines, near, mixed, packed = through(spark, docs, tmp_path)
    assert all(x.columns == COLUMNS for x in (language, lines, near, mixed))
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in language.collect()} == ids  # all documents have letters and a language
    assert {r.doc_id for r in lines.collect()} == ids
    assert len(near.collect()) <= len(ids)
    rows = packed.collect()
    copies = mixed.groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in copies}
    whole = sum(r["length"] for r in rows)
    assert whole == sum(r["doc_tokens"] for r in rows if r["start"] == 0)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, 0, "x"), (2, "", "en", "a", 0, "x"), (3, "words in a line\nwords in a line", "en", "a", 31, "x"), (3, "words in a line\nwords in a line", "en", "a", 31, "x"), (None, "andere Wörter hier", "de", None, 18, "x"), (5, "1 2 3", "en", "b", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed string")
    language, lines, near, mixed, packed = through(spark, docs, tmp_path)
    assert sorted(str(r.doc_id) for r in language.collect()) == ["3", "3", "None"]
    assert {(r.doc_id, r.text, r.n_chars, r.n_removed) for r in lines.collect()} == {(3, "words in a line", 15, "x"), (None, "andere Wörter hier", 18, "x")}
    assert near.count() == 2
    assert packed.count() >= 1


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert through(spark, docs, tmp_path)[-1].count() == 0
