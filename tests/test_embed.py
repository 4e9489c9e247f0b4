"""A model gets a bounded part of the texts at a time."""

from postmill.operators import embed as E
from postmill.plans.registry import queries


def test_model_gets_few_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(E, "MODEL_BYTES", 100)
    rows = [(2**60 + i, "x" * 30) for i in range(40)] + [(None, "y" * 500), (7, None), (7, " \n"), (8, "")]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)

    def model():
        return lambda texts: [[float(len(t)), float(len(texts))] for t in texts]

    got = [(r["id"], r["embedding"]) for r in E.embed(docs, model, "id").collect()]
    assert sorted(i for i, v in got if v and v[0] == 30.0) == [2**60 + i for i in range(40)]
    assert max(v[1] for _, v in got if v) <= 3
    assert [i for i, v in got if v and v[0] == 500.0] == [None]
    assert sorted(i for i, v in got if v == []) == [7, 7, 8]


def test_query_takes_blank_texts(spark, tmp_path):
    rows = [(1, "ab\nc", 4), (2, None, None), (3, "", 0), (4, " \n\t ", 4), (None, "abc", 3), (1, "ab\nc", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries()["embed_with_model"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([
        (1, 4.0, 2), (1, 4.0, 2), (2, None, 0), (3, None, 0), (4, None, 0), (None, 3.0, 2)], key=str)


def test_query_takes_bytes_that_are_no_text(spark, tmp_path):
    bad = spark.sql("SELECT 1L AS doc_id, CAST(unhex('6162FF0A63') AS STRING) AS text UNION ALL SELECT 2L, 'é日'")
    bad.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries()["embed_with_model"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(1, 5.0, 2), (2, 2.0, 2)]
