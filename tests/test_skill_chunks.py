"""Skills are looked up in little text at a time."""

from postmill.operators import skills as K


def test_tasks_take_small_chunks(spark, monkeypatch):
    assert K.TASK_BYTES <= 1 << 20
    # Chunks of a text or two find the same.
    monkeypatch.setattr(K, "TASK_BYTES", 30)
    rows = [(i, f"uses Spark and SQL {i}" if i % 3 else None) for i in range(20)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    vocab = K.vocabulary(spark.createDataFrame([(1, "spark"), (2, "sql")], "line long, skill string"))
    for lemmas in (False, True):
        got = {r["id"]: r["skills"] for r in K.extract_skills(docs, vocab, lemmas=lemmas).collect()}
        assert all((got.get(i) or []) == (["spark", "sql"] if i % 3 else []) for i in range(20))
