"""The verdict of the quality rules is made in a text's own row."""

from postmill.llm import quality

from conftest import labels_for


def test_quality_verdict_needs_no_shuffle(spark):
    rows = [(i, f"some words of text {i} that are judged by their grams # one") for i in range(20)] + [(None, None), (20, " "), (20, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = quality.judge(docs, labels_for(spark, rows, quality=lambda d: int(d % 2)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_grams"], r["ratio"] is None) for r in found.collect()}
    assert {(None, 0, 0, 0, True), (20, 0, 0, 0, True), (20, 1, 1, 1, False)} <= got and len(got) == 23
