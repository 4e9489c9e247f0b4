"""Physical plans: what reaches the scan, and what is broadcast or shuffled."""

from datetime import datetime

from pyspark.sql import functions as F

from postmill import schemas
from postmill.operators import browse as B
from postmill.operators import filters as FL
from postmill.operators import search as S
from postmill.sources.catalog import Catalog


def _plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()


def _jobs(spark, n=50):
    rows = [("r", None, "amazon" if i % 3 else "meta", str(i), f"Engineer {i}", "manager", "mid", None, None,
             [("A", "B", "C")], ["x"], [1.0, 2.0], datetime(2026, 1, 1 + i % 28), False, None) for i in range(n)]
    return spark.createDataFrame(rows, schemas.JOBS)


def test_browse_reads_one_run_and_few_columns(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    for run in ("r1", "r2"):
        catalog.write_run("jobs", run, _jobs(spark))
    page = B.browse(catalog.scan_run("jobs", "r1"), company="amazon", job_type="manager").select("external_job_id", "posted_ts")
    plan = _plan(page)
    assert "EqualTo(company,amazon)" in plan and "EqualTo(job_type,manager)" in plan
    assert "job_description_embedding" not in plan and "skills" not in plan
    assert "run_id=r1" in plan and "run_id=r2" not in plan
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert page.count() == 25


def test_top_k_per_key_is_limited_before_the_shuffle(spark):
    # Values are made distinct before the shuffle; a limit is applied before one, too.
    plan = _plan(B.location_facets(_jobs(spark)))
    assert plan.count("HashAggregate") == 2 and "Exchange hashpartitioning" in plan
    assert "WindowGroupLimit" in _plan(B.location_facets(_jobs(spark), limit=5))


def test_stored_index_prunes_by_term(spark, tmp_path):
    docs = _jobs(spark).withColumns({"id": F.col("external_job_id"), "job_description": F.col("title")})
    S.SearchIndex.of(docs).write(str(tmp_path / "i"))
    index = S.SearchIndex.read(spark, str(tmp_path / "i"))
    plan = _plan(index.lookup({"title": ["engineer", "7"], "skills": ["x"], "job_description": ["engineer", "7"]}))
    assert "In(term, [7,engineer,x])" in plan
    assert S.text_top(index, "engineer 7").orderBy("rank").first()["id"] == "7"


def test_filters_come_before_the_vector_top_k(spark):
    docs = _jobs(spark).withColumn("id", F.col("external_job_id"))
    plan = _plan(S.vector_top(docs, [1.0, 1.0], 5, company="meta"))
    assert plan.index("TakeOrdered") < plan.index("meta")
    assert {r["id"] for r in S.vector_top(docs, [1.0, 1.0], 50, company="meta").collect()} == {
        str(i) for i in range(0, 50, 3)}


def test_no_cross_products(spark):
    docs = _jobs(spark).withColumns({"id": F.col("external_job_id"), "job_description": F.col("title")})
    index = S.SearchIndex.of(docs)
    for df in (S.text_top(index, "engineer"), S.search_relevance(index, "engineer", [1.0, 0.0]),
               FL.apply_filters(docs, company="meta")):
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_frequent_terms_are_read_by_range(spark, tmp_path, monkeypatch):
    """Long documents about something else: only the ranges that can hold one of the best are read, with the same rows."""
    monkeypatch.setattr(S, "RANGE", 16)
    monkeypatch.setattr(S, "FIRST_RANGES", 2)
    rows = [(str(i), "often " * (9 if i % 40 == 0 else 1) + "filler " * (i % 400), "meta" if i % 2 else "amazon") for i in range(4000)]
    texts = spark.createDataFrame(rows, "id string, job_description string, company string")
    docs = texts.join(_jobs(spark, 1).drop("company", "title", "skills"), F.lit(True)).withColumns(
        {"title": F.lit("x"), "skills": F.array().cast("array<string>")})
    # Documents are sorted by length within a task.
    S.SearchIndex.of(docs.coalesce(1)).write(str(tmp_path / "i"))
    index = S.SearchIndex.read(spark, str(tmp_path / "i"))
    for scope in ({}, {"company": "amazon"}, {"company": "nobody"}):
        every = S.text_hits(index, "often", **scope).orderBy(F.col("score").desc(), "id").limit(20)
        wanted = [(r["id"], round(r["score"], 9)) for r in every.collect()]
        got = S.text_top(index, "often", 20, **scope).orderBy("rank").collect()
        assert [(r["id"], round(r["score"], 9)) for r in got] == wanted
    total, hopeful = S.range_bounds(index, "often").count(), S.hopeful_ranges(index, "often", 20).count()
    assert total >= 250 and hopeful * 5 < total
    # The heads of the blocks are read without their postings.
    plan = _plan(S.range_bounds(index, "often"))
    assert "max_tf" in plan and "ReadSchema" in plan and "postings" not in plan
