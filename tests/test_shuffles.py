"""Texts are shuffled once, and no posting of an index is."""

import pytest
from pyspark.sql import functions as F

from postmill import schemas
from postmill.operators import merge as M
from postmill.operators import quality as Q
from postmill.operators import search as S
from postmill.plans import views as V
from postmill.sources import catalog as C
from postmill.sources.published import PublishedRun

TABLES = {
    "documents": ("doc_id long, text string, lang string, source string", [(i, f"text {i}", "en", "web") for i in range(6)]),
    "part": ("p_partkey long, p_name string, p_type string, p_size int", [(0, "bolt", "SMALL", 1), (1, "nut", "LARGE", 2), (1, "cap", None, 9)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate date",
               [(0, 0, "F", "1-URGENT", None), (2, None, "O", None, None), (3, 7, "P", "5-LOW", None)]),
    "customer": ("c_custkey long, c_mktsegment string, c_nationkey long", [(0, "BUILDING", 0), (0, "MACHINERY", 1), (1, "BUILDING", 0)]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey long", [(1, "S1", 0), (1, "S1b", 1), (2, "S2", 5)]),
    "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "N0", 0), (1, "N1", 0)]),
    "region": ("r_regionkey long, r_name string", [(0, "R0")]),
    "labels": ("doc_id long, quality int, toxic int", [(0, 1, 0), (2, 0, 1), (2, 1, 0)]),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{where}/{name}.parquet")
    return str(where)


@pytest.fixture
def no_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def _moved(df, *columns):
    """The exchanges whose rows hold one of the columns."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan.initialPlan() if "Adaptive" in plan.nodeName() else plan]
    while todo:
        node = todo.pop()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "Exchange":
            names = [node.output().apply(i).name() for i in range(node.output().size())]
            found += [names] if set(names) & set(columns) else []
    return found


@pytest.mark.parametrize("places", [True, False])
def test_base_moves_texts_once(spark, folder, no_broadcast, places):
    df = V.with_posting_columns(V.base(spark, folder, places))
    assert len(_moved(df.select("external_job_id", "title", "locations", "is_missing_details", "text"), "text")) == 1


def _broadcasts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastExchange")


@pytest.mark.parametrize("gate", [Q.jobs_counts, lambda jobs: Q.details_counts(jobs, jobs), lambda jobs: M.pending_detail_requests(jobs, jobs)])
def test_tables_that_grow_are_not_broadcast(spark, folder, gate):
    """However small their files are."""
    jobs = V.with_posting_columns(V.base(spark, folder, places=False)).select(
        F.lit("r").alias("run_id"), "company", "external_job_id", "is_missing_details", F.array("p_size").alias("job_description_embedding"),
        F.lit("a").alias("job_description_path"))
    assert _broadcasts(gate(jobs)) == 0


def test_base_keeps_all_rows(spark, folder):
    got = sorted(str((r["doc_id"], r["p_name"], r["s_name"], r["s_nation"], r["c_mktsegment"], r["c_nation"], r["quality"]))
                 for r in V.base(spark, folder).collect())
    plain = {n: [dict(zip([c.split()[0] for c in s.split(", ")], row)) for row in rows] for n, (s, rows) in TABLES.items()}
    none = lambda rows: rows or [{}]
    nations = {r["n_nationkey"]: r["n_name"] for r in plain["nation"]}
    want = []
    for d in plain["documents"]:
        for p in none([p for p in plain["part"] if p["p_partkey"] == d["doc_id"]]):
            for o in none([o for o in plain["orders"] if o["o_orderkey"] == d["doc_id"]]):
                for c in none([c for c in plain["customer"] if c["c_custkey"] == o.get("o_custkey") and c["c_nationkey"] in nations]):
                    for x in none([x for x in plain["labels"] if x["doc_id"] == d["doc_id"]]):
                        for s in none([s for s in plain["supplier"] if s["s_suppkey"] == p.get("p_size") and s["s_nationkey"] in nations]):
                            want.append(str((d["doc_id"], p.get("p_name"), s.get("s_name"), nations.get(s.get("s_nationkey")),
                                             c.get("c_mktsegment"), nations.get(c.get("c_nationkey")), x.get("quality"))))
    assert got == sorted(want)


def test_index_blocks_move_texts_and_no_postings(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE", 8)
    monkeypatch.setattr(S, "SHARD_BYTES", 400)
    rows = [(f"d{i}", i, "Senior Cook", ["a", "a", " "], f"often word{i} often {'x' * (i % 3)}" if i % 7 else None) for i in range(100)]
    docs = spark.createDataFrame(rows + rows[:3], "id string, doc_no long, title string, skills array<string>, job_description string")
    blocks = S._blocks(docs)
    moved = _moved(blocks, "id", "term", "postings")
    assert len(moved) == 1 and "job_description" in moved[0]
    want = {}
    for r in S.build_postings(docs.withColumn("id", F.struct("id", "doc_no"))).collect():
        want.setdefault((r["term"], r["field"], r["id"]["doc_no"] // 8), []).append((r["id"]["id"], r["dl"], r["tf"]))
    got = blocks.collect()
    assert {(b["term"], b["field"], b["range"]): [tuple(p) for p in b["postings"]] for b in got} == {k: sorted(v) for k, v in want.items()}
    assert len(got) == len(want)
    assert all((b["n"], b["max_tf"], b["min_dl"]) == (len(b["postings"]), max(p["tf"] for p in b["postings"]),
                                                       min(p["dl"] for p in b["postings"])) for b in got)


def test_runs_go_on_over_batches(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_BYTES", 1 << 20)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"d{i:03d}", i, "cook", [], "same words here") for i in range(50)]
        docs = spark.createDataFrame(rows, "id string, doc_no long, title string, skills array<string>, job_description string")
        got = {(b["term"], b["field"]): [p["id"] for p in b["postings"]] for b in S._blocks(docs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    every = [r[0] for r in rows]
    assert got == {("cook", "title"): every, **{(w, "job_description"): every for w in ("same", "words", "here")}}


def test_index_blocks_sort_no_postings(spark):
    """No posting is a row before its block is made: the plan neither explodes terms nor sorts them."""
    docs = spark.createDataFrame([("a", 0, None, None, "b a \u00e9 b"), ("c", 1, "A", ["x", None], None)],
                                 "id string, doc_no long, title string, skills array<string>, job_description string")
    blocks = S._blocks(docs)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Generate" not in plan
    assert [(b["term"], b["field"], [tuple(p) for p in b["postings"]]) for b in blocks.collect()] == [
        ("a", "job_description", [("a", 4, 1)]), ("a", "title", [("c", 1, 1)]), ("b", "job_description", [("a", 4, 2)]),
        ("x", "skills", [("c", 1, 1)]), ("\u00e9", "job_description", [("a", 4, 1)])]
    assert S._blocks(docs.where("false")).collect() == []


def test_details_move_texts_by_path_only(spark, tmp_path, no_broadcast):
    catalog = C.Catalog(spark, str(tmp_path / "c"))
    jobs = spark.createDataFrame(
        [("r", None, "amazon", str(i), f"T{i}", None, None, None, None, [], [], [], None, i == 3, None) for i in range(6)], schemas.JOBS)
    catalog.write_run("jobs", "r", jobs)
    texts = jobs.select("company", "external_job_id", F.concat(F.lit("text of "), "title").alias("description"))
    details = C.write_descriptions(catalog, "r", texts)
    # A key with two details rows of which one is blank, and one whose path is blank.
    path = F.when(F.col("external_job_id") == "4", F.lit(" ")).otherwise(F.col("job_description_path"))
    extra = details.where("external_job_id = '1'").withColumn("job_description_path", F.lit(None).cast("string"))
    catalog.write_run("job_details", "r", details.withColumn("job_description_path", path).unionByName(extra))
    reader = PublishedRun.__new__(PublishedRun)
    reader.catalog, reader.run_id = catalog, "r"
    asked = spark.createDataFrame([("amazon", i) for i in ("0", "1", "3", "4", "9")], "company string, external_job_id string")
    found = reader.job_details(asked)
    assert len(_moved(found, "description")) == 1
    assert sorted((r["external_job_id"], r["found"], r["description"]) for r in found.collect()) == [
        ("0", True, "text of T0"), ("1", True, "text of T1"), ("3", False, None), ("4", True, None), ("9", False, None)]
