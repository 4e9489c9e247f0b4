"""Bucketed tables with change files, next to the same mutations on whole tables."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postmill import schemas
from postmill.operators import merge as M
from postmill.sources import keyed as K


def _jobs(spark, rng, ids, title):
    rows = [("r", datetime(2026, 1, 1), "amazon" if i % 3 else "meta", str(i), f"{title} {i}", None, "mid", None, None,
             [("A", None, "C")], rng.choice([[], [" x "], ["y", ""]]), [1.0], rng.choice([None, datetime(2026, 1, 5)]),
             rng.random() < 0.3, None) for i in ids]
    return spark.createDataFrame(rows, schemas.JOBS)


def _rows(df):
    return sorted(map(str, df.select(*[f.name for f in schemas.JOBS.fields]).collect()))


def _mutations(spark, rng):
    """(kind, rows) of mutations that meet stored, new and unknown keys."""
    keys = lambda n: [("r", "amazon" if i % 3 else "meta", str(i)) for i in rng.sample(range(60), n)]
    kind = "run_id string, company string, external_job_id string"
    yield "upsert", _jobs(spark, rng, rng.sample(range(60), 25), "second")
    yield "missing", spark.createDataFrame(keys(15), kind)
    yield "dates", spark.createDataFrame([(*k, datetime(2026, 2, 2)) for k in keys(20)] + [(*k, None) for k in keys(5)],
                                         f"{kind}, posted_ts timestamp").dropDuplicates(M.KEY)
    yield "features", spark.createDataFrame(
        [(*k, rng.choice([" ", None, "text"]), [" s ", ""], rng.choice([None, [2.0]])) for k in keys(20)],
        f"{kind}, description string, skills array<string>, embedding array<float>")
    yield "upsert", _jobs(spark, rng, rng.sample(range(60), 10), "third")


def _whole(jobs, kind, rows):
    if kind == "upsert":
        return M.upsert_jobs(jobs, rows)
    if kind == "missing":
        return M.mark_missing(jobs, rows)
    return M.fill_posted_ts(jobs, rows) if kind == "dates" else M.apply_features(jobs, rows)


CHANGE = {"upsert": K.upsert_jobs, "missing": K.mark_missing, "dates": K.fill_posted_ts, "features": K.apply_features}


@pytest.mark.parametrize("folds", [(), (2,), (1, 4)])
def test_changes_are_the_whole_table_mutations(spark, tmp_path, folds):
    rng = random.Random(3)
    jobs = _jobs(spark, rng, range(40), "first")
    table = K.job_table(spark, str(tmp_path / "t"), schemas.JOBS, M.KEY, buckets=4).create(jobs)
    wanted = jobs
    for number, (kind, rows) in enumerate(_mutations(spark, rng), 1):
        CHANGE[kind](table, rows, number)
        wanted = spark.createDataFrame(_whole(wanted, kind, rows).select(*jobs.columns).collect(), schemas.JOBS)
        if number in folds:
            table.fold()
        # A change that is written again replaces itself.
        if number == 3:
            CHANGE[kind](table, rows, number)
    assert _rows(table.read()) == _rows(wanted)
    table.fold()
    assert _rows(table.read()) == _rows(wanted) and table.current()[1] == 5
    # Another application only has the files.
    again = K.job_table(spark, str(tmp_path / "t"), schemas.JOBS, M.KEY, buckets=4)
    again.name = f"{table.name}_again"
    assert _rows(again.read()) == _rows(wanted)


def test_the_base_is_not_shuffled(spark, tmp_path):
    rng = random.Random(1)
    table = K.job_table(spark, str(tmp_path / "t"), schemas.JOBS, M.KEY, buckets=4).create(_jobs(spark, rng, range(40), "a"))
    K.upsert_jobs(table, _jobs(spark, rng, range(30, 50), "b"), 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table.read()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The one exchange gathers the changes of a key; the base's buckets are joined as they lie.
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert plan.index("Exchange hashpartitioning") > plan.index("SortMergeJoin")
    assert table.read().count() == 50


def test_a_base_without_its_version_row_is_not_read(spark, tmp_path):
    rng = random.Random(2)
    table = K.job_table(spark, str(tmp_path / "t"), schemas.JOBS, M.KEY, buckets=2).create(_jobs(spark, rng, range(5), "a"))
    _jobs(spark, rng, range(9), "half").write.parquet(f"{table.path}/base-1")
    assert table.read().count() == 5 and table.current() == (0, 0)
    with pytest.raises(ValueError, match="needs the columns posted_ts"):
        table.change("fill_posted_ts", table.read().select(*M.KEY), 1)
