"""Readers keep to the published run."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from postmill import schemas
from postmill.sources import catalog as C
from postmill.sources.published import PublishedRun


def _run(spark, catalog, run, titles, publish):
    day = datetime(2026, 1, 1, tzinfo=timezone.utc)
    catalog.start_run(run, day)
    rows = [(run, None, "amazon", str(i), t, "manager", "mid", None, None, [("Berlin", None, "Germany")], ["x"], [1.0, 0.0],
             datetime(2026, 1, 1 + i), False, None) for i, t in enumerate(titles)]
    jobs = spark.createDataFrame(rows, schemas.JOBS)
    catalog.write_run("jobs", run, jobs)
    catalog.write_run("companies", run, spark.createDataFrame([(run, None, "amazon", "Amazon", None)], schemas.COMPANIES))
    texts = jobs.select("company", "external_job_id", F.concat(F.lit("text of "), "title").alias("description"))
    catalog.write_run("job_details", run, C.write_descriptions(catalog, run, texts))
    docs = jobs.withColumns({"id": F.concat_ws(":", "run_id", "company", "external_job_id"), "job_description": F.col("title")})
    C.write_index(catalog, run, docs)
    catalog.set_tables_status(run, "in_progress", True)
    if publish:
        catalog.publish(run)


def test_readers_follow_the_pointer(spark, tmp_path):
    catalog = C.Catalog(spark, str(tmp_path / "c"))
    with pytest.raises(C.NoPublishedRun):
        PublishedRun(catalog)
    _run(spark, catalog, "r1", ["Baker", "Pilot"], True)
    first = PublishedRun(catalog)
    _run(spark, catalog, "r2", ["Baker", "Smith", "Nurse"], False)
    # A run that is written and ready, but not published, is not seen.
    assert PublishedRun(catalog).run_id == "r1"
    catalog.publish("r2")
    second = PublishedRun(catalog)
    for reader, run, titles in ((first, "r1", ["Pilot", "Baker"]), (second, "r2", ["Nurse", "Smith", "Baker"])):
        assert [(r["run_id"], r["title"]) for r in reader.browse(company="amazon").collect()] == [(run, t) for t in titles]
        assert reader.page_info().first()["total_results"] == len(titles)
        assert [r["value"] for r in reader.location_facets().collect()] == ["Berlin", "Germany"]
        found = reader.search("baker", [1.0, 0.0]).collect()
        assert found[0]["id"] == f"{run}:amazon:0" and {r["run_id"] for r in found} == {run}
        assert [r["title"] for r in reader.search_recency(titles[0].lower()).collect()] == [titles[0]]
        asked = spark.createDataFrame([("amazon", "0"), ("amazon", "2"), ("amazon", "9")], "company string, external_job_id string")
        got = {r["external_job_id"]: (r["found"], r["description"]) for r in reader.job_details(asked).collect()}
        assert got["0"] == (True, "text of Baker") and got["9"] == (False, None) and got["2"][0] == (run == "r2")
        with pytest.raises(ValueError, match="unsupported company google"):
            reader.browse(company="google")
