"""Browsing, facets, lookups and search behind the published pointer."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions.dates import epoch_seconds
from ..session import stored_once
from ..sources import catalog as C
from ..sources.published import PublishedRun
from . import catalog_queries, search_queries, views as V
from .register import Registry

query = Registry()


def published(spark, sf):
    """A catalog whose run r2 is published, with a later run that is not ready; written once per version of the input."""

    def write(path):
        catalog = C.Catalog(spark, path)
        for run, day in (("r1", 1), ("r2", 2)):
            catalog.start_run(run, datetime(2001, 8, day, tzinfo=timezone.utc))
            catalog.write_run("jobs", run, V.jobs(spark, sf, run))
            catalog.write_run("companies", run, V.companies(spark, sf, run))
        texts = V.with_posting_columns(V.base(spark, sf, places=False)).select(
            "company", "external_job_id", F.col("text").alias("description"))
        stored = C.write_descriptions(catalog, "r2", texts)
        blank = V.details(spark, sf).select("company", "external_job_id", F.col("job_description_path").alias("_path"))
        # Details of some postings are blank; the others point at the stored texts.
        path = F.when(F.trim(F.coalesce("_path", F.lit(""))) == "", F.col("_path")).otherwise(F.col("job_description_path"))
        details = stored.join(blank, ["company", "external_job_id"]).withColumn("job_description_path", path).drop("_path")
        catalog.write_run("job_details", "r2", details)
        C.write_index(catalog, "r2", V.indexed_docs(spark, sf))
        catalog.set_tables_status("r2", "in_progress", True)
        catalog.publish("r2")
        catalog.start_run("r3", datetime(2001, 8, 3, tzinfo=timezone.utc))
        catalog.write_run("jobs", "r3", V.jobs(spark, sf, "r1"))

    return PublishedRun(C.Catalog(spark, stored_once(spark, "published", sf, write)))


def _dated(df, *names):
    return df.select(*names, epoch_seconds(F.col("posted_ts")).alias("posted_ts"))


@query("published_browse", catalog_queries.query.sql["browse"])
def published_browse(spark, sf):
    return _dated(published(spark, sf).browse(page=2), "external_job_id", "company", "title")


@query("published_page_info", catalog_queries.query.sql["page_info"])
def published_page_info(spark, sf):
    return published(spark, sf).page_info(page=3, job_level="senior")


@query("published_facets", catalog_queries.query.sql["location_facets_scoped"])
def published_facets(spark, sf):
    return published(spark, sf).location_facets(country="AMERICA", region="NATION_1")


@query(
    "published_job_details",
    f"""WITH {V.BASE_SQL}
 SELECT p.external_job_id, NOT p.is_missing_details AS found,
  CASE WHEN NOT p.is_missing_details AND NOT (p.quality IS NOT DISTINCT FROM 0 OR p.p_size IS NOT DISTINCT FROM 50)
   THEN CAST(length(p.text) AS BIGINT) END AS description_chars
 FROM postings p""",
)
def published_job_details(spark, sf):
    asked = V.jobs(spark, sf, places=False).select("company", "external_job_id")
    return published(spark, sf).job_details(asked).select(
        "external_job_id", "found", F.length("description").cast("bigint").alias("description_chars"))


@query("published_search", search_queries.query.sql["search_relevance"])
def published_search(spark, sf):
    found = published(spark, sf).search(search_queries.QUERY, search_queries.vector(spark, sf))
    return _dated(found.withColumn("score", F.round("score", 6)), "id", "title", "company", "score")


@query("published_search_recency", search_queries.query.sql["search_recency"])
def published_search_recency(spark, sf):
    return _dated(published(spark, sf).search_recency(search_queries.QUERY, job_level="senior"), "id", "title")
