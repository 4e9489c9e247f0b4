"""Browse, paging, facets and lookups on one published run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import apply_filters
from .ranking import top_per_group

PAGE_SIZE = 25


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("posted_ts").desc_nulls_last(), F.col("external_job_id").asc())


def page_of(df: DataFrame, page: int, size: int = PAGE_SIZE) -> DataFrame:
    return df.offset((page - 1) * size).limit(size)


def browse(docs: DataFrame, page: int = 1, size: int = PAGE_SIZE, **filters) -> DataFrame:
    """One page of the postings that pass the filters, newest first, undated last."""
    return page_of(newest_first(apply_filters(docs, **filters)), page, size)


def page_info(matches: DataFrame, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """Exact total, number of pages and whether another page follows."""
    total = F.col("total_results")
    offset = F.lit((page - 1) * size)
    on_page = F.greatest(F.least(total - offset, F.lit(size)), F.lit(0))
    return matches.agg(F.count("*").alias("total_results")).select(
        "total_results",
        F.greatest(F.ceil(total / F.lit(size)), F.lit(1)).cast("bigint").alias("total_pages"),
        (offset + on_page < total).alias("has_next"),
    )


def location_facets(docs: DataFrame, country: str | None = None, region: str | None = None, limit: int | None = None,
                    **filters) -> DataFrame:
    """Distinct countries, regions (of the country) and cities (of country and region), all of them in key order.

    ``limit`` keeps that many first values of each facet.

    One pass: every location yields up to three (facet, value) pairs, which are de-duplicated before the shuffle.
    """
    e = F.col("e")
    in_country = (e["country"] == country) if country else F.lit(True)
    in_region = (e["region"] == region) if region else F.lit(True)
    pairs = F.array(
        F.struct(F.lit("country").alias("facet"), e["country"].alias("value")),
        F.struct(F.lit("region").alias("facet"), F.when(in_country, e["region"]).alias("value")),
        F.struct(F.lit("city").alias("facet"), F.when(in_country & in_region, e["city"]).alias("value")),
    )
    values = (
        apply_filters(docs, **filters)
        .select(F.explode("locations").alias("e"))
        .select(F.explode(pairs).alias("p"))
        .select("p.facet", F.trim("p.value").alias("value"))
        .where(F.coalesce(F.col("value"), F.lit("")) != "")
        .distinct()
    )
    if limit is not None:
        values = top_per_group(values, ["facet"], [F.col("value").asc()], limit).drop("rn")
    return values.orderBy("facet", "value")


def jobs_with_details(jobs: DataFrame, details: DataFrame) -> DataFrame:
    """Postings joined to their details on the three-part key."""
    return jobs.join(details.select("run_id", "company", "external_job_id", "job_description_path"),
                     ["run_id", "company", "external_job_id"])


def job_details_lookup(requests: DataFrame, jobs: DataFrame, details: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Details for a table of keys; a key that is unknown or has no details comes back as not found."""
    key = ["run_id", "company", "external_job_id"]
    path = F.nullif(F.trim("job_description_path"), F.lit(""))
    hits = (
        jobs.where(~F.col("is_missing_details"))
        .select(*key, "title", "posted_ts", F.lit(True).alias("_hit"))
        .join(details.select(*key, path.alias("path")).where("path IS NOT NULL"), key, "left")
    )
    # Keys meet keys alone and texts come last, so they are moved once. Rows without a path are dealt out by their key and meet none.
    asked = requests.join(hits, key, "left").withColumn("_at", F.coalesce("path", F.concat_ws(":", *key)))
    texts = descriptions.select(F.col("job_description_path").alias("_path"), "description")
    found = asked.join(texts, (F.col("_at") == F.col("_path")) & F.col("path").isNotNull(), "left")
    return found.withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit", "_at", "_path")


def list_companies(companies: DataFrame, run_id: str) -> DataFrame:
    return companies.where(F.col("run_id") == run_id).select("company", "display_name").orderBy("company")


def require_known_companies(requests: DataFrame, companies: DataFrame) -> DataFrame:
    """Fail the job when a request names a company that the run does not have."""
    known = companies.select(F.col("company"), F.lit(True).alias("_known")).distinct()
    message = F.concat(F.lit("unsupported company "), F.col("company"))
    checked = requests.join(known, "company", "left")
    return checked.withColumn(
        "company",
        F.when(F.col("company").isNotNull() & F.col("_known").isNull(), F.raise_error(message)).otherwise(
            F.col("company")
        ),
    ).drop("_known")


def unknown_companies(requests: DataFrame, companies: DataFrame) -> DataFrame:
    """The requests that name a company which the run does not have."""
    return requests.where(F.col("company").isNotNull()).join(companies.select("company"), "company", "left_anti")


def total_pages(total: Column, size: Column, has_next: Column, cap: int | None) -> Column:
    """Pages to fetch: from the total when known, else the cap while more pages follow, else one."""
    known = (total >= 0) & (size > 0)
    pages = F.greatest(F.ceil(total / size), F.lit(1)).cast("bigint")
    if cap is None:
        more = F.raise_error(F.lit("total unknown and no page cap set")).cast("bigint")
    else:
        pages = F.least(pages, F.lit(cap).cast("bigint"))
        more = F.lit(cap).cast("bigint")
    return F.when(F.coalesce(known, F.lit(False)), pages).when(F.coalesce(has_next, F.lit(False)), more).otherwise(
        F.lit(1).cast("bigint")
    )
