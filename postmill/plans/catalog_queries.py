"""Queries on the read path: filters, browse, paging, facets, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import epoch_seconds, search_epoch
from ..functions.requests import normalize_requests
from ..operators import browse as B
from ..operators import filters as FL
from . import views as V
from .register import Registry

query = Registry()


@query(
    "filter_postings",
    f"""WITH {V.BASE_SQL}
 SELECT external_job_id, company, job_type, job_level FROM postings
 WHERE company = 'amazon' AND job_type = 'software_engineer' AND job_level = 'senior'""",
)
def filter_postings(spark, sf):
    return FL.apply_filters(
        V.jobs(spark, sf, places=False), company="amazon", job_type="software_engineer", job_level="senior"
    ).select("external_job_id", "company", "job_type", "job_level")


@query(
    "posted_within",
    f"""WITH {V.BASE_SQL}
 SELECT external_job_id, CAST(epoch(posted_ts) AS BIGINT) AS posted_ts FROM postings
 WHERE posted_ts >= TIMESTAMP '{V.AS_OF}' - INTERVAL 30 DAY""",
)
def posted_within(spark, sf):
    return FL.apply_filters(V.jobs(spark, sf, places=False), posted="30d", as_of=F.lit(V.AS_OF).cast("timestamp")).select(
        "external_job_id", epoch_seconds(F.col("posted_ts")).alias("posted_ts")
    )


@query(
    "nested_location_filter",
    f"""WITH {V.BASE_SQL}
 SELECT DISTINCT external_job_id FROM posting_locations
 WHERE country = 'ASIA' AND region IN (SELECT n_name FROM nation WHERE n_nationkey = 2) AND city = 'BUILDING'""",
)
def nested_location_filter(spark, sf):
    return FL.apply_filters(V.jobs(spark, sf), country="ASIA", region="NATION_2", city="BUILDING").select(
        "external_job_id"
    )


@query(
    "normalize_requests",
    """SELECT conv_id, turn,
  CASE WHEN trim(lower(company)) NOT IN ('', '__all__') THEN trim(lower(company)) END AS company,
  CASE WHEN trim(lower(job_level)) IN ('intern','junior','mid','senior','staff','principal','distinguished','fellow',
   'director','unknown') THEN trim(lower(job_level)) END AS job_level,
  CASE WHEN trim(lower(posted_within)) IN ('24h','7d','30d') THEN trim(lower(posted_within)) END AS posted_within,
  CASE WHEN trim(city) NOT IN ('', '__all__') THEN trim(city) END AS city,
  CASE WHEN trim(lower(search_mode)) = 'recency' THEN 'recency' ELSE 'relevance' END AS search_mode
 FROM (SELECT conv_id, turn,
   CASE WHEN turn = 0 THEN '__ALL__' WHEN role = 'user' THEN ' Amazon ' ELSE '  ' END AS company,
   CASE WHEN turn = 0 THEN ' Senior' WHEN role = 'user' THEN 'boss' ELSE '__all__' END AS job_level,
   CASE WHEN turn = 1 THEN ' 7D ' WHEN role = 'user' THEN '30d' ELSE '90d' END AS posted_within,
   ' ' || split_part(text, ' ', 1) || ' ' AS city,
   CASE WHEN role = 'user' THEN ' Recency' ELSE 'newest' END AS search_mode
  FROM conversations)""",
)
def normalize_request_table(spark, sf):
    c = V.table(spark, sf, "conversations")
    user = F.col("role") == "user"
    requests = c.select(
        "conv_id", "turn",
        F.when(F.col("turn") == 0, "__ALL__").when(user, " Amazon ").otherwise("  ").alias("company"),
        F.when(F.col("turn") == 0, " Senior").when(user, "boss").otherwise("__all__").alias("job_level"),
        F.when(F.col("turn") == 1, " 7D ").when(user, "30d").otherwise("90d").alias("posted_within"),
        F.concat(F.lit(" "), F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" ")).alias("city"),
        F.when(user, " Recency").otherwise("newest").alias("search_mode"),
    )
    return normalize_requests(requests)


@query(
    "allowed_categories",
    f"""WITH {V.BASE_SQL}
 SELECT company, count(*) AS jobs_seen, count(job_type) AS jobs_written FROM postings GROUP BY company""",
)
def allowed_categories(spark, sf):
    seen = V.jobs(spark, sf, places=False).select("company", "job_type")
    written = FL.filter_allowed_categories(seen).groupBy("company").agg(F.count("*").alias("jobs_written"))
    return seen.groupBy("company").agg(F.count("*").alias("jobs_seen")).join(written, "company", "left").na.fill(0)


@query(
    "require_ids",
    """SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS external_job_id, source FROM documents""",
)
def require_ids(spark, sf):
    d = V.table(spark, sf, "documents")
    return FL.require_ids(
        d.select(F.concat(F.lit(" doc-"), F.col("doc_id").cast("string"), F.lit(" ")).alias("external_job_id"), "source")
    )


@query(
    "clean_locations",
    f"""WITH {V.BASE_SQL}, {V.LOCATIONS_TEXT_SQL}
 SELECT p.external_job_id, coalesce(t.locations, '') AS locations FROM postings p
 LEFT JOIN location_text t USING (external_job_id)""",
)
def clean_locations(spark, sf):
    return V.jobs(spark, sf).select("external_job_id", V.locations_text().alias("locations"))


@query(
    "clean_skills",
    """SELECT doc_id, lang || ',' || source AS skills FROM documents""",
)
def clean_skills(spark, sf):
    from ..functions.text import clean_strings

    raw = F.array(F.lit(" "), F.concat(F.lit(" "), F.col("lang")), F.lit(None), F.concat(F.col("source"), F.lit("\t")))
    return V.table(spark, sf, "documents").select(
        "doc_id", F.array_join(clean_strings(raw), ",").alias("skills")
    )


@query(
    "result_rows",
    f"""WITH {V.BASE_SQL}, {V.LOCATIONS_TEXT_SQL}
 SELECT p.external_job_id AS id, 'r2' AS run_id, p.title AS name, p.company, p.job_level,
  coalesce(t.locations, '') AS locations, CAST(epoch(p.posted_ts) AS BIGINT) AS posted_ts,
  p.details_url || '/apply' AS apply_url, p.details_url
 FROM postings p LEFT JOIN location_text t USING (external_job_id)""",
)
def result_rows(spark, sf):
    rows = FL.to_rows(V.jobs(spark, sf))
    return rows.withColumn(
        "locations",
        F.array_join(F.transform("locations", lambda e: F.concat_ws("|", e["city"], e["state"], e["country"])), ";"),
    )


@query(
    "index_eligibility",
    f"""WITH {V.BASE_SQL}
 SELECT p.external_job_id, d.job_description_path FROM postings p
 JOIN run_details d ON d.run_id = 'r2' AND d.company = p.company AND d.external_job_id = p.external_job_id
 WHERE NOT p.is_missing_details AND d.job_description_path IS NOT NULL AND trim(d.job_description_path) <> ''""",
)
def index_eligibility(spark, sf):
    return B.jobs_with_details(V.jobs(spark, sf, places=False), V.details(spark, sf)).where(FL.has_description()).select(
        "external_job_id", "job_description_path"
    )


@query(
    "jobs_with_details",
    f"""WITH {V.BASE_SQL}
 SELECT p.company, p.external_job_id, p.title, d.job_description_path FROM postings p
 JOIN run_details d ON d.run_id = 'r2' AND d.company = p.company AND d.external_job_id = p.external_job_id""",
)
def jobs_with_details(spark, sf):
    return B.jobs_with_details(V.jobs(spark, sf, places=False), V.details(spark, sf)).select(
        "company", "external_job_id", "title", "job_description_path"
    )


@query(
    "job_details_lookup",
    f"""WITH {V.BASE_SQL}
 SELECT CAST(e.vec_id AS VARCHAR) AS external_job_id, p.title, CAST(epoch(p.posted_ts) AS BIGINT) AS posted_ts,
  CASE WHEN p.quality = 0 OR p.p_size = 50 THEN NULL ELSE length(p.text) END AS description_chars,
  p.external_job_id IS NOT NULL AS found
 FROM embeddings e LEFT JOIN (SELECT * FROM postings WHERE NOT is_missing_details) p ON p.doc_id = e.vec_id""",
)
def job_details_lookup(spark, sf):
    # The requested keys are the vector ids; the company of a key comes from the run itself.
    ids = V.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("external_job_id"))
    keys = V.jobs(spark, sf, places=False).select("run_id", "company", "external_job_id")
    requests = ids.join(keys, "external_job_id", "left")
    found = B.job_details_lookup(requests, V.jobs(spark, sf, places=False), V.details(spark, sf), V.descriptions(spark, sf))
    return found.select(
        "external_job_id", "title", epoch_seconds(F.col("posted_ts")).alias("posted_ts"),
        F.length("description").cast("bigint").alias("description_chars"), "found",
    )


@query(
    "browse",
    f"""WITH {V.BASE_SQL}
 SELECT external_job_id, company, title, CAST(epoch(posted_ts) AS BIGINT) AS posted_ts FROM postings
 ORDER BY posted_ts DESC NULLS LAST, external_job_id ASC LIMIT 25 OFFSET 25""",
)
def browse(spark, sf):
    return B.browse(V.jobs(spark, sf, places=False), page=2).select(
        "external_job_id", "company", "title", epoch_seconds(F.col("posted_ts")).alias("posted_ts")
    )


@query(
    "browse_filtered",
    f"""WITH {V.BASE_SQL}
 SELECT external_job_id, company, title, CAST(epoch(posted_ts) AS BIGINT) AS posted_ts FROM postings
 WHERE job_type = 'data_scientist' AND external_job_id IN
  (SELECT external_job_id FROM posting_locations WHERE country = 'EUROPE')
 ORDER BY posted_ts DESC NULLS LAST, external_job_id ASC LIMIT 25""",
)
def browse_filtered(spark, sf):
    return B.browse(V.jobs(spark, sf), job_type="data_scientist", country="EUROPE").select(
        "external_job_id", "company", "title", epoch_seconds(F.col("posted_ts")).alias("posted_ts")
    )


@query(
    "page_info",
    f"""WITH {V.BASE_SQL}
 SELECT count(*) AS total_results, CAST(greatest(1, ceil(count(*) / 25.0)) AS BIGINT) AS total_pages,
  50 + greatest(least(count(*) - 50, 25), 0) < count(*) AS has_next
 FROM postings WHERE job_level = 'senior'""",
)
def page_info(spark, sf):
    return B.page_info(FL.apply_filters(V.jobs(spark, sf, places=False), job_level="senior"), page=3)


_FACETS = """
 SELECT facet, value FROM (
   SELECT 'country' AS facet, country AS value FROM scoped
   UNION SELECT 'region', region FROM scoped {r}
   UNION SELECT 'city', city FROM scoped {c}
 ) WHERE coalesce(value, '') <> ''"""


@query(
    "location_facets",
    f"""WITH {V.BASE_SQL}, scoped AS (
  SELECT l.* FROM posting_locations l JOIN postings p USING (external_job_id) WHERE p.job_type = 'software_engineer')
 {_FACETS.format(r="", c="")}""",
)
def location_facets(spark, sf):
    return B.location_facets(V.jobs(spark, sf), job_type="software_engineer")


@query(
    "location_facets_scoped",
    f"""WITH {V.BASE_SQL}, scoped AS (SELECT * FROM posting_locations)
 {_FACETS.format(r="WHERE country = 'AMERICA'", c="WHERE country = 'AMERICA' AND region = 'NATION_1'")}""",
)
def location_facets_scoped(spark, sf):
    return B.location_facets(V.jobs(spark, sf), country="AMERICA", region="NATION_1")


@query(
    "list_companies",
    f"""WITH {V.BASE_SQL}
 SELECT company, upper(substr(company, 1, 1)) || substr(company, 2) AS display_name
 FROM (SELECT DISTINCT company FROM postings UNION SELECT 'meta')""",
)
def list_companies(spark, sf):
    return B.list_companies(V.companies(spark, sf), "r2")


@query(
    "unknown_companies",
    f"""WITH {V.BASE_SQL}
 SELECT DISTINCT lower(source) AS company FROM documents
 WHERE lower(source) NOT IN (SELECT company FROM postings)""",
)
def unknown_companies(spark, sf):
    requests = V.table(spark, sf, "documents").select(F.lower("source").alias("company")).distinct()
    return B.unknown_companies(requests, V.companies(spark, sf))


@query(
    "total_pages",
    """SELECT user_id, count(*) AS total, CASE WHEN count(*) >= 0 THEN least(greatest(1, CAST(ceil(count(*) / 10.0)
  AS BIGINT)), 7) END AS pages FROM events GROUP BY user_id""",
)
def total_pages(spark, sf):
    totals = V.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("total"))
    return totals.withColumn("pages", B.total_pages(F.col("total"), F.lit(10), F.lit(True), 7))


@query(
    "search_epoch",
    """SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS posted_ts FROM events""",
)
def search_epochs(spark, sf):
    e = V.table(spark, sf, "events")
    seconds = epoch_seconds(F.col("ts"))
    spelled = (
        F.when(F.col("event_type") == "view", seconds.cast("string"))
        .when(F.col("event_type") == "click", (seconds * 1000 + 7).cast("string"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return e.select("event_id", search_epoch(spelled).alias("posted_ts"))
