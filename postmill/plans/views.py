"""A posting catalog derived from the given tables, once as DataFrames and once as SQL.

Every document is a posting. Its part gives the role and grade, its order the date and seniority word, the customer
and the supplier the locations, the label the missing-details flag and the vector table the embedding.
The current crawl (run ``r2``) holds all documents. The earlier crawl (run ``r1``) holds the documents whose order is
not open, and the web pages, which are gone from the current one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_locations
from ..functions.titles import classify_title, title_level
from ..schemas import LOCATIONS

AS_OF = "2000-01-01 00:00:00"
VERSION_1 = "2001-08-01 00:00:00"
VERSION_2 = "2001-08-02 00:00:00"

COMPANY = {
    "AUTOMOBILE": "amazon",
    "BUILDING": "google",
    "FURNITURE": "microsoft",
    "HOUSEHOLD": "netflix",
    "MACHINERY": "apple",
}
SENIORITY = {"1-URGENT": "Senior ", "2-HIGH": "Staff ", "5-LOW": "Principal "}
ROLE = {
    "ECONOMY": "Software Engineer",
    "SMALL": "Machine Learning Engineer",
    "MEDIUM": "Data Scientist",
    "LARGE": "Engineering Manager",
    "PROMO": "Product Manager",
    "STANDARD": "Firmware Engineer",
}
GRADES = [(10, " I"), (20, " II"), (30, " III"), (40, " IV"), (43, " L3"), (46, " L4"), (50, " IC 5")]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text) of the documents."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _lookup(column, mapping, default):
    rule = None
    for key, value in mapping.items():
        rule = F.when(column == key, F.lit(value)) if rule is None else rule.when(column == key, F.lit(value))
    return rule.otherwise(default)


def _places(spark: SparkSession, sf: str, prefix: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias(f"{prefix}_key"),
        F.col("n_name").alias(f"{prefix}_nation"),
        F.col("r_name").alias(f"{prefix}_region"),
    )


def base(spark: SparkSession, sf: str, places: bool = True) -> DataFrame:
    """One row per document with the columns of its part, order, customer and label, and of its places if wanted."""
    customer, part = table(spark, sf, "customer"), table(spark, sf, "part")
    if places:
        customer = customer.join(_places(spark, sf, "c"), F.col("c_nationkey") == F.col("c_key"))
        supplier = table(spark, sf, "supplier").join(_places(spark, sf, "s"), F.col("s_nationkey") == F.col("s_key"))
        part = part.join(supplier, F.col("p_size") == F.col("s_suppkey"), "left")
    # The texts meet all else on doc_id, so they are shuffled once however large the other tables are. These tables grow with the
    # data, so none of them goes through the driver, which a broadcast of a small file with many rows would do.
    orders = table(spark, sf, "orders").join(customer.hint("merge"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return (
        table(spark, sf, "documents")
        .join(part.hint("merge"), F.col("doc_id") == F.col("p_partkey"), "left")
        .join(orders.hint("merge"), F.col("doc_id") == F.col("o_orderkey"), "left")
        .join(table(spark, sf, "labels").withColumnRenamed("doc_id", "label_id").hint("merge"),
              F.col("doc_id") == F.col("label_id"), "left")
    )


def with_posting_columns(df: DataFrame) -> DataFrame:
    """Company, title, category, level, locations and dates of the joined document rows."""
    company = _lookup(F.col("c_mktsegment"), COMPANY, F.lit("meta"))
    grade = F.when(F.col("p_size") <= GRADES[0][0], F.lit(GRADES[0][1]))
    for top, text in GRADES[1:]:
        grade = grade.when(F.col("p_size") <= top, F.lit(text))
    title = F.concat(
        _lookup(F.col("o_orderpriority"), SENIORITY, F.lit("")),
        _lookup(F.col("p_type"), ROLE, F.lit("Designer")),
        F.coalesce(grade, F.lit("")),
        F.lit(", "),
        F.coalesce("p_name", F.lit("open role")),
    )
    located = F.array().cast(LOCATIONS) if "c_nation" not in df.columns else F.array(
        F.struct(
            F.col("c_mktsegment").alias("city"),
            F.when(F.col("o_orderstatus") != "P", F.col("c_nation")).alias("region"),
            F.col("c_region").alias("country"),
        ),
        F.struct(F.col("s_name").alias("city"), F.col("s_nation").alias("region"), F.col("s_region").alias("country")),
    )
    return (
        df.withColumn("external_job_id", F.col("doc_id").cast("string"))
        .withColumn("company", company)
        .withColumn("title", title)
        .withColumn("job_type", classify_title(F.col("title")))
        .withColumn("job_level", title_level(F.col("title"), F.col("company")))
        .withColumn("locations", clean_locations(located))
        .withColumn(
            "posted_ts",
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderdate")).cast("timestamp"),
        )
        .withColumn("is_missing_details", F.coalesce(F.col("toxic"), F.lit(0)) == 1)
        .withColumn("details_url", F.concat(F.lit("https://jobs.example.com/"), F.col("company"), F.lit("/"),
                                            F.col("external_job_id")))
        .withColumn("apply_url", F.concat(F.col("details_url"), F.lit("/apply")))
    )


_JOB_COLUMNS = [
    "run_id", "version_ts", "company", "external_job_id", "title", "job_type", "job_level", "details_url",
    "apply_url", "locations", "skills", "posted_ts", "is_missing_details", "updated_at",
]


def _stamp(df: DataFrame, run: str, version: str) -> DataFrame:
    ts = F.lit(version).cast("timestamp")
    return df.withColumns({"run_id": F.lit(run), "version_ts": ts, "updated_at": ts})


def _page_postings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("external_job_id"),
        F.lit("google").alias("company"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.col("url").alias("details_url"),
    )


def jobs(spark: SparkSession, sf: str, run: str = "r2", embedding: bool = False, places: bool = True) -> DataFrame:
    docs = with_posting_columns(base(spark, sf, places)).withColumn(
        "skills", F.array_distinct(F.array(F.concat(F.lit("lang-"), F.col("lang")), F.col("source")))
    )
    if run == "r1":
        docs = docs.where(F.col("o_orderstatus") != "O").withColumn("skills", F.array().cast("array<string>"))
        out = _stamp(docs, run, VERSION_1).select(_JOB_COLUMNS)
        pages = _stamp(_page_postings(spark, sf), run, VERSION_1).withColumn("is_missing_details", F.lit(False))
        return out.unionByName(pages, allowMissingColumns=True)
    out = _stamp(docs, run, VERSION_2)
    columns = _JOB_COLUMNS
    if embedding:
        vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("job_description_embedding"))
        out = out.join(vectors.hint("merge"), F.col("doc_id") == F.col("vec_id"), "left").withColumn(
            "job_description_embedding",
            F.coalesce("job_description_embedding", F.array().cast("array<float>")),
        )
        columns = [*columns, "job_description_embedding"]
    return out.select(columns)


def details(spark: SparkSession, sf: str, run: str = "r2", fetched_only: bool = False) -> DataFrame:
    """Details rows. ``fetched_only``: the current run before carry-forward, which has closed orders only."""
    docs = with_posting_columns(base(spark, sf, places=False))
    if run == "r1":
        docs = docs.where(F.col("o_orderstatus") != "O")
    elif fetched_only:
        docs = docs.where(F.col("o_orderstatus") == "F")
    path = F.concat_ws("/", F.lit("job-details"), F.lit(run), F.col("company"), F.concat("external_job_id", F.lit(".txt")))
    path = F.when(F.col("quality") == 0, F.lit("  ")).when(F.col("p_size") == 50, F.lit(None)).otherwise(path)
    out = docs.select("company", "external_job_id", path.alias("job_description_path"))
    if run == "r1":
        pages = _page_postings(spark, sf).select(
            "company", "external_job_id",
            F.concat_ws("/", F.lit("job-details/r1/google"), F.concat("external_job_id", F.lit(".txt"))).alias(
                "job_description_path"),
        )
        out = out.unionByName(pages)
    return _stamp(out, run, VERSION_1 if run == "r1" else VERSION_2)


def descriptions(spark: SparkSession, sf: str, run: str = "r2") -> DataFrame:
    docs = with_posting_columns(base(spark, sf, places=False)).select(
        F.concat_ws("/", F.lit("job-details"), F.lit(run), F.col("company"),
                    F.concat("external_job_id", F.lit(".txt"))).alias("job_description_path"),
        F.col("text").alias("description"),
    )
    return docs


def indexed_docs(spark: SparkSession, sf: str, embedding: bool = True) -> DataFrame:
    """The search documents of the current run, straight from the joined rows (``search_docs`` joins the tables)."""
    docs = with_posting_columns(base(spark, sf, places=False)).where(
        ~F.col("is_missing_details") & (F.coalesce("quality", F.lit(1)) != 0) & (F.coalesce("p_size", F.lit(0)) != 50)
    )
    columns = ["id", "run_id", *_JOB_COLUMNS[2:12], "job_description"]
    if embedding:
        vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("job_description_embedding"))
        docs = docs.join(vectors.hint("merge"), F.col("doc_id") == F.col("vec_id"), "left").withColumn(
            "job_description_embedding", F.coalesce("job_description_embedding", F.array().cast("array<float>")))
        columns.append("job_description_embedding")
    run = F.lit("r2")
    out = docs.withColumns({
        "run_id": run,
        "id": F.concat_ws(":", run, "company", "external_job_id"),
        "skills": F.array_distinct(F.array(F.concat(F.lit("lang-"), F.col("lang")), F.col("source"))),
        "job_description": F.col("text"),
    })
    return out.select(columns)


def companies(spark: SparkSession, sf: str, run: str = "r2") -> DataFrame:
    """The companies that have postings, and one that has none."""
    found = jobs(spark, sf, run, places=False).select("company").distinct()
    ts = F.lit(VERSION_2 if run == "r2" else VERSION_1).cast("timestamp")
    none = spark.range(1).select(F.lit("meta").alias("company"))
    return found.unionByName(none).distinct().select(
        F.lit(run).alias("run_id"), ts.alias("version_ts"), "company", F.initcap("company").alias("display_name"),
        ts.alias("updated_at"),
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Request attempts from the event log: configuration by user, endpoint by event type."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("cfg-"), (F.col("user_id") % 5).cast("string")).alias("config_id"),
        F.concat(F.lit("company-"), (F.col("user_id") % 3).cast("string")).alias("company"),
        F.when(F.get_json_object("props", "$.k").cast("int") < 50, F.lit("jobs")).otherwise("details").alias("endpoint"),
        (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("latency_ms"),
        F.when(
            F.col("event_type") == "error",
            F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 7).cast("string")),
        ).otherwise("").alias("error_cause"),
    )


def task_instances(spark: SparkSession, sf: str) -> DataFrame:
    """Task rows from the event log: one run per day, task by user, state by event type."""
    e = table(spark, sf, "events")
    state = _lookup(
        F.col("event_type"),
        {"signup": "queued", "error": "failed", "click": "success", "view": "running", "purchase": "skipped"},
        F.lit(None),
    )
    start = F.col("ts").cast("timestamp")
    return e.select(
        F.lit("crawl").alias("dag_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("task_id"),
        state.alias("state"),
        F.when(F.col("event_type") != "signup", start).alias("start_date"),
        F.when(
            ~F.col("event_type").isin("signup", "view"),
            F.timestamp_seconds(F.unix_seconds(start) + F.floor("value")),
        ).alias("end_date"),
    )


# --- The same views as SQL --------------------------------------------------------------------


def _case(column: str, mapping: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN '{key}' THEN '{value}'" for key, value in mapping.items())
    return f"CASE {column} {whens} ELSE {default} END"


_GRADE_SQL = "CASE " + " ".join(f"WHEN p_size <= {top} THEN '{text}'" for top, text in GRADES) + " ELSE '' END"
_TYPE_SQL = (
    "CASE p_type WHEN 'ECONOMY' THEN 'software_engineer' WHEN 'STANDARD' THEN 'software_engineer' "
    "WHEN 'SMALL' THEN 'machine_learning_engineer' WHEN 'MEDIUM' THEN 'data_scientist' WHEN 'LARGE' THEN 'manager' END"
)
_LEVEL_SQL = """CASE WHEN o_orderpriority = '1-URGENT' THEN 'senior' WHEN o_orderpriority = '2-HIGH' THEN 'staff'
 WHEN o_orderpriority = '5-LOW' THEN 'principal'
 WHEN c_mktsegment = 'AUTOMOBILE' AND p_size <= 10 THEN 'junior'
 WHEN c_mktsegment = 'AUTOMOBILE' AND p_size BETWEEN 21 AND 30 THEN 'senior'
 WHEN c_mktsegment = 'BUILDING' AND p_size BETWEEN 11 AND 20 THEN 'junior'
 WHEN c_mktsegment = 'BUILDING' AND p_size BETWEEN 31 AND 40 THEN 'senior'
 WHEN c_mktsegment = 'FURNITURE' AND p_size <= 10 THEN 'junior'
 WHEN c_mktsegment = 'FURNITURE' AND p_size BETWEEN 21 AND 30 THEN 'senior'
 WHEN c_mktsegment = 'FURNITURE' AND p_size BETWEEN 47 AND 50 THEN 'principal'
 WHEN c_mktsegment = 'HOUSEHOLD' AND p_size BETWEEN 41 AND 43 THEN 'junior'
 ELSE 'mid' END"""

BASE_SQL = f"""
base AS (
 SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, p.p_name, p.p_type, p.p_size, o.o_orderstatus,
  o.o_orderpriority, o.o_orderdate, o.o_totalprice, c.c_mktsegment, l.quality, l.toxic,
  cn.n_name AS c_nation, cr.r_name AS c_region, s.s_name, sn.n_name AS s_nation, sr.r_name AS s_region
 FROM documents d
 LEFT JOIN part p ON p.p_partkey = d.doc_id
 LEFT JOIN orders o ON o.o_orderkey = d.doc_id
 LEFT JOIN customer c ON c.c_custkey = o.o_custkey
 LEFT JOIN nation cn ON cn.n_nationkey = c.c_nationkey
 LEFT JOIN region cr ON cr.r_regionkey = cn.n_regionkey
 LEFT JOIN supplier s ON s.s_suppkey = p.p_size
 LEFT JOIN nation sn ON sn.n_nationkey = s.s_nationkey
 LEFT JOIN region sr ON sr.r_regionkey = sn.n_regionkey
 LEFT JOIN labels l ON l.doc_id = d.doc_id
),
postings AS (
 SELECT *, CAST(doc_id AS VARCHAR) AS external_job_id,
  {_case('c_mktsegment', COMPANY, "'meta'")} AS company,
  {_case('o_orderpriority', SENIORITY, "''")} || {_case('p_type', ROLE, "'Designer'")} || {_GRADE_SQL} || ', '
   || coalesce(p_name, 'open role') AS title,
  {_TYPE_SQL} AS job_type, {_LEVEL_SQL} AS job_level,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderdate END AS posted_ts,
  coalesce(toxic, 0) = 1 AS is_missing_details,
  'https://jobs.example.com/' || {_case('c_mktsegment', COMPANY, "'meta'")} || '/' || CAST(doc_id AS VARCHAR)
   AS details_url
 FROM base
),
posting_locations AS (
 SELECT external_job_id, 1 AS pos, c_mktsegment AS city,
  CASE WHEN o_orderstatus <> 'P' THEN c_nation END AS region, c_region AS country
 FROM postings WHERE c_mktsegment IS NOT NULL
 UNION ALL
 SELECT external_job_id, 2, s_name, s_nation, s_region FROM postings WHERE s_name IS NOT NULL
),
page_postings AS (
 SELECT 'page-' || CAST(page_id AS VARCHAR) AS external_job_id, 'google' AS company,
  regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url AS details_url
 FROM pages
),
run_details AS (
 SELECT 'r2' AS run_id, company, external_job_id, o_orderstatus,
  CASE WHEN quality = 0 THEN '  ' WHEN p_size = 50 THEN NULL
   ELSE 'job-details/r2/' || company || '/' || external_job_id || '.txt' END AS job_description_path
 FROM postings
 UNION ALL
 SELECT 'r1', company, external_job_id, o_orderstatus,
  CASE WHEN quality = 0 THEN '  ' WHEN p_size = 50 THEN NULL
   ELSE 'job-details/r1/' || company || '/' || external_job_id || '.txt' END
 FROM postings WHERE o_orderstatus <> 'O'
 UNION ALL
 SELECT 'r1', company, external_job_id, NULL, 'job-details/r1/google/' || external_job_id || '.txt' FROM page_postings
)"""

LOCATIONS_TEXT_SQL = """
location_text AS (
 SELECT external_job_id, string_agg(coalesce(city, '') || '|' || coalesce(region, '') || '|' || coalesce(country, ''),
  ';' ORDER BY pos) AS locations
 FROM posting_locations GROUP BY external_job_id
)"""


def locations_text(column: str = "locations"):
    """Locations as one comparable string."""
    blank = F.lit("")
    return F.array_join(
        F.transform(
            column,
            lambda e: F.concat_ws("|", F.coalesce(e["city"], blank), F.coalesce(e["region"], blank),
                                  F.coalesce(e["country"], blank)),
        ),
        ";",
    )
