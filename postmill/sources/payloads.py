"""Listing payloads of the six sources, parsed in bulk into one posting schema.

Input: a table (page, payload) with one fetched listing page per row. ``parse_pages`` gives a table of postings and a
table of pages: totals, sizes, whether another page follows, and why a page failed. A page without its list of postings
fails, and so does one with a posting that lacks a required field; the other pages go on. The ``parse_<source>``
functions give the postings only and fail the job instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_epoch, month_name_epoch
from ..functions.text import clean_strings, optional_string, quote, slug, to_int
from ..functions.titles import classify_title, title_level

# --- Fixed values: public addresses, page sizes and payload markers of the sources -------------
BASE_URL = {
    "amazon": "https://www.amazon.jobs",
    "apple": "https://jobs.apple.com",
    "google": "https://www.google.com",
    "meta": "https://www.metacareers.com",
    "microsoft": "https://apply.careers.microsoft.com",
    "netflix": "https://explore.jobs.netflix.net",
}
APPLE_LOCALE = "en-us"
GOOGLE_RESULTS = "/about/careers/applications/jobs/results"
PAGE_SIZE = {"amazon": 10, "apple": 20, "meta": 10, "microsoft": 10, "netflix": 10}
HYDRATION = r'(?s)window\.__staticRouterHydrationData\s*=\s*JSON\.parse\("(.*?\})"\);'
CALLBACK = r"(?s)AF_initDataCallback\(\{key: 'ds:%d', hash: '[^']+', data:(.*?), sideChannel: \{\}\}\);"
LOOP_PREFIX = "for (;;);"
# ----------------------------------------------------------------------------------------------


# A parsed page: page, total, page_size and ``items``, NULL when the page has no list of postings.
_NO_LIST = "a listing page has no list of postings"


def _pages(parsed: DataFrame, items: Column, size: Column, total: Column) -> DataFrame:
    return parsed.select("page", total.alias("total"), size.cast("bigint").alias("page_size"), items.alias("items"))


def _required(rows: DataFrame, source: str) -> DataFrame:
    """Fail the job for a posting with a problem."""
    message = F.concat(F.lit(f"{source}: posting without "), F.col("problem"))
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(message)).otherwise(F.col("external_job_id"))
    return rows.withColumn("external_job_id", checked).drop("problem")


def _posting(source: str, rows: DataFrame, missing: list[tuple[Column, str]] = (), **columns: Column) -> DataFrame:
    """The common posting row, with ``problem``: the first required field it lacks."""
    title = columns["title"]
    company = F.lit(source)
    problem = F.when(columns["id"].isNull(), F.lit("an id"))
    for value, field in missing:
        problem = problem.when(value.isNull(), F.lit(field))
    return rows.select(
        "page",
        company.alias("company"),
        columns["id"].alias("external_job_id"),
        title.alias("title"),
        classify_title(title).alias("job_type"),
        title_level(title, company).alias("job_level"),
        columns["locations"].alias("raw_locations"),
        columns["posted"].cast("bigint").alias("posted_epoch"),
        columns["details"].alias("details_url"),
        columns["apply"].alias("apply_url"),
        problem.alias("problem"),
    )


def _text(name: str) -> Column:
    return optional_string(F.col(f"j.{name}"))


# --- amazon -----------------------------------------------------------------------------------

_AMAZON = (
    "struct<hits:string,jobs:array<struct<id_icims:string,id:string,title:string,job_path:string,url_next_step:string,"
    "posted_date:string,locations:array<string>>>>"
)


def _amazon_details(path: Column, job_id: Column) -> Column:
    base = BASE_URL["amazon"]
    inside = F.regexp_extract(path, r"^https?://[^/?#]*([^#]*)", 1)
    inside = F.when(inside == "", "/").when(inside.startswith("?"), F.concat(F.lit("/"), inside)).otherwise(inside)
    path = (
        F.when(path.isNull(), F.concat(F.lit("/en/jobs/"), job_id))
        .when(path.startswith("/"), path)
        .when(path.rlike("^https?://"), inside)
        .otherwise(F.concat(F.lit("/"), path))
    )
    return F.concat(F.lit(base), path)


def _amazon_apply(url: Column, job_id: Column) -> Column:
    base = F.lit(BASE_URL["amazon"])
    canonical = F.concat(base, F.lit("/applicant/jobs/"), job_id, F.lit("/apply"))
    ends = url.endswith("/apply")
    return (
        F.when(url.isNull(), canonical)
        .when((F.contains(url, F.lit("account.amazon.com/jobs/")) | url.startswith("/jobs/")) & ends, canonical)
        .when(url.startswith("/"), F.concat(base, url))
        .otherwise(url)
    )


def _amazon_pages(pages: DataFrame) -> DataFrame:
    parsed = pages.select("page", F.from_json("payload", _AMAZON).alias("p"))
    return _pages(parsed, F.col("p.jobs"), F.lit(PAGE_SIZE["amazon"]), to_int(F.col("p.hits")))


def _amazon_rows(rows: DataFrame) -> DataFrame:
    job_id = F.coalesce(_text("id_icims"), _text("id"))
    return _posting(
        "amazon", rows, id=job_id, title=_text("title"),
        # Each location is itself JSON text; what is not an object with a location is skipped.
        locations=clean_strings(F.transform("j.locations", lambda x: F.get_json_object(
            F.when(F.try_parse_json(x).isNotNull(), x), "$.normalizedLocation"))),
        posted=month_name_epoch(F.col("j.posted_date")),
        details=_amazon_details(_text("job_path"), job_id),
        apply=_amazon_apply(_text("url_next_step"), job_id),
    )


# --- apple ------------------------------------------------------------------------------------

_APPLE_JOB = (
    "struct<positionId:string,reqId:string,postingTitle:string,transformedPostingTitle:string,postDateInGMT:string,"
    "postingDate:string,locations:array<struct<city:string,stateProvince:string,region:string,countryName:string,"
    "name:string>>>"
)
_APPLE = f"struct<loaderData:struct<search:struct<totalRecords:string,searchResults:array<{_APPLE_JOB}>>>>"


def hydration_json(page: Column) -> Column:
    """The JSON text that an Apple page embeds as an escaped script string.

    Escapes that scripts have and JSON does not (``\\xHH`` and ``\\'``) are turned into those of JSON first.
    """
    escaped = F.regexp_extract(page, HYDRATION, 1)
    # An even number of backslashes before an escape belongs to other characters.
    escaped = F.regexp_replace(escaped, r"(?<!\\)((?:\\\\)*+)\\x([0-9A-Fa-f]{2})", r"$1\\u00$2")
    escaped = F.regexp_replace(escaped, r"(?<!\\)((?:\\\\)*+)\\'", "$1'")
    quoted = F.concat(F.lit('["'), escaped, F.lit('"]'))
    return F.when(escaped != "", F.get(F.from_json(quoted, "array<string>"), F.lit(0)))


def _apple_location(x: Column) -> Column:
    part = lambda name: optional_string(x[name])
    return F.concat_ws(", ", part("city"), F.coalesce(part("stateProvince"), part("region")),
                       F.coalesce(part("countryName"), part("name")))


def _apple_pages(pages: DataFrame) -> DataFrame:
    parsed = pages.select("page", F.from_json(hydration_json(F.col("payload")), _APPLE).alias("p"))
    found = F.col("p.loaderData.search")
    return _pages(parsed, found["searchResults"], F.lit(PAGE_SIZE["apple"]), to_int(found["totalRecords"]))


def _apple_rows(rows: DataFrame) -> DataFrame:
    job_id = F.coalesce(_text("positionId"), _text("reqId"))
    title = _text("postingTitle")
    base = f"{BASE_URL['apple']}/{APPLE_LOCALE}/details/"
    name = F.coalesce(_text("transformedPostingTitle"), slug(F.coalesce(title, F.lit("job"))))
    return _posting(
        "apple", rows, id=job_id, title=title,
        locations=clean_strings(F.transform("j.locations", _apple_location)),
        posted=F.coalesce(iso_epoch(F.col("j.postDateInGMT")), month_name_epoch(F.col("j.postingDate"))),
        details=F.concat(F.lit(base), quote(job_id), F.lit("/"), quote(name)),
        apply=F.concat(F.lit(f"{BASE_URL['apple']}/app/{APPLE_LOCALE}/apply/"), quote(job_id)),
    )


# --- google -----------------------------------------------------------------------------------


def _google_seconds(row: Column, index: int) -> Column:
    return F.coalesce(
        F.try_variant_get(row, f"$[{index}]", "bigint"), F.try_variant_get(row, f"$[{index}][0]", "bigint")
    )


def _google_pages(pages: DataFrame) -> DataFrame:
    """Positional arrays of an embedded data block, as variants. A block that is not JSON, or not a list, has no items;
    without an array of rows in it the page is empty."""
    parsed = pages.select("page", F.try_parse_json(F.nullif(F.regexp_extract("payload", CALLBACK % 1, 1), F.lit(""))).alias("v"))
    block = F.try_variant_get("v", "$", "array<variant>")
    rows = F.coalesce(F.try_variant_get("v", "$[0]", "array<variant>"), F.array().cast("array<variant>"))
    lists = F.filter(rows, lambda r: F.try_variant_get(r, "$", "array<variant>").isNotNull())
    return _pages(parsed, F.when(block.isNotNull(), lists), F.try_variant_get("v", "$[3]", "bigint"),
                  F.try_variant_get("v", "$[2]", "bigint"))


def _google_rows(rows: DataFrame) -> DataFrame:
    row = F.col("j")
    job_id = F.nullif(F.try_variant_get(row, "$[0]", "string"), F.lit(""))
    title = F.try_variant_get(row, "$[1]", "string")
    places = F.transform(
        F.coalesce(F.try_variant_get(row, "$[9]", "array<variant>"), F.array().cast("array<variant>")),
        lambda x: F.coalesce(F.try_variant_get(x, "$[0]", "string"), F.try_variant_get(x, "$", "string")),
    )
    path = F.concat(F.lit(f"{BASE_URL['google']}{GOOGLE_RESULTS}/"), job_id, F.lit("-"),
                    slug(F.coalesce(title, F.lit(""))))
    numbered = F.when(F.col("page") > 1, F.concat(path, F.lit("?page="), F.col("page").cast("string"))).otherwise(path)
    return _posting(
        "google", rows, id=job_id, title=title,
        locations=F.filter(places, lambda x: F.coalesce(x, F.lit("")) != ""),
        posted=F.coalesce(F.nullif(_google_seconds(row, 12), F.lit(0)), _google_seconds(row, 13)),
        details=numbered, apply=F.try_variant_get(row, "$[2]", "string"),
    )


# --- microsoft --------------------------------------------------------------------------------

_MICROSOFT = (
    "struct<data:struct<count:string,positions:array<struct<id:string,name:string,postedTs:string,positionUrl:string,"
    "publicUrl:string,standardizedLocations:array<string>>>>>"
)


def _https(url: Column) -> Column:
    return F.regexp_replace(optional_string(url), "^http://", "https://")


def _microsoft_pages(pages: DataFrame) -> DataFrame:
    parsed = pages.select("page", F.from_json("payload", _MICROSOFT).alias("p"))
    return _pages(parsed, F.col("p.data.positions"), F.lit(PAGE_SIZE["microsoft"]), to_int(F.col("p.data.count")))


def _microsoft_rows(rows: DataFrame) -> DataFrame:
    base = BASE_URL["microsoft"]
    job_id = _text("id")
    url = _https(F.col("j.positionUrl"))
    details = F.coalesce(
        F.when(url.startswith("https://"), url).otherwise(
            F.concat(F.lit(f"{base}/"), F.regexp_replace(url, "^/+", ""))),
        _https(F.col("j.publicUrl")),
        F.concat(F.lit(f"{base}/careers/job/"), job_id),
    )
    return _posting(
        "microsoft", rows, [(_text("name"), "a name"), (to_int(F.col("j.postedTs")), "an integer postedTs")],
        id=job_id, title=_text("name"),
        locations=clean_strings(F.col("j.standardizedLocations")),
        posted=to_int(F.col("j.postedTs")),
        details=details, apply=F.concat(F.lit(f"{base}/careers/apply?pid="), job_id),
    )


# --- meta -------------------------------------------------------------------------------------

_META = "struct<data:struct<job_search_with_featured_jobs:struct<all_jobs:array<struct<id:string,title:string,locations:array<string>>>>>>"


def without_loop_prefix(payload: Column) -> Column:
    return F.regexp_replace(payload, r"(?U)^\s*for \(;;\);", "")


def _meta_pages(pages: DataFrame) -> DataFrame:
    parsed = pages.select("page", F.from_json(without_loop_prefix(F.col("payload")), _META).alias("p"))
    found = F.col("p.data.job_search_with_featured_jobs.all_jobs")
    return _pages(parsed, found, F.lit(PAGE_SIZE["meta"]), F.size(found).cast("bigint"))


def _meta_rows(rows: DataFrame) -> DataFrame:
    base = BASE_URL["meta"]
    job_id = _text("id")
    return _posting(
        "meta", rows, id=job_id, title=_text("title"), locations=clean_strings(F.col("j.locations")),
        posted=F.lit(None), details=F.concat(F.lit(f"{base}/jobs/"), quote(job_id), F.lit("/")),
        apply=F.concat(F.lit(f"{base}/profile/create_application/"), quote(job_id)),
    )


# --- netflix ----------------------------------------------------------------------------------

_NETFLIX = (
    "struct<count:string,positions:array<struct<id:string,posting_name:string,name:string,t_create:string,"
    "t_update:string,canonicalPositionUrl:string,locations:array<string>,location:string>>>"
)


def _netflix_pages(pages: DataFrame) -> DataFrame:
    parsed = pages.select("page", F.from_json("payload", _NETFLIX).alias("p"))
    return _pages(parsed, F.col("p.positions"), F.lit(PAGE_SIZE["netflix"]), to_int(F.col("p.count")))


def _netflix_rows(rows: DataFrame) -> DataFrame:
    job_id = _text("id")
    listed = clean_strings(F.col("j.locations"))
    details = F.coalesce(_text("canonicalPositionUrl"),
                         F.concat(F.lit(f"{BASE_URL['netflix']}/careers/job/"), quote(job_id)))
    return _posting(
        "netflix", rows, id=job_id, title=F.coalesce(_text("posting_name"), _text("name")),
        locations=F.when(F.size(listed) > 0, listed).otherwise(clean_strings(F.array("j.location"))),
        posted=F.coalesce(F.nullif(to_int(F.col("j.t_create")), F.lit(0)), to_int(F.col("j.t_update"))),
        details=details, apply=F.concat(details, F.lit("#apply")),
    )


# Per source: pages to lists of items, items to postings.
SOURCES = {
    "amazon": (_amazon_pages, _amazon_rows),
    "apple": (_apple_pages, _apple_rows),
    "google": (_google_pages, _google_rows),
    "microsoft": (_microsoft_pages, _microsoft_rows),
    "meta": (_meta_pages, _meta_rows),
    "netflix": (_netflix_pages, _netflix_rows),
}
# Sources that count pages; the others count the postings before a page.
BY_PAGE = ("apple", "google")


def _strict(source: str):
    read, build = SOURCES[source]
    reason = "no embedded data block" if source == "google" else _NO_LIST

    def parse(pages: DataFrame) -> DataFrame:
        items = F.col("items")
        checked = F.when(items.isNull(), F.raise_error(F.lit(f"{source}: {reason}")).cast("void")).otherwise(items)
        rows = read(pages).select("page", "total", "page_size", F.explode(checked).alias("j"))
        return _required(build(rows), source)

    parse.__doc__ = f"Postings of {source} pages; a bad page fails the job."
    return parse


parse_amazon, parse_apple, parse_google = _strict("amazon"), _strict("apple"), _strict("google")
parse_microsoft, parse_meta, parse_netflix = _strict("microsoft"), _strict("meta"), _strict("netflix")
PARSERS = {
    "amazon": parse_amazon, "apple": parse_apple, "google": parse_google,
    "microsoft": parse_microsoft, "meta": parse_meta, "netflix": parse_netflix,
}


def parse_pages(pages: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(postings, pages) of one source's listing pages, with the page as their key.

    The table of pages keeps every page, empty and bad ones too: page, total, page_size, n_postings, has_next and
    ``error``. Postings of a bad page are left out, as its error says why.
    """
    read, build = SOURCES[source]
    listed = read(pages)
    rows = build(listed.where(F.col("items").isNotNull()).select("page", "total", "page_size", F.explode("items").alias("j")))
    bad = rows.where(F.col("problem").isNotNull()).groupBy("page").agg(F.min("problem").alias("problem"))
    postings = rows.drop("problem").join(bad.select("page"), "page", "left_anti")
    # ``size`` of a list, 0 for a page without one.
    count = F.coalesce(F.when(F.col("items").isNotNull(), F.size("items")), F.lit(0)).cast("bigint")
    sized = listed.select("page", "total", "page_size", F.col("items").isNull().alias("_none"), count.alias("n_postings"))
    error = F.when(F.col("_none"), F.lit(f"{source}: {_NO_LIST}")).when(
        F.col("problem").isNotNull(), F.concat(F.lit(f"{source}: posting without "), F.col("problem")))
    follows = has_next_page(
        F.col("total"), (F.col("page") - 1) * F.col("page_size"), F.col("n_postings"), F.col("page_size"),
        F.col("page") if source in BY_PAGE else None,
    )
    summary = sized.join(bad, "page", "left").withColumn("error", error).select(
        "page", "total", "page_size", "n_postings", F.when(F.col("error").isNull(), follows).alias("has_next"), "error")
    return postings, summary


def _each_source(raw: DataFrame, parse) -> DataFrame:
    out = None
    for source in SOURCES:
        rows = parse(raw.where(F.col("source") == source), source)
        out = rows if out is None else out.unionByName(rows)
    return out


def parse_all(raw: DataFrame) -> DataFrame:
    """Postings of a bronze table (source, page, payload): one branch per source, each reading its own partition."""
    return _each_source(raw, lambda pages, source: PARSERS[source](pages))


def summarize_all(raw: DataFrame) -> DataFrame:
    """The pages of a bronze table with their totals and errors, of all sources."""
    return _each_source(raw, lambda pages, source: parse_pages(pages, source)[1].select(F.lit(source).alias("source"), "*"))


def read_raw_payloads(spark, path: str) -> DataFrame:
    """A bronze table (source, kind, page, external_id, payload, fetched_at), partitioned by source."""
    schema = ("source string, kind string, page bigint, external_id string, payload string, fetched_at timestamp")
    return spark.read.schema(schema).parquet(path)


def has_next_page(total: Column, offset: Column, count: Column, size: Column, page: Column | None = None) -> Column:
    """More pages follow: by the total when it is known, else when the page is full, else when it has anything.

    Sources that count pages (``page`` given) compare page x size with the total, so a short last page ends it as well;
    the others compare the postings up to the end of this page.
    """
    seen = offset + count if page is None else page * size
    sized = F.coalesce(size, F.lit(0)) > 0
    return F.when(total.isNotNull() & sized, seen < total).when(sized, count == size).otherwise(count > 0)


def detail_outcome(status: Column, description: Column) -> Column:
    """``missing`` for a 404 (a NULL status is an error), ``ok`` for 200-399 with a description, else ``error``."""
    code = F.coalesce(status, F.lit(500))
    return (
        F.when(code == 404, "missing").when(code.between(200, 399) & description.isNotNull(), "ok").otherwise("error")
    )
