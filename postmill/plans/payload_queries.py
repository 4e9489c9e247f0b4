"""Payload parsing: raw pages of each source are built from the postings, parsed back, and compared with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pay as P
from ..sources import descriptions as D
from ..sources import payloads as S
from . import views as V
from .register import Registry

query = Registry()


def _posts(spark, sf):
    return V.with_posting_columns(V.base(spark, sf, places=False)).withColumn(
        "epoch", F.unix_seconds("posted_ts")
    ).withColumn("page", F.floor(F.col("doc_id") / 10) + 1)


def _pages(posts, item):
    """Listing pages of ten postings."""
    return posts.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("l")).select(
        "page", F.transform("l", lambda x: x["item"]).alias("items")
    )


def _level_sql(company):
    """Level of the derived titles under one company's rules."""
    bands = {
        "amazon": [("junior", 1, 10), ("senior", 21, 30)],
        "google": [("junior", 11, 20), ("senior", 31, 40)],
        "microsoft": [("junior", 1, 10), ("senior", 21, 30), ("principal", 47, 50)],
        "netflix": [("junior", 41, 43)],
    }.get(company, [])
    whens = " ".join(f"WHEN p_size BETWEEN {low} AND {high} THEN '{level}'" for level, low, high in bands)
    return f"""CASE o_orderpriority WHEN '1-URGENT' THEN 'senior' WHEN '2-HIGH' THEN 'staff' WHEN '5-LOW' THEN 'principal'
 ELSE {f"CASE {whens} ELSE 'mid' END" if whens else "'mid'"} END"""


def _expected(company, details, apply, locations="c_mktsegment || ', ' || lower(lang)", posted="CAST(epoch(posted_ts) AS BIGINT)"):
    return f"""WITH {V.BASE_SQL}
 SELECT external_job_id, title, job_type, {_level_sql(company)} AS job_level, {locations} AS locations,
  {posted} AS posted_epoch, {details} AS details_url, {apply} AS apply_url FROM postings"""


def _out(parsed):
    return parsed.select(
        "external_job_id", "title", "job_type", "job_level", F.array_join("raw_locations", ";").alias("locations"),
        "posted_epoch", "details_url", "apply_url",
    )


def _place():
    return F.concat_ws(", ", "c_mktsegment", F.lower("lang"))


AMAZON = "'https://www.amazon.jobs"


@query("parse_amazon", _expected(
    "amazon", f"{AMAZON}/en/jobs/' || external_job_id",
    f"{AMAZON}/applicant/jobs/' || external_job_id || '/apply'"))
def parse_amazon(spark, sf):
    item = F.struct(
        F.col("external_job_id").alias("id_icims"), F.concat(F.lit(" "), F.col("title")).alias("title"),
        F.when(F.col("lang") == "en", F.concat(F.lit("/en/jobs/"), F.col("external_job_id"))).alias("job_path"),
        F.concat(F.lit("https://account.amazon.com/jobs/"), F.col("external_job_id"), F.lit("/apply")).alias(
            "url_next_step"),
        F.date_format("posted_ts", "MMMM dd, yyyy").alias("posted_date"),
        F.array(F.lit("not json"), F.to_json(F.struct(_place().alias("normalizedLocation")))).alias("locations"),
    )
    pages = _pages(_posts(spark, sf), item)
    return _out(S.parse_amazon(pages.select(
        "page", F.to_json(F.struct(F.size("items").alias("hits"), F.col("items").alias("jobs"))).alias("payload"))))


@query("parse_apple", _expected(
    "apple",
    "'https://jobs.apple.com/en-us/details/' || external_job_id || '/' || regexp_replace(regexp_replace(lower(title),"
    " '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')",
    "'https://jobs.apple.com/app/en-us/apply/' || external_job_id"))
def parse_apple(spark, sf):
    item = F.struct(
        F.when(F.col("lang") == "en", F.col("external_job_id")).alias("positionId"),
        F.col("external_job_id").alias("reqId"), F.col("title").alias("postingTitle"),
        F.when(F.col("lang") == "en", F.date_format("posted_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("postDateInGMT"),
        F.date_format("posted_ts", "MMM dd, yyyy").alias("postingDate"),
        F.array(F.struct(F.col("c_mktsegment").alias("city"), F.lit("").alias("stateProvince"),
                         F.lower("lang").alias("name"))).alias("locations"),
    )
    data = F.to_json(F.struct(F.struct(F.struct(
        F.size("items").alias("totalRecords"), F.col("items").alias("searchResults")).alias("search")).alias("loaderData")))
    escaped = F.replace(F.replace(data, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    page = F.concat(F.lit('<script>window.__staticRouterHydrationData = JSON.parse("'), escaped, F.lit('");</script>'))
    return _out(S.parse_apple(_pages(_posts(spark, sf), item).select("page", page.alias("payload"))))


@query("parse_google", _expected(
    "google",
    "'https://www.google.com/about/careers/applications/jobs/results/' || external_job_id || '-' || regexp_replace("
    "regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || CASE WHEN doc_id >= 10 THEN '?page=' ||"
    " CAST(doc_id // 10 + 1 AS VARCHAR) ELSE '' END", "'https://apply.example.com/' || external_job_id"))
def parse_google(spark, sf):
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    place = F.when(F.col("lang") == "en", q(_place())).otherwise(F.concat(F.lit("["), q(_place()), F.lit(",1]")))
    epoch = F.coalesce(F.col("epoch").cast("string"), F.lit("null"))
    item = F.concat(
        F.lit("["), F.concat_ws(
            ",", q(F.col("external_job_id")), q(F.col("title")),
            q(F.concat(F.lit("https://apply.example.com/"), F.col("external_job_id"))), F.lit("null,null,null,null,null,null"),
            F.concat(F.lit("["), place, F.lit("]")), F.lit("null,null"),
            F.when(F.col("lang") == "en", F.concat(F.lit("["), epoch, F.lit(",0]"))).otherwise("null"), epoch,
        ), F.lit("]"),
    )
    page = F.concat(F.lit("<script>AF_initDataCallback({key: 'ds:1', hash: '2', data:[["), F.array_join("items", ","),
                    F.lit("],null,"), F.size("items").cast("string"), F.lit(",20], sideChannel: {}});</script>"))
    return _out(S.parse_google(_pages(_posts(spark, sf), item).select("page", page.alias("payload"))))


@query("parse_microsoft", _expected(
    "microsoft", "'https://apply.careers.microsoft.com/careers/job/' || external_job_id",
    "'https://apply.careers.microsoft.com/careers/apply?pid=' || external_job_id",
    posted="coalesce(CAST(epoch(posted_ts) AS BIGINT), 0)"))
def parse_microsoft(spark, sf):
    url = F.concat(F.lit("careers/job/"), F.col("external_job_id"))
    item = F.struct(
        F.col("doc_id").alias("id"), F.col("title").alias("name"), F.coalesce("epoch", F.lit(0)).alias("postedTs"),
        F.when(F.col("lang") == "en", F.concat(F.lit("/"), url)).when(F.col("lang") == "de", url).alias("positionUrl"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("http://apply.careers.microsoft.com/"), url)).alias("publicUrl"),
        F.array(_place(), F.lit(" ")).alias("standardizedLocations"),
    )
    data = F.to_json(F.struct(F.struct(F.size("items").alias("count"), F.col("items").alias("positions")).alias("data")))
    return _out(S.parse_microsoft(_pages(_posts(spark, sf), item).select("page", data.alias("payload"))))


@query("parse_meta", _expected(
    "meta", "'https://www.metacareers.com/jobs/' || external_job_id || '/'",
    "'https://www.metacareers.com/profile/create_application/' || external_job_id", posted="CAST(NULL AS BIGINT)"))
def parse_meta(spark, sf):
    item = F.struct(F.col("external_job_id").alias("id"), "title", F.array(_place()).alias("locations"))
    data = F.to_json(F.struct(F.struct(F.struct(F.col("items").alias("all_jobs")).alias("job_search_with_featured_jobs"))
                              .alias("data")))
    return _out(S.parse_meta(_pages(_posts(spark, sf), item).select(
        "page", F.concat(F.lit("for (;;);"), data).alias("payload"))))


@query("parse_netflix", _expected(
    "netflix", "'https://explore.jobs.netflix.net/careers/job/' || external_job_id",
    "'https://explore.jobs.netflix.net/careers/job/' || external_job_id || '#apply'"))
def parse_netflix(spark, sf):
    item = F.struct(
        F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", F.col("title")).alias("posting_name"),
        F.col("title").alias("name"), F.when(F.col("lang") == "en", F.col("epoch")).alias("t_create"),
        F.col("epoch").alias("t_update"), F.when(F.col("lang") == "en", F.array(_place())).alias("locations"),
        _place().alias("location"),
    )
    data = F.to_json(F.struct(F.size("items").alias("count"), F.col("items").alias("positions")))
    return _out(S.parse_netflix(_pages(_posts(spark, sf), item).select("page", data.alias("payload"))))


@query(
    "public_compensation",
    """SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS min_amount,
  CASE WHEN o_orderstatus <> 'O' THEN CAST(floor(o_totalprice) AS BIGINT) + 5000 END AS max_amount,
  CASE o_orderstatus WHEN 'F' THEN 'GBP' ELSE 'USD' END AS currency,
  CASE o_orderstatus WHEN 'F' THEN 'year' WHEN 'P' THEN 'month' ELSE 'hour' END AS "interval",
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Bonus eligible' ELSE 'Equity eligible' END AS notes
 FROM orders""",
)
def public_compensation(spark, sf):
    o = V.table(spark, sf, "orders")
    low = F.floor("o_totalprice").cast("bigint")
    status = F.col("o_orderstatus")
    say = lambda x: F.concat(
        F.when(status == "F", "£").otherwise("$"), F.format_string("%,d", x),
        F.when(status == "F", "/yr").when(status == "P", " / month").otherwise("/hr"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    item = F.struct(
        say(low).alias("compensation_amount_minimum"),
        F.when(status != "O", say(low + 5000)).alias("compensation_amount_maximum"),
        urgent.alias("has_bonus"), (~urgent).alias("has_equity"),
    )
    # The same list twice: merging keeps one copy.
    pay = o.select("o_orderkey", D.public_compensation(F.to_json(F.array(item, item))).alias("a"))
    merged = pay.select("o_orderkey", P.merge_pay(F.col("a"), F.col("a")).alias("m"))
    return merged.select("o_orderkey", F.explode("m.ranges").alias("r"), F.array_join("m.notes", ",").alias("notes")).select(
        "o_orderkey", "r.min_amount", "r.max_amount", "r.currency", "r.interval", "notes")


@query(
    "has_next_page",
    """SELECT user_id, event_type, count(*) AS n, CASE event_type WHEN 'view' THEN 20 + count(*) < 30
  WHEN 'click' THEN count(*) = 10 WHEN 'error' THEN 3 * 10 < 25 + user_id % 10 ELSE count(*) > 0 END AS has_next
 FROM events GROUP BY user_id, event_type""",
)
def has_next_page(spark, sf):
    g = V.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    kind = F.col("event_type")
    total = F.when(kind == "view", F.lit(30)).when(kind == "error", 25 + F.col("user_id") % 10)
    size = F.when(kind.isin("view", "click", "error"), F.lit(10))
    by_offset = S.has_next_page(total, F.lit(20), F.col("n"), size)
    by_page = S.has_next_page(total, F.lit(20), F.col("n"), size, F.lit(3))
    return g.withColumn("has_next", F.when(kind == "error", by_page).otherwise(by_offset))


# Pages of ten documents; the total leaves the last page short, and some pages are empty, broken or lack an id.
@query(
    "parse_pages",
    """WITH pages AS (
  SELECT doc_id // 10 + 1 AS page, count(*) AS n, count(*) FILTER (WHERE lang = 'es') AS spanish FROM documents GROUP BY 1),
 kinds AS (
  SELECT *, CASE WHEN page % 7 = 0 THEN 'empty' WHEN page % 11 = 0 THEN 'broken' WHEN spanish > 2 THEN 'lacking' ELSE 'fine' END
   AS kind FROM pages),
 sources AS (SELECT * FROM kinds, (VALUES ('amazon'), ('apple'), ('google'), ('microsoft'), ('meta'), ('netflix')) s(source)),
 filled AS (
  SELECT source, page, kind, CASE WHEN kind = 'broken' THEN 0 WHEN kind = 'empty' THEN 0 ELSE n END AS n_postings,
   CASE WHEN kind = 'broken' AND source <> 'apple' THEN NULL WHEN source = 'meta' THEN CASE WHEN kind = 'empty' THEN 0 ELSE n END
    ELSE (SELECT count(*) FROM documents) - 3 END AS total,
   CASE WHEN source IN ('apple', 'google') THEN 20 ELSE 10 END AS size FROM sources)
 SELECT source, page, total, CASE WHEN source = 'google' AND kind = 'broken' THEN NULL ELSE size END AS page_size, n_postings,
  CASE WHEN kind IN ('broken', 'lacking') THEN NULL WHEN source IN ('apple', 'google') THEN page * size < total
   ELSE (page - 1) * size + n_postings < total END AS has_next,
  CASE kind WHEN 'broken' THEN source || ': a listing page has no list of postings'
   WHEN 'lacking' THEN source || ': posting without an id' END AS error
 FROM filled""",
)
def parse_pages(spark, sf):
    """The table of pages of all six sources, with empty, broken and incomplete pages among them."""
    docs = V.table(spark, sf, "documents").select((F.floor(F.col("doc_id") / 10) + 1).alias("page"), "doc_id", "lang")
    job_id = F.when(F.col("lang") != "es", F.col("doc_id").cast("string"))
    pages = docs.groupBy("page").agg(
        F.count_if(F.col("lang") == "es").alias("spanish"), F.collect_list(F.struct(F.col("doc_id").alias("n"), job_id.alias("id"))).alias("all"))
    total = docs.count() - 3
    kind = F.when(F.col("page") % 7 == 0, "empty").when(F.col("page") % 11 == 0, "broken").when(
        F.col("spanish") > 2, "lacking").otherwise("fine")
    # Where at most two ids are missing, the page is given all of them.
    given = F.transform("all", lambda x: F.coalesce(x["id"], F.when(F.col("spanish") <= 2, x["n"].cast("string"))))
    shown = pages.select("page", kind.alias("kind"), F.when(kind == "empty", F.array().cast("array<string>")).otherwise(given).alias("ids"))
    items = lambda *fields: F.transform("ids", lambda i: F.struct(*[f(i) for f in fields]))
    named = lambda name: lambda i: i.alias(name)
    text = lambda name, value: lambda i: F.lit(value).alias(name)
    fine = F.col("kind") != "broken"
    hits = F.lit(str(total))
    apple = F.to_json(F.struct(F.struct(F.struct(
        hits.alias("totalRecords"), F.when(fine, items(named("positionId"), text("postingTitle", "it's"))).alias("searchResults")
    ).alias("search")).alias("loaderData")))
    # Script escapes that JSON does not have.
    apple = F.replace(F.replace(F.replace(apple, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("it's"), F.lit("it\\'s \\x3c"))
    row = F.transform("ids", lambda i: F.concat(F.lit("["), F.coalesce(F.concat(F.lit('"'), i, F.lit('"')), F.lit('""')), F.lit(',"t"]')))
    block = F.concat(F.lit("[["), F.array_join(row, ","), F.lit(f"],null,{total},20]"))
    payloads = {
        "amazon": F.to_json(F.struct(hits.alias("hits"), F.when(fine, items(named("id"), text("title", "t"))).alias("jobs"))),
        "apple": F.concat(F.lit('window.__staticRouterHydrationData = JSON.parse("'), apple, F.lit('");')),
        "google": F.concat(F.lit("AF_initDataCallback({key: 'ds:1', hash: '2', data:"), F.when(fine, block).otherwise("[[oops"),
                           F.lit(", sideChannel: {}});")),
        "microsoft": F.to_json(F.struct(F.struct(hits.alias("count"), F.when(
            fine, items(named("id"), text("name", "t"), text("postedTs", "5"))).alias("positions")).alias("data"))),
        "meta": F.concat(F.lit("for (;;);"), F.to_json(F.struct(F.struct(F.struct(F.when(
            fine, items(named("id"), text("title", "t"))).alias("all_jobs")).alias("job_search_with_featured_jobs")).alias("data")))),
        "netflix": F.to_json(F.struct(hits.alias("count"), F.when(fine, items(named("id"), text("name", "t"))).alias("positions"))),
    }
    raw = shown.select("page", F.explode(F.array(*[
        F.struct(F.lit(name).alias("source"), (F.when(fine, p).otherwise(F.lit("{}")) if name in ("amazon", "microsoft", "netflix", "meta") else p)
                 .alias("payload")) for name, p in payloads.items()])).alias("r")).select("page", "r.source", "r.payload")
    found = S.summarize_all(raw)
    return found.select("source", "page", "total", "page_size", "n_postings", "has_next", "error")


@query(
    "detail_outcome",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'missing' WHEN 'signup' THEN 'error'
  WHEN 'view' THEN CASE WHEN value > 30 THEN 'ok' ELSE 'error' END WHEN 'click' THEN 'ok' ELSE 'error' END AS outcome
 FROM events""",
)
def detail_outcome(spark, sf):
    e = V.table(spark, sf, "events")
    status = (F.when(F.col("event_type") == "error", 404).when(F.col("event_type") == "view", 200)
              .when(F.col("event_type") == "click", 302).when(F.col("event_type") == "purchase", 503))
    text = F.when((F.col("event_type") != "view") | (F.col("value") > 30), F.col("props"))
    return e.select("event_id", S.detail_outcome(status, text).alias("outcome"))


@query(
    "describe_postings",
    f"""WITH {V.BASE_SQL} SELECT doc_id, title || chr(10) || chr(10) || 'Summary' || chr(10) || source || chr(10) ||
 chr(10) || 'Description' || chr(10) || lang || ' & more' || chr(10) || 'second' AS apple,
 title || chr(10) || chr(10) || 'About' || chr(10) || source || chr(10) || chr(10) || 'Skills:' || chr(10) || lang
  AS microsoft,
 title || chr(10) || chr(10) || source || chr(10) || lang AS netflix,
 title || chr(10) || chr(10) || 'Description' || chr(10) || source || chr(10) || chr(10) || 'Responsibilities' ||
  chr(10) || lang || ' & co' || chr(10) || 'more' AS meta
 FROM postings""",
)
def describe_postings(spark, sf):
    p = _posts(spark, sf)
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    src, lang = F.col("source"), F.col("lang")
    apple = F.to_json(F.struct(
        F.col("title").alias("postingTitle"), say("<p>", src, "</p>").alias("jobSummary"),
        say("<ul><li>", lang, " &amp; more</li><li>second</li></ul>").alias("description")))
    microsoft = F.to_json(F.struct(
        F.col("title").alias("name"),
        say("<b>About</b><div>", src, "</div><strong>Skills:</strong><br>- ", lang).alias("jobDescription")))
    netflix = F.to_json(F.struct(F.col("title").alias("posting_name"),
                                 say("<p>", src, "</p><p>* ", lang, "</p>").alias("job_description")))
    meta = F.to_json(F.struct(
        "title", say('{"__html":"<p>', src, '</p>"}').alias("description"),
        F.array(F.struct(say(lang, " &amp;  co").alias("item")), F.struct(F.lit("more").alias("item")),
                F.struct(F.lit(" more ").alias("item"))).alias("responsibilities")))
    out = p.select("doc_id", apple.alias("apple"), microsoft.alias("microsoft"), netflix.alias("netflix"), meta.alias("meta"))
    for name in ("apple", "microsoft", "netflix", "meta"):
        out = D.DESCRIBE[name](out.withColumnRenamed(name, "payload")).drop("payload").withColumnRenamed("description", name)
    return out
