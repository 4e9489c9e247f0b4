"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import money as M
from ..functions import text as T
from ..operators.pay import clean_fragment
from ..streaming.heartbeat import reason_of
from . import views as V
from .register import Registry

query = Registry()


@query(
    "text_functions",
    r"""SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS optional, n_chars AS number,
  trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed,
  coalesce(nullif(regexp_replace(regexp_replace(lower(source || ' ' || lang || '!'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '',
   'g'), ''), 'job') AS slug,
  source || chr(10) || lang AS unlisted, source || ',' || lang AS deduped, source || '%20' || lang || '/x' AS quoted
 FROM documents""",
)
def text_functions(spark, sf):
    d = V.table(spark, sf, "documents")
    lang, source = F.col("lang"), F.col("source")
    nbsp = " "
    return d.select(
        "doc_id",
        T.optional_string(F.when(lang == "en", f" {nbsp}\t").otherwise(F.concat(F.lit(nbsp), lang, F.lit(" \n")))).alias("optional"),
        T.to_int(F.concat(F.lit(" "), F.col("n_chars").cast("string"), F.lit(" "))).alias("number"),
        T.collapse_space(F.col("text")).alias("collapsed"),
        T.slug(F.concat(source, F.lit(" "), lang, F.lit("!"))).alias("slug"),
        T.strip_list_markers(F.concat(F.lit("- "), source, F.lit("\n  • "), lang)).alias("unlisted"),
        F.array_join(T.dedupe(F.array(source, lang, source)), ",").alias("deduped"),
        T.quote(F.concat(source, F.lit(" "), lang, F.lit("/x"))).alias("quoted"),
    )


@query(
    "line_functions",
    """SELECT doc_id, source || chr(10) || chr(10) || lang AS squeezed, source || chr(10) || chr(10) || lang AS trimmed,
  source || ' ' || lang AS joined, source || chr(10) || ' ' || lang || ' & <b>' AS cleaned FROM documents""",
)
def line_functions(spark, sf):
    d = V.table(spark, sf, "documents")
    lang, source = F.col("lang"), F.col("source")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return d.select(
        "doc_id",
        T.squeeze_blank_lines(say(source, "\r\n\r\n\r\n", "\n", lang, "\n")).alias("squeezed"),
        T.trim_lines(say("  ", source, " \n \n\n  ", lang)).alias("trimmed"),
        T.join_lines(say(source, "\n\n ", lang, " \n")).alias("joined"),
        clean_fragment(say("<p>", source, "</p><ul><li>", lang, " &amp; &lt;b&gt;</li></ul>")).alias("cleaned"),
    )


@query(
    "date_functions",
    """SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS long_name, CAST(epoch(o_orderdate) AS BIGINT) AS short_name,
  CAST(epoch(o_orderdate) AS BIGINT) AS iso, CAST(epoch(o_orderdate) AS BIGINT) - 7200 AS with_offset,
  CAST(epoch(o_orderdate) AS BIGINT) AS any_value, epoch_ms(o_orderdate) AS millis FROM orders""",
)
def date_functions(spark, sf):
    o = V.table(spark, sf, "orders")
    day = F.col("o_orderdate")
    seconds = D.epoch_seconds(day)
    spelled = (
        F.when(F.col("o_orderstatus") == "F", (seconds * 1000).cast("string"))
        .when(F.col("o_orderstatus") == "P", F.to_json(F.struct(seconds.alias("time"))))
        .otherwise(F.date_format(day, "MMM d, yyyy"))
    )
    # Numbers below the limit are seconds already, so early dates in milliseconds would be misread; all are later.
    return o.select(
        "o_orderkey", D.month_name_epoch(F.date_format(day, "MMMM dd, yyyy")).alias("long_name"),
        D.month_name_epoch(F.date_format(day, "MMM  d, yyyy")).alias("short_name"),
        D.iso_epoch(F.date_format(day, "yyyy-MM-dd")).alias("iso"),
        D.iso_epoch(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).alias("with_offset"),
        D.any_epoch(spelled).alias("any_value"), D.epoch_millis(day).alias("millis"),
    )


@query(
    "split_location",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '' ELSE c_name END AS city,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'WA' WHEN 'HOUSEHOLD' THEN 'BUR' WHEN 'FURNITURE' THEN c_mktsegment
   ELSE '' END AS region,
  CASE c_mktsegment WHEN 'BUILDING' THEN c_name WHEN 'AUTOMOBILE' THEN 'UK' WHEN 'FURNITURE' THEN 'x, y' ELSE '' END
   AS country FROM customer""",
)
def split_location(spark, sf):
    segment = F.col("c_mktsegment")
    text = (
        F.when(segment == "BUILDING", F.col("c_name")).when(segment == "AUTOMOBILE", F.concat("c_name", F.lit(", UK")))
        .when(segment == "MACHINERY", F.concat("c_name", F.lit(" ,WA")))
        .when(segment == "HOUSEHOLD", F.concat("c_name", F.lit(", BUR,")))
        .otherwise(F.concat_ws(", ", "c_name", segment, F.lit("x"), F.lit("y")))
    )
    return V.table(spark, sf, "customer").select("c_custkey", T.split_location(text).alias("l")).select("c_custkey", "l.*")


@query(
    "status_functions",
    """SELECT event_id, CASE event_type WHEN 'view' THEN true WHEN 'click' THEN true ELSE false END AS ok,
  CASE CAST(json_extract_string(props, '$.k') AS INT) % 7 WHEN 0 THEN 'capacity' WHEN 1 THEN 'blocked' WHEN 2 THEN 'inuse'
   WHEN 3 THEN 'duplicate' WHEN 4 THEN 'invalid_capacity' WHEN 5 THEN 'unknown' ELSE 'unknown' END AS reason FROM events""",
)
def status_functions(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "click", "204").when(kind == "error", "500").when(kind == "signup", "ok").when(kind == "purchase", "302")
    k = F.get_json_object("props", "$.k").cast("int")
    return V.table(spark, sf, "events").select(
        "event_id", T.status_ok(status).alias("ok"), reason_of(-(k % 7)).alias("reason"))


@query(
    "money_functions",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'CAD' WHEN 'O' THEN 'EUR' END AS currency,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'month' WHEN '2-HIGH' THEN 'hour' WHEN '5-LOW' THEN 'year' END AS "interval",
  CAST(floor(o_totalprice) AS BIGINT) AS amount, CASE o_orderpriority WHEN '1-URGENT' THEN 'week' ELSE 'sprint' END AS unit
 FROM orders""",
)
def money_functions(spark, sf):
    o = V.table(spark, sf, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    code = F.when(status == "F", "ca").when(status == "O", "eur").otherwise("zz")
    phrase = (F.when(priority == "1-URGENT", "paid per month").when(priority == "2-HIGH", "hourly pay")
              .when(priority == "5-LOW", "the base salary range").otherwise("nothing"))
    say = F.concat(F.lit("€ "), F.format_string("%,d", F.floor("o_totalprice").cast("bigint")),
                   F.when(priority == "1-URGENT", " / wk").otherwise("/sprint"))
    return o.select("o_orderkey", M.code_currency(code).alias("currency"), M.interval_word(phrase).alias("interval"),
                    M.public_amount(say).alias("p")).select("o_orderkey", "currency", "interval", "p.amount",
                                                            F.col("p.interval").alias("unit"))
