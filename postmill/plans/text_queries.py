"""Feature queries on texts: titles, skills, pay, pages, locations, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.titles import classify_title, resolve_level, title_level
from ..operators import embed as E
from ..operators import pay as P
from ..operators import skills as K
from ..operators.locations import Gazetteer, normalize_locations
from . import views as V
from .register import Registry

query = Registry()


@query(
    "classify_title",
    f"""WITH {V.BASE_SQL} SELECT external_job_id, title, job_type FROM postings""",
)
def classify_titles(spark, sf):
    posts = V.jobs(spark, sf, places=False).select("external_job_id", "title")
    return posts.withColumn("job_type", classify_title(F.col("title")))


@query(
    "title_level",
    f"""WITH {V.BASE_SQL} SELECT external_job_id, company, title, job_level FROM postings""",
)
def title_levels(spark, sf):
    posts = V.jobs(spark, sf, places=False).select("external_job_id", "company", "title")
    return posts.withColumn("job_level", title_level(F.col("title"), F.col("company")))


@query(
    "resolve_level",
    f"""WITH {V.BASE_SQL} SELECT external_job_id, CASE lang WHEN 'fr' THEN 'fellow' ELSE job_level END AS job_level
 FROM postings""",
)
def resolve_levels(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("external_job_id"), "lang")
    given = F.when(F.col("lang") == "fr", " Fellow ").when(F.col("lang") == "de", "boss").otherwise("")
    posts = V.jobs(spark, sf, places=False).select("external_job_id", "company", "title").join(docs, "external_job_id")
    return posts.select(
        "external_job_id", resolve_level(given, F.col("title"), F.col("company")).alias("job_level")
    )


# --- Skills -----------------------------------------------------------------------------------

WORD_SQL = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+(?:[.+#''&/\-]*[\p{{L}}\p{{N}}_]+)*[+#]*|[^\s\p{{L}}\p{{N}}_]')"
# Places of the words of an item, and of the pairs behind all words.
_ITEM, _SOURCE = 1_000_000, 10**15
VOCAB_SQL = f"""
spoken AS (
 SELECT item_id, words, unnest(range(1, len(words) + 1)) AS pos FROM (
  SELECT item_id, regexp_extract_all(text, '[\\p{{L}}]+') AS words FROM benchmark)
),
lines AS (
 SELECT item_id * {_ITEM} + pos AS place, words[pos] AS skill FROM spoken
 UNION ALL
 SELECT {_SOURCE} + item_id * {_ITEM} + pos, words[pos] || ' ' || words[pos + 1] FROM spoken WHERE pos < len(words)
),
vocab AS (
 SELECT lower(skill) AS key, arg_min(skill, place) AS skill, min(place) AS place FROM lines GROUP BY lower(skill)
)"""


def words_and_pairs(spark, sf):
    """(skill, line) of all words of the benchmark texts, and of all pairs of neighbouring words."""
    b = V.table(spark, sf, "benchmark")
    words = F.regexp_extract_all("text", F.lit(r"([\p{L}]+)"), 1)
    spoken = b.select("item_id", words.alias("words")).select("item_id", F.posexplode("words").alias("pos", "skill"), "words")
    line = (F.col("item_id") * _ITEM + F.col("pos") + 1).alias("line")
    pair = F.concat_ws(" ", "skill", F.get("words", F.col("pos") + 1)).alias("skill")
    return spoken.select("skill", line), spoken.where(F.col("pos") + 1 < F.size("words")).select(pair, line)


def vocab(spark, sf):
    return K.vocabulary(*words_and_pairs(spark, sf))


@query("vocabulary", f"WITH {VOCAB_SQL} SELECT skill, place FROM vocab")
def vocabulary(spark, sf):
    return vocab(spark, sf).select("skill", (F.col("source") * _SOURCE + F.col("line")).alias("place"))


_SKILLS_SQL = f"""WITH {VOCAB_SQL},
words AS (SELECT doc_id AS id, {WORD_SQL.format('text')} AS w FROM documents),
toks AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM words),
grams AS (
 SELECT id, pos, 1 AS size, word AS key FROM toks
 UNION ALL
 SELECT a.id, a.pos, 2, a.word || ' ' || b.word FROM toks a JOIN toks b ON b.id = a.id AND b.pos = a.pos + 1
),
found AS (SELECT g.id, v.skill, min(g.pos * 10 + g.size) AS place FROM grams g JOIN vocab v USING (key) GROUP BY ALL)"""


@query(
    "skill_matches",
    f"{_SKILLS_SQL} SELECT id, skill, place // 10 AS pos, place % 10 AS size FROM found",
)
def skill_matches(spark, sf):
    docs = V.texts(spark, sf)
    return K.skill_matches(docs, vocab(spark, sf)).select(
        "id", "skill", F.col("pos").cast("bigint").alias("pos"), F.col("size").cast("bigint").alias("size")
    )


@query(
    "extract_skills",
    f"""{_SKILLS_SQL}
 SELECT d.doc_id AS id, coalesce(s.skills, '') AS skills FROM documents d LEFT JOIN
 (SELECT id, string_agg(skill, '|' ORDER BY place) AS skills FROM found GROUP BY id) s ON s.id = d.doc_id""",
)
def extract_skills(spark, sf):
    docs = V.texts(spark, sf)
    return K.extract_skills(docs, vocab(spark, sf)).select("id", F.array_join("skills", "|").alias("skills"))


def _lemma_sql(word):
    return f"""CASE WHEN length({word}) <= 3 THEN {word} WHEN {word} LIKE '%ies' THEN regexp_replace({word}, 'ies$', 'y')
  WHEN regexp_matches({word}, '(ss|us|is)$') THEN {word}
  WHEN regexp_matches({word}, '(x|ch|sh|ss)es$') THEN regexp_replace({word}, 'es$', '')
  WHEN {word} LIKE '%s' THEN regexp_replace({word}, 's$', '') ELSE {word} END"""


_FIRST, _SECOND = "split_part(key, ' ', 1)", "split_part(key, ' ', 2)"


@query(
    "extract_skills_lemma",
    f"""{_SKILLS_SQL},
 base AS (SELECT id, pos, {_lemma_sql('word')} AS word FROM toks),
 base_grams AS (
  SELECT id, pos, 1 AS size, word AS key FROM base
  UNION ALL
  SELECT a.id, a.pos, 2, a.word || ' ' || b.word FROM base a JOIN base b ON b.id = a.id AND b.pos = a.pos + 1
 ),
 base_vocab AS (
  SELECT base_key, arg_min(skill, place) AS skill FROM (
   SELECT skill, place, {_lemma_sql(_FIRST)} || CASE WHEN {_SECOND} <> '' THEN ' ' || {_lemma_sql(_SECOND)} ELSE '' END
    AS base_key FROM vocab) GROUP BY base_key
 ),
 loose AS (
  SELECT g.id, v.skill, min(g.pos * 10 + g.size) AS place FROM base_grams g JOIN base_vocab v ON v.base_key = g.key
  GROUP BY ALL
 ),
 both_stages AS (
  SELECT id, skill, 1 AS stage, place FROM found
  UNION ALL
  SELECT l.id, l.skill, 2, l.place FROM loose l ANTI JOIN found f ON f.id = l.id AND f.skill = l.skill
 )
 SELECT d.doc_id AS id, coalesce(s.skills, '') AS skills FROM documents d LEFT JOIN
 (SELECT id, string_agg(skill, '|' ORDER BY stage, place) AS skills FROM both_stages GROUP BY id) s ON s.id = d.doc_id""",
)
def extract_skills_lemma(spark, sf):
    docs = V.texts(spark, sf)
    return K.extract_skills(docs, vocab(spark, sf), lemmas=True).select("id", F.array_join("skills", "|").alias("skills"))


# --- Pay --------------------------------------------------------------------------------------


def pay_texts(spark, sf):
    """A pay sentence for every order in the spelling of its priority, inside the text of the document of that id."""
    o = V.table(spark, sf, "orders")
    d = V.table(spark, sf, "documents").select("doc_id", "text")
    low = F.floor("o_totalprice").cast("bigint")
    x, y = F.format_string("%,d", low), F.format_string("%,d", low + 10000)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    sentence = (
        F.when(F.col("o_orderpriority") == "1-URGENT",
               say("Base salary range is $", x, " - $", y, " per year. Bonus may apply."))
        .when(F.col("o_orderpriority") == "2-HIGH",
              say("<p>Pay range: CA ", x, " to ", y, " annually</p><p>Equity &amp; benefits</p>"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", say("Hourly work, €", x, "–€", y, "! Compensation is fair"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", say("Between ", x, " - ", y, " units"))
        .otherwise(say("Compensation ", x, " - ", y, "\nCompensation ", x, " - ", y, "\n"))
    )
    joined = o.join(d, F.col("o_orderkey") == F.col("doc_id"), "left")
    said = joined.select("o_orderkey", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), sentence).alias("text"))
    return said


_PAY_SQL = """
priced AS (
 SELECT o_orderkey, o_orderpriority AS p, CAST(floor(o_totalprice) AS BIGINT) AS lo,
  CAST(floor(o_totalprice) AS BIGINT) + 10000 AS hi, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS x,
  format('{:,}', CAST(floor(o_totalprice) AS BIGINT) + 10000) AS y FROM orders
),
ranges AS (
 SELECT o_orderkey, lo AS min_amount, hi AS max_amount,
  CASE p WHEN '1-URGENT' THEN 'USD' WHEN '2-HIGH' THEN 'CAD' WHEN '3-MEDIUM' THEN 'EUR' END AS currency,
  CASE p WHEN '1-URGENT' THEN 'year' WHEN '2-HIGH' THEN 'year' WHEN '3-MEDIUM' THEN 'hour' END AS "interval",
  CASE p WHEN '1-URGENT' THEN 'Base salary range is $' || x || ' - $' || y || ' per year.'
   WHEN '2-HIGH' THEN 'Pay range: CA ' || x || ' to ' || y || ' annually'
   WHEN '3-MEDIUM' THEN 'Hourly work, €' || x || '–€' || y || '!'
   ELSE 'Compensation ' || x || ' - ' || y END AS context,
  CASE p WHEN '1-URGENT' THEN 'Bonus may apply.' WHEN '2-HIGH' THEN 'Equity & benefits'
   WHEN '3-MEDIUM' THEN 'Compensation is fair' ELSE '' END AS own_notes
 FROM priced WHERE p <> '4-NOT SPECIFIED' AND length(CAST(lo AS VARCHAR)) > 3
)"""


@query(
    "extract_pay_ranges",
    f"""WITH {_PAY_SQL} SELECT o_orderkey, min_amount, max_amount, currency, "interval", context FROM ranges""",
)
def extract_pay_ranges(spark, sf):
    return P.pay_range_rows(pay_texts(spark, sf), "o_orderkey")


@query(
    "extract_pay_notes",
    f"""WITH {_PAY_SQL} SELECT o_orderkey, own_notes AS note FROM ranges WHERE own_notes <> ''""",
)
def extract_pay_notes(spark, sf):
    return P.pay_note_rows(pay_texts(spark, sf), "o_orderkey")


# --- Pages ------------------------------------------------------------------------------------


def _page_text_sql(column):
    out = f"regexp_replace({column}, '(?s)<!--.*?-->', ' ', 'g')"
    for name in H.SKIPPED:
        out = f"regexp_replace({out}, '(?is)<{name}\\b[^>]*>.*?</{name}\\s*>', ' ', 'g')"
    return out


@query(
    "html_to_text",
    f"""WITH cleaned AS (SELECT page_id, {_page_text_sql('html')} AS h FROM pages),
 main AS (SELECT page_id, coalesce(nullif(regexp_extract(h, '(?is)<article\\b[^>]*>(.*)</article\\s*>', 1), ''), h) AS h
  FROM cleaned),
 plain AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</?(?:{H.BLOCKS})\\b[^>]*>', chr(10), 'g'),
  '<[^>]*>', '', 'g') AS h FROM main),
 decoded AS (SELECT page_id, regexp_replace(replace(replace(replace(h, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'),
  '&amp;?', '&', 'g') AS h FROM plain),
 lines AS (SELECT page_id, list_filter(list_transform(string_split(h, chr(10)),
  lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> '') AS ls FROM decoded)
 SELECT page_id, nullif(array_to_string(ls, chr(10)), '') AS text FROM lines""",
)
def html_to_text(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", H.html_to_text(F.col("html"), full_document=True).alias("text"))


def job_pages(spark, sf):
    """Job pages built from the postings: JSON-LD in a graph, in a list, broken, or only a meta description."""
    posts = V.with_posting_columns(V.base(spark, sf, places=False))
    ld = F.to_json(F.struct(
        F.lit("JobPosting").alias("@type"), "title", F.col("source").alias("description"),
        F.date_format("posted_ts", "yyyy-MM-dd").alias("datePosted"),
    ))
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    head = (
        F.when(F.col("lang") == "en", script(F.concat(F.lit('{"@graph":[{"@type":"Thing"},'), ld, F.lit("]}"))))
        .when(F.col("lang") == "de", F.concat(script(F.lit("{broken")), script(F.concat(F.lit("["), ld, F.lit("]")))))
        .when(F.col("lang") == "fr", F.concat(F.lit('<meta name="description" content="'), F.col("source"), F.lit('">')))
        .otherwise(script(F.concat(F.lit('{"data":{"inner":'), ld, F.lit("}}"))))
    )
    page = F.concat(F.lit("<html><head>"), head, F.lit("</head><body><p>"), F.col("title"), F.lit("</p></body></html>"))
    return posts.select("doc_id", page.alias("page"))


@query(
    "extract_json_ld",
    f"""WITH {V.BASE_SQL} SELECT doc_id, CASE WHEN lang <> 'fr' THEN title END AS title,
 CASE WHEN lang <> 'fr' THEN source END AS description FROM postings""",
)
def extract_json_ld(spark, sf):
    found = job_pages(spark, sf).withColumn("posting", H.job_posting(F.col("page")))
    return found.select(
        "doc_id", F.get_json_object("posting", "$.title").alias("title"),
        F.get_json_object("posting", "$.description").alias("description"),
    )


@query(
    "extract_date_posted",
    f"""WITH {V.BASE_SQL} SELECT doc_id, CASE WHEN lang <> 'fr' THEN CAST(epoch(posted_ts) AS BIGINT) END AS posted_ts
 FROM postings""",
)
def extract_date_posted(spark, sf):
    return job_pages(spark, sf).select("doc_id", H.date_posted(F.col("page")).alias("posted_ts"))


@query(
    "page_description",
    f"""WITH {V.BASE_SQL} SELECT doc_id, CASE lang WHEN 'fr' THEN source WHEN 'es' THEN title
 ELSE title || chr(10) || chr(10) || source END AS description FROM postings""",
)
def page_description(spark, sf):
    return job_pages(spark, sf).select("doc_id", H.page_description(F.col("page")).alias("description"))


@query(
    "render_sections",
    """SELECT doc_id, coalesce(lang || chr(10) || chr(10), '') || 'Summary' || chr(10) || source ||
 CASE WHEN lang = 'en' THEN chr(10) || chr(10) || 'Description' || chr(10) || n_chars ELSE '' END AS body
 FROM documents""",
)
def render_sections(spark, sf):
    d = V.table(spark, sf, "documents")
    body = H.join_sections(
        H.section("Summary", F.col("source")),
        H.section("Description", F.when(F.col("lang") == "en", F.col("n_chars").cast("string")).otherwise("")),
        H.section("Responsibilities", F.lit(None).cast("string")),
    )
    return d.select("doc_id", H.prepend_title(F.col("lang"), body).alias("body"))


# --- Locations --------------------------------------------------------------------------------


def gazetteer(spark, sf):
    """Regions as countries, nations as their subdivisions, market segments per nation as cities."""
    nation, region, customer = (V.table(spark, sf, name) for name in ("nation", "region", "customer"))
    iso = F.substring("r_name", 1, 2)
    countries = region.select(F.explode(F.array("r_name", iso)).alias("alias"), F.col("r_name").alias("name"),
                              iso.alias("iso2"))
    owned = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    subdivisions = owned.select(
        F.concat(iso, F.lit("-"), code).alias("code"), F.col("n_name").alias("name"), iso.alias("country_code"),
        F.lit("State").alias("type"), F.col("n_nationkey").alias("seq"),
    )
    cities = (
        customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("population"))
        .join(owned, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_mktsegment").alias("name"), iso.alias("countrycode"), code.alias("admin1code"), "population",
                F.col("n_nationkey").alias("seq"))
    )
    return Gazetteer.of(countries, subdivisions, cities)


def location_texts(spark, sf):
    """Where the customer of each order is, in the spelling of the order's priority."""
    nation, region = V.table(spark, sf, "nation"), V.table(spark, sf, "region")
    o = (
        V.table(spark, sf, "orders")
        .join(V.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    code = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    join = lambda *parts: F.concat_ws(", ", *parts)
    as_object = F.to_json(F.struct(F.col("c_mktsegment").alias("normalizedCityName"),
                                   F.col("n_name").alias("normalizedStateName"), F.col("r_name").alias("countryIso2a")))
    priority = F.col("o_orderpriority")
    raw = (
        F.when((priority == "1-URGENT") & (F.col("o_orderstatus") == "P"), as_object)
        .when(priority == "1-URGENT", join("c_mktsegment", "n_name", "r_name"))
        .when(priority == "2-HIGH", join("r_name", "n_name", "c_mktsegment"))
        .when(priority == "3-MEDIUM", join("c_mktsegment", code))
        .when(priority == "4-NOT SPECIFIED", F.concat(F.lit("Remote - "), join("c_mktsegment", "r_name")))
        .when(F.col("o_orderstatus") == "F", F.lit("Remote"))
        .otherwise(F.col("n_name"))
    )
    return o.select("o_orderkey", raw.alias("raw"))


@query(
    "normalize_locations",
    """SELECT o_orderkey,
  CASE WHEN o_orderpriority <> '5-LOW' THEN c_mktsegment END AS city,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
   WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN NULL ELSE n_name END AS region,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN NULL ELSE r_name END AS country
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey""",
)
def normalize_location_texts(spark, sf):
    read = normalize_locations(location_texts(spark, sf), "raw", gazetteer(spark, sf))
    return read.select("o_orderkey", "city", "region", "country")


# --- Embeddings -------------------------------------------------------------------------------


@query(
    "hashed_embeddings",
    r"""WITH toks AS (
  SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents),
 hashed AS (SELECT id, CAST('0x' || substr(md5(t), 1, 7) AS BIGINT) AS h,
  CAST('0x' || substr(md5(t), 8, 1) AS BIGINT) % 2 AS s FROM toks),
 sums AS (SELECT id, h % 64 AS dim, sum(CASE s WHEN 0 THEN 1 ELSE -1 END) AS v FROM hashed GROUP BY ALL)
 SELECT id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM sums WHERE v <> 0""",
)
def hashed_embeddings(spark, sf):
    docs = V.texts(spark, sf)
    return E.hashed_embeddings(docs, 64).select("id", F.posexplode("embedding").alias("dim", "value")).where(
        F.col("value") != 0
    ).select("id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value"), 6).alias("value"))


@query("embed_with_model", "SELECT doc_id AS id, CAST(n_chars AS DOUBLE) AS chars, 2 AS dims FROM documents")
def embed_with_model(spark, sf):
    docs = V.texts(spark, sf)
    embedded = E.embed(docs, _length_model, "id")
    # A blank text has an empty vector: no characters to show, no dimensions.
    return embedded.select("id", F.get("embedding", F.lit(0)).alias("chars"), F.size("embedding").alias("dims"))


def _length_model():
    """A stand-in for a model: the length of the text and its number of lines."""
    return lambda texts: [[float(len(t)), float(t.count("\n") + 1)] for t in texts]
