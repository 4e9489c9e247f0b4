"""Search queries: index tables, BM25, vectors, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import epoch_seconds
from ..operators import search as S
from ..session import stored_once
from . import views as V
from .register import Registry

query = Registry()

QUERY = "Machine Learning Engineer the and nation"
SKILL_QUERY = "lang-fr"


def docs(spark, sf, embedding=True):
    return V.indexed_docs(spark, sf, embedding)


def index(spark, sf):
    """The stored index of a data set: written by the first request of a session, read by all of them."""
    return S.SearchIndex.read(
        spark, stored_once(spark, "index", sf, lambda path: S.SearchIndex.of(docs(spark, sf)).write(path))
    )


def vector(spark, sf):
    return S.query_embedding(V.table(spark, sf, "embeddings"), "vec_id", 0)


TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
DOCS_SQL = f"""{V.BASE_SQL},
docs AS (
 SELECT 'r2:' || company || ':' || external_job_id AS id, *, {TOKENS.format('title')} AS title_terms,
  {TOKENS.format('text')} AS text_terms, ['lang-' || lang, source] AS skills
 FROM postings WHERE NOT is_missing_details AND coalesce(quality, 1) <> 0 AND coalesce(p_size, 0) <> 50
),
field_terms AS (
 SELECT id, 'title' AS field, title_terms AS terms FROM docs
 UNION ALL SELECT id, 'job_description', text_terms FROM docs
 UNION ALL SELECT id, 'skills', skills FROM docs
),
field_stats AS (
 SELECT field, count(*) FILTER (WHERE len(terms) > 0) AS n_docs,
  sum(len(terms)) / count(*) FILTER (WHERE len(terms) > 0) AS avg_dl FROM field_terms GROUP BY field
),
term_rows AS (SELECT id, field, len(terms) AS dl, unnest(terms) AS term FROM field_terms),
post AS (SELECT field, term, id, dl, count(*) AS tf FROM term_rows GROUP BY ALL),
term_stats AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL)"""


def scores_sql(text):
    words = "', '".join(S.query_terms(text))
    return f"""
hits AS (
 SELECT p.id, p.field, sum(ln(1 + (f.n_docs - t.df + 0.5) / (t.df + 0.5)) * p.tf * 2.2
   / (p.tf + CASE WHEN p.field = 'skills' THEN 1.2 ELSE 1.2 * (0.25 + 0.75 * p.dl / f.avg_dl) END))
  * CASE p.field WHEN 'title' THEN 4 WHEN 'skills' THEN 3 ELSE 1 END AS score
 FROM post p JOIN term_stats t USING (field, term) JOIN field_stats f USING (field)
 WHERE (p.field <> 'skills' AND p.term IN ('{words}')) OR (p.field = 'skills' AND p.term = '{text}')
 GROUP BY p.id, p.field
),
text_scores AS (SELECT id, max(score) AS score FROM hits GROUP BY id)"""


VECTOR_SQL = """
vector_scores AS (
 SELECT d.id, d.posted_ts, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
 FROM docs d JOIN embeddings e ON e.vec_id = d.doc_id JOIN embeddings q ON q.vec_id = 0
)"""


@query(
    "search_docs",
    f"""WITH {DOCS_SQL}
 SELECT id, title, company, job_type, job_level, CAST(length(text) AS BIGINT) AS description_chars,
  skills[1] || ',' || skills[2] AS skills FROM docs""",
)
def search_docs(spark, sf):
    found = S.search_docs(V.jobs(spark, sf, embedding=True, places=False), V.details(spark, sf), V.descriptions(spark, sf))
    return found.select(
        "id", "title", "company", "job_type", "job_level",
        F.length("job_description").cast("bigint").alias("description_chars"),
        F.array_join("skills", ",").alias("skills"),
    )


@query("inverted_index", f"WITH {DOCS_SQL} SELECT field, term, id, CAST(dl AS BIGINT) AS dl, tf FROM post")
def inverted_index(spark, sf):
    return S.build_postings(docs(spark, sf, embedding=False)).select(
        "field", "term", "id", F.col("dl").cast("bigint").alias("dl"), "tf"
    )


@query(
    "index_statistics",
    f"""WITH {DOCS_SQL} SELECT t.field, t.term, t.df, f.n_docs, round(f.avg_dl, 6) AS avg_dl
 FROM term_stats t JOIN field_stats f USING (field)""",
)
def index_statistics(spark, sf):
    stored = index(spark, sf)
    return stored.term_stats.join(F.broadcast(stored.field_stats), "field").select(
        "field", "term", "df", "n_docs", F.round("avg_dl", 6).alias("avg_dl")
    )


@query(
    "text_match_score",
    f"WITH {DOCS_SQL}, {scores_sql(QUERY)} SELECT id, round(score, 6) AS score FROM text_scores",
)
def text_match_score(spark, sf):
    return S.text_scores(index(spark, sf), QUERY).select(
        "id", F.round("score", 6).alias("score")
    )


@query(
    "skill_keyword_match",
    f"WITH {DOCS_SQL}, {scores_sql(SKILL_QUERY)} SELECT id, round(score, 6) AS score FROM text_scores",
)
def skill_keyword_match(spark, sf):
    return S.text_scores(index(spark, sf), SKILL_QUERY).select(
        "id", F.round("score", 6).alias("score")
    )


@query(
    "topk_bm25",
    f"""WITH {DOCS_SQL}, {scores_sql(QUERY)}
 SELECT s.id, round(s.score, 6) AS score FROM text_scores s JOIN docs d USING (id)
 WHERE d.company = 'google' ORDER BY s.score DESC, s.id LIMIT 100""",
)
def topk_bm25(spark, sf):
    return S.text_top(index(spark, sf), QUERY, company="google").select("id", F.round("score", 6).alias("score"))


@query(
    "stored_index_search",
    f"""WITH {DOCS_SQL}, {scores_sql(QUERY)}
 SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM text_scores
 ORDER BY score DESC, id LIMIT 100""",
)
def stored_index_search(spark, sf):
    return S.text_top(index(spark, sf), QUERY).select(
        "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "knn",
    f"""WITH {DOCS_SQL}, {VECTOR_SQL}
 SELECT v.id, round(v.score, 6) AS score, row_number() OVER (ORDER BY v.score DESC, v.id) AS rank
 FROM vector_scores v JOIN docs d USING (id) WHERE d.job_type = 'software_engineer'
 ORDER BY v.score DESC, v.id LIMIT 100""",
)
def knn(spark, sf):
    return S.vector_top(index(spark, sf).docs, vector(spark, sf), job_type="software_engineer").select(
        "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "knn_batch",
    """WITH centers AS (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, generate_series(1, 64) s(i) GROUP BY ALL),
 queries AS (SELECT label AS query_id, list(x ORDER BY i) AS embedding FROM centers GROUP BY label),
 scored AS (
  SELECT q.query_id, e.vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.embedding) AS score
  FROM embeddings e, queries q)
 SELECT query_id, id, round(score, 6) AS score, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 10""",
)
def knn_batch(spark, sf):
    vectors = V.table(spark, sf, "embeddings")
    centers = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("x"))
    # One row per label and dimension: 64 values make a query vector.
    queries = centers.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select(
        F.col("label").alias("query_id"), F.transform("v", lambda s: s["x"]).alias("embedding"))
    found = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("job_description_embedding"))
    return S.vector_top_batch(found, queries, 10).select(
        "query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


FUSED_SQL = f"""WITH {DOCS_SQL}, {scores_sql(QUERY)}, {VECTOR_SQL},
ranked AS (
 SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM text_scores
 QUALIFY rank <= 100
 UNION ALL
 SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vector_scores QUALIFY rank <= 100
),
fused AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM ranked GROUP BY id)"""


@query(
    "rrf_fuse",
    f"{FUSED_SQL} SELECT id, round(score, 6) AS score FROM fused",
)
def rrf_fuse(spark, sf):
    stored = index(spark, sf)
    return S.rrf_fuse([S.text_top(stored, QUERY), S.vector_top(stored.docs, vector(spark, sf))]).select(
        "id", F.round("score", 6).alias("score")
    )


@query(
    "search_relevance",
    f"""{FUSED_SQL}
 SELECT id, title, company, round(score, 6) AS score, CAST(epoch(posted_ts) AS BIGINT) AS posted_ts
 FROM fused JOIN docs USING (id)
 ORDER BY fused.score DESC, posted_ts DESC NULLS LAST, id LIMIT 25""",
)
def search_relevance(spark, sf):
    return S.search_relevance(index(spark, sf), QUERY, vector(spark, sf)).select(
        "id", "title", "company", F.round("score", 6).alias("score"),
        epoch_seconds(F.col("posted_ts")).alias("posted_ts"),
    )


@query("fused_total", f"{FUSED_SQL} SELECT count(*) AS total_results FROM fused")
def fused_total(spark, sf):
    return S.fused_total(index(spark, sf), QUERY, vector(spark, sf))


@query(
    "search_recency",
    f"""WITH {DOCS_SQL}, {scores_sql(QUERY)}
 SELECT id, title, CAST(epoch(posted_ts) AS BIGINT) AS posted_ts FROM docs
 WHERE id IN (SELECT id FROM text_scores) AND job_level = 'senior'
 ORDER BY docs.posted_ts DESC NULLS LAST, external_job_id LIMIT 25""",
)
def search_recency(spark, sf):
    return S.search_recency(index(spark, sf), QUERY, job_level="senior").select(
        "id", "title", epoch_seconds(F.col("posted_ts")).alias("posted_ts")
    )
