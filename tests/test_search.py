import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postmill.operators import browse as B
from postmill.operators import filters as FL
from postmill.operators import search as S
from postmill.operators.ranking import rrf_fuse

DOCS = ("id string, run_id string, company string, external_job_id string, title string, job_type string, "
        "job_level string, details_url string, apply_url string, "
        "locations array<struct<city:string,region:string,country:string>>, skills array<string>, posted_ts timestamp, "
        "job_description string, job_description_embedding array<float>")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    words = ["spark", "sql", "the", "data", "cat", "dog", "tree", "blue"]
    rows = []
    for i in range(120):
        # One company and one word hold most of the rows.
        company = "amazon" if rng.random() < 0.5 else rng.choice(["google", "meta"])
        text = " ".join(rng.choices(words, weights=[1, 1, 20, 2, 1, 1, 1, 1], k=rng.randint(1, 60)))
        vector = [] if i % 9 == 0 else [rng.gauss(0, 1) for _ in range(8)]
        posted = None if i % 7 == 0 else datetime(2026, 1, 1 + i % 28)
        rows.append((f"r:{company}:{i}", "r", company, str(i), f"{rng.choice(words)} engineer", "software_engineer",
                     rng.choice(["mid", "senior"]), None, "", [("Seattle", "Washington", "United States"),
                                                             ("Berlin", "Berlin", "Germany")][: rng.randint(0, 2)],
                     rng.sample(["spark", "Data SQL"], rng.randint(0, 2)), posted, text, vector))
    return spark.createDataFrame(rows, DOCS)


def _bm25(rows, query):
    """A direct computation over plain lists."""
    import regex

    split = lambda s: regex.findall(r"[\p{L}\p{N}]+", (s or "").lower())
    fields = {
        "title": (4, {r["id"]: split(r["title"]) for r in rows}, split(query)),
        "job_description": (1, {r["id"]: split(r["job_description"]) for r in rows}, split(query)),
        "skills": (3, {r["id"]: sorted(set(r["skills"])) for r in rows}, [query.strip()]),
    }
    best = {}
    for name, (boost, terms, wanted) in fields.items():
        n = sum(1 for t in terms.values() if t)
        avg = sum(len(t) for t in terms.values()) / n
        for doc, t in terms.items():
            score = 0.0
            for w in wanted:
                tf = t.count(w)
                if tf:
                    df = sum(1 for x in terms.values() if w in x)
                    norm = 1.2 if name == "skills" else 1.2 * (0.25 + 0.75 * len(t) / avg)
                    score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + norm)
            if score:
                best[doc] = max(best.get(doc, 0), boost * score)
    return best


@pytest.mark.parametrize("query", ["spark the the", "Data SQL", "nothing here", "blue"])
def test_bm25_against_a_plain_computation(spark, docs, query, tmp_path):
    wanted = _bm25(docs.collect(), query)
    index = S.SearchIndex.of(docs)
    index.write(str(tmp_path / "index"))
    for one in (index, S.SearchIndex.read(spark, str(tmp_path / "index"))):
        got = {r["id"]: r["score"] for r in S.text_scores(one, query).collect()}
        assert got.keys() == wanted.keys()
        assert all(abs(got[k] - wanted[k]) < 1e-9 for k in got)
        assert {r["id"] for r in S.text_matches(one, query).collect()} == wanted.keys()


def test_knn_single_and_batch(spark, docs):
    query = [0.5, -1.0, 0.25, 0.0, 2.0, 1.0, -0.5, 0.75]
    rows = [r for r in docs.collect() if r["job_description_embedding"]]

    def similarity(v, q):
        return sum(a * b for a, b in zip(v, q)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in q))

    def wanted(q, keep, k):
        order = sorted((-similarity(r["job_description_embedding"], q), r["id"]) for r in rows if keep(r))
        return [i for _, i in order[:k]]

    got = S.vector_top(docs, query, 10, company="google").orderBy("rank").collect()
    assert [r["id"] for r in got] == wanted(query, lambda r: r["company"] == "google", 10)
    assert S.vector_top(docs, []).count() == 0
    queries = spark.createDataFrame([(i, [float((i * j) % 5 - 2) for j in range(1, 9)]) for i in range(1, 6)],
                                    "query_id int, embedding array<double>")
    for chunk in (2, 512):
        batch = S.vector_top_batch(docs.repartition(5), queries, 7, chunk).collect()
        for q in queries.collect():
            mine = sorted((r["rank"], r["id"]) for r in batch if r["query_id"] == q["query_id"])
            assert [i for _, i in mine] == wanted(q["embedding"], lambda r: True, 7)


HITS = "id string, rank int, posted_ts timestamp"


def _fused(spark, *lists):
    frames = [spark.createDataFrame([(i, n, day and datetime(2026, 1, day)) for n, (i, day) in enumerate(one, 1)], HITS)
              for one in lists]
    return [r["id"] for r in rrf_fuse(frames).collect()]


def test_rrf(spark):
    assert _fused(spark, [("a", 1), ("", 1)], [("b", 1), ("a", 1)]) == ["a", "b"]
    assert _fused(spark, [("old", 1), ("new", 2)], [("new", 2), ("old", 1)]) == ["new", "old"]
    assert _fused(spark, [("x", None), ("b", 1)], [("b", 1), ("x", None)]) == ["b", "x"]
    assert _fused(spark, [("b", 1), ("a", 1)], [("a", 1), ("b", 1)]) == ["a", "b"]


def test_search_pages(spark, docs):
    index = S.SearchIndex.of(docs)
    query = [1.0] * 8
    total = S.fused_total(index, "spark", query).first()["total_results"]
    seen = []
    for page in range(1, total // 25 + 2):
        seen += [r["id"] for r in S.search_relevance(index, "spark", query, page=page).collect()]
    assert len(seen) == len(set(seen)) == total
    recent = S.search_recency(index, "spark", company="amazon").collect()
    days = [r["posted_ts"] for r in recent]
    dated = [d for d in days if d is not None]
    assert dated == sorted(dated, reverse=True) and days[: len(dated)] == dated
    assert all(r["company"] == "amazon" for r in recent)


def test_browse_snapshot(spark):
    rows = [
        ("new_1", datetime(2026, 1, 4), False), ("new_2", datetime(2026, 1, 3), False),
        ("new_missing", datetime(2026, 1, 5), True), ("new_null", None, False),
    ]
    jobs = spark.createDataFrame(rows, "external_job_id string, posted_ts timestamp, is_missing_details boolean")
    shown = jobs.where(~F.col("is_missing_details"))
    pages = [[r[0] for r in B.browse(shown, page=n, size=2).collect()] for n in (1, 2)]
    assert pages == [["new_1", "new_2"], ["new_null"]]
    info = [tuple(B.page_info(shown, page=n, size=2).first()) for n in (1, 2)]
    assert info == [(3, 2, True), (3, 2, False)]
    assert tuple(B.page_info(shown.limit(0)).first()) == (0, 1, False)


def test_facets(spark):
    rows = [("1", [("Berlin", "Berlin", "Germany"), (" ", "", None)]), ("2", [("Los Angeles", "California", "United States")]),
            ("3", [("Seattle", "Washington", "United States")]), ("4", [("Tacoma", "Washington", "United States")]), ("5", [])]
    docs = spark.createDataFrame(rows, "id string, locations array<struct<city:string,region:string,country:string>>")

    def facets(**scope):
        found = B.location_facets(docs, **scope).collect()
        return [[r["value"] for r in found if r["facet"] == f] for f in ("country", "region", "city")]

    countries = ["Germany", "United States"]
    assert facets() == [countries, ["Berlin", "California", "Washington"], ["Berlin", "Los Angeles", "Seattle", "Tacoma"]]
    assert facets(country="United States") == [countries, ["California", "Washington"], ["Los Angeles", "Seattle", "Tacoma"]]
    assert facets(country="United States", region="Washington") == [
        countries, ["California", "Washington"], ["Seattle", "Tacoma"]]


def test_location_filter_needs_one_element(spark):
    rows = [("1", [("Berlin", "Berlin", "Germany"), ("Seattle", "Washington", "United States")])]
    docs = spark.createDataFrame(rows, "id string, locations array<struct<city:string,region:string,country:string>>")
    assert FL.apply_filters(docs, country="Germany", city="Berlin").count() == 1
    assert FL.apply_filters(docs, country="Germany", city="Seattle").count() == 0


def test_details_lookup(spark):
    jobs = spark.createDataFrame(
        [("r", "a", "ok", "T", None, False), ("r", "a", "gone", "T", None, True), ("r", "a", "blank", "T", None, False)],
        "run_id string, company string, external_job_id string, title string, posted_ts timestamp, "
        "is_missing_details boolean")
    details = spark.createDataFrame([("r", "a", "ok", " p "), ("r", "a", "gone", "q"), ("r", "a", "blank", " ")],
                                    "run_id string, company string, external_job_id string, job_description_path string")
    texts = spark.createDataFrame([("p", ""), ("q", "x")], "job_description_path string, description string")
    asked = spark.createDataFrame([("r", "a", i) for i in ("ok", "gone", "blank", "none")],
                                  "run_id string, company string, external_job_id string")
    got = {r["external_job_id"]: (r["found"], r["description"]) for r in
           B.job_details_lookup(asked, jobs, details, texts).collect()}
    assert got == {"ok": (True, ""), "gone": (False, None), "blank": (True, None), "none": (False, None)}


def test_companies_are_checked(spark):
    known = spark.createDataFrame([("r", "amazon", "Amazon")], "run_id string, company string, display_name string")
    good = spark.createDataFrame([("amazon",), (None,)], "company string")
    assert B.require_known_companies(good, known).count() == 2
    bad = spark.createDataFrame([("google",)], "company string")
    with pytest.raises(Exception, match="unsupported company google"):
        B.require_known_companies(bad, known).collect()
    assert B.list_companies(known, "other").count() == 0


def test_total_pages(rows):
    kind = "t long, s long, n boolean"
    call = lambda cap: B.total_pages(F.col("t"), F.col("s"), F.col("n"), cap)
    assert rows(kind, [(101, 10, False), (None, 10, False), (0, 10, False)], call(None)) == [11, 1, 1]
    assert rows(kind, [(101, 10, False), (None, None, True)], call(3)) == [3, 3]
    with pytest.raises(Exception, match="page cap"):
        rows(kind, [(None, None, True)], call(None))


def test_blank_ids_fail(spark):
    bad = spark.createDataFrame([(" ",)], "external_job_id string")
    with pytest.raises(Exception, match="without an id"):
        FL.require_ids(bad).collect()
