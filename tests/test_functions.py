from pyspark.sql import functions as F

from postmill.functions import dates as D
from postmill.functions import html as H
from postmill.functions import money as M
from postmill.functions import requests as R
from postmill.functions import text as T
from postmill.streaming.heartbeat import reason_of


def test_strip_and_optional(rows):
    cases = [("  a \t\n",), ("   ",), (None,), ("b c",)]
    assert rows("x string", cases, T.optional_string(F.col("x"))) == ["a", None, None, "b c"]


def test_to_int(rows):
    cases = [("12",), (" -3 ",), ("1.5",), ("x",), ("",), (None,)]
    assert rows("x string", cases, T.to_int(F.col("x"))) == [12, -3, None, None, None, None]


def test_clean_locations(rows):
    cases = [([None, (" ", "", None), (" Berlin ", "", "Germany")],), (None,)]
    got = rows("x array<struct<city:string,region:string,country:string>>", cases, T.clean_locations(F.col("x")))
    assert [[tuple(e) for e in one] for one in got] == [[("Berlin", None, "Germany")], []]


def test_slug_and_quote(rows):
    assert rows("x string", [("Senior  Engineer, ML!",), ("??",)], T.slug(F.col("x"))) == ["senior-engineer-ml", "job"]
    assert rows("x string", [("a b/c+d~é",)], T.quote(F.col("x"))) == ["a%20b/c%2Bd~%C3%A9"]


def test_split_location(rows):
    cases = [("Canada",), ("Menlo Park, CA",), ("London, UK",), ("Paris, France",), ("Austin, TX, US",), ("Pune, MH",)]
    got = [tuple(r) for r in rows("x string", cases, T.split_location(F.col("x")))]
    assert got == [("", "", "Canada"), ("Menlo Park", "CA", ""), ("London", "", "UK"), ("Paris", "", "France"),
                   ("Austin", "TX", "US"), ("Pune", "MH", "")]


def test_status_ok(rows):
    cases = [(None,), ("200",), ("299",), ("300",), ("x",)]
    assert rows("x string", cases, T.status_ok(F.col("x"))) == [True, True, True, False, False]


def test_posting_dates(rows):
    cases = [("1735689600",), ("1735689600000",), ("2026-01-01T00:00:00Z",), ("bad",), ("",), (None,)]
    assert rows("x string", cases, D.search_epoch(F.col("x"))) == [1735689600, 1735689600, 1767225600, None, None, None]


def test_payload_dates(rows):
    cases = [("1700000000",), ("1700000000000",), ('{"timestamp": 1772323200}',), ("2026-03-01T00:00:00+00:00",),
             ("Mar 1, 2026",), ("March 1, 2026",), ("2026-03-01",), ("bad-date",)]
    assert rows("x string", cases, D.any_epoch(F.col("x"))) == [1700000000] * 2 + [1772323200] * 5 + [None]


def test_request_fields(rows):
    assert rows("x string", [(None,), ("__all__",), (" Amazon ",)], R.company_filter(F.col("x"))) == [None, None, "amazon"]
    assert rows("x string", [(" 7d ",), ("bad",)], R.window_filter(F.col("x"))) == ["7d", None]
    assert rows("x string", [(" senior ",), ("boss",)], R.job_level_filter(F.col("x"))) == ["senior", None]
    assert rows("x string", [("bad",), ("manager",)], R.job_type_filter(F.col("x"))) == [None, "manager"]
    assert rows("x string", [(" Seattle ",), (" ",)], R.location_filter(F.col("x"))) == ["Seattle", None]
    assert rows("x string", [("recency",), ("x",), (None,)], R.search_mode(F.col("x"))) == [
        "recency", "relevance", "relevance"]


def test_reason_codes(rows):
    got = rows("x int", [(1,), (0,), (-1,), (-2,), (-3,), (-4,), (123,)], reason_of(F.col("x")))
    assert got == ["enqueued", "capacity", "blocked", "inuse", "duplicate", "invalid_capacity", "unknown"]


def test_money(rows):
    got = rows("x string", [("us",), ("usd",), ("ca",), ("toolong",)], M.code_currency(F.col("x")))
    assert got == ["USD", "USD", "CAD", None]
    phrases = [("pay is hourly",), ("base salary range",), ("something per annum",), ("none",), ("$5 / month",)]
    assert rows("x string", phrases, M.interval_word(F.col("x"))) == ["hour", "year", "year", None, "month"]


def test_unescape_matches_the_standard_library(rows):
    import html

    texts = ["a &amp; b", "&amp;lt;", "&lt;p&gt;", "&eacute;&#233;&#xe9;", "&copy 2020", "plain", "&nbsp;x", "&unknown;", None]
    got = rows("x string", [(t,) for t in texts], H.unescape_all(F.col("x")))
    assert got == [None if t is None else html.unescape(t) for t in texts]


def test_html_to_text(rows):
    page = ("<html><head><title>T</title><script>var a='</p>';</script></head><body><nav>menu</nav><!-- c -->"
            "<article><h1>Role</h1><p>One <b>bold</b> line.<br>Two</p><table><tr><td>a</td><td>b</td></tr></table>"
            "</article><footer>foot</footer></body></html>")
    got = rows("x string", [(page,), ("   ",), (None,), ("<p></p>",)], H.html_to_text(F.col("x"), full_document=True))
    assert got == ["Role\nOne bold line.\nTwo\na | b |", None, None, None]


def test_json_ld(rows):
    script = '<script type="application/ld+json">%s</script>'
    pages = [
        script % "{bad" + script % '{"@graph":[{"@type":"Thing"},{"@type":"jobposting","title":"A"}]}',
        script % '{"x":{"y":[{"@type":"JobPosting","title":"B","datePosted":"2026-03-01"}]}}',
        "<p>none</p>",
        script % "{bad" + 'data "datePosted" : "2026-03-01"',
    ]
    title = F.get_json_object(H.job_posting(F.col("x")), "$.title")
    assert rows("x string", [(p,) for p in pages], title) == ["A", "B", None, None]
    shallow = F.get_json_object(H.job_posting(F.col("x"), deep=False), "$.title")
    assert rows("x string", [(p,) for p in pages], shallow) == ["A", None, None, None]
    assert rows("x string", [(p,) for p in pages], H.date_posted(F.col("x"))) == [None, 1772323200, None, 1772323200]


def test_page_description(rows):
    ld = '<script type="application/ld+json">{"@type":"JobPosting","title":"Role","description":"<p>Hello</p>"}</script>'
    pages = [ld, '<meta name="description" content="Meta desc">', "<html><body><p>Visible text</p></body></html>", ""]
    got = rows("x string", [(p,) for p in pages], H.page_description(F.col("x")))
    assert got == ["Role\n\nHello", "Meta desc", "Visible text", None]


def test_plain_description(rows):
    text = "Intro\n\n\n* one\n\n* two\n\nEnd"
    assert rows("x string", [(text,)], H.plain_description(F.col("x"))) == ["Intro\n\none\ntwo\nEnd"]
