import json

import pytest

from postmill.sources import descriptions as D
from postmill.sources import payloads as S


def _parse(spark, parse, payload, page=1):
    frame = spark.createDataFrame([(page, payload)], "page long, payload string")
    return [r.asDict() for r in parse(frame).collect()]


def _describe(spark, name, payload):
    frame = spark.createDataFrame([(1, payload)], "page long, payload string")
    return D.DESCRIBE[name](frame).first()["description"]


def test_amazon(spark):
    job = {"id_icims": "7", "title": " Software Engineer II ", "job_path": "https://www.amazon.jobs/en/jobs/7/x?y=1",
           "url_next_step": "/applicant/jobs/7/apply", "posted_date": "January 01, 2024",
           "locations": ["{bad", "[1]", '{"normalizedLocation": "Seattle, WA, USA"}']}
    row = _parse(spark, S.parse_amazon, json.dumps({"hits": 1, "jobs": [job]}))[0]
    assert row["external_job_id"] == "7" and row["title"] == "Software Engineer II" and row["job_level"] == "mid"
    assert row["raw_locations"] == ["Seattle, WA, USA"] and row["posted_epoch"] == 1704067200
    assert row["details_url"] == "https://www.amazon.jobs/en/jobs/7/x?y=1"
    assert row["apply_url"] == "https://www.amazon.jobs/applicant/jobs/7/apply"
    with pytest.raises(Exception, match="without an id"):
        _parse(spark, S.parse_amazon, json.dumps({"jobs": [{"title": "x"}]}))
    with pytest.raises(Exception, match="no list of postings"):
        _parse(spark, S.parse_amazon, json.dumps({"hits": 0}))


def test_amazon_page(spark):
    page = ("<h1 class='title'>Role</h1><div id='job-detail-body'><div class='content'><div class='section'><h2>Only Heading</h2>"
            "</div><div class='section'><h2>Heading</h2><p>Body</p></div></div></div>")
    frame = spark.createDataFrame([(page,), ("<p>none</p>",)], "payload string")
    got = [r["description"] for r in D.amazon_page_description(frame).collect()]
    assert got == ["Role\n\nOnly Heading\n\nHeading\nBody", None]


def test_apple(spark):
    jobs = [{"positionId": "p1", "postingTitle": "Data \"Sci\"entist", "postDateInGMT": "2026-01-01T00:00:00Z",
             "locations": [{"city": "Cupertino", "stateProvince": "CA", "countryName": "USA"}, {"name": "United States"}]},
            {"reqId": "p2", "postingTitle": "Designer", "postingDate": "Mar  1, 2026", "transformedPostingTitle": "a-b"}]
    data = json.dumps({"loaderData": {"search": {"totalRecords": 2, "searchResults": jobs}}})
    page = f"<script>window.__staticRouterHydrationData = JSON.parse({json.dumps(data)});</script>"
    one, two = _parse(spark, S.parse_apple, page)
    assert one["raw_locations"] == ["Cupertino, CA, USA", "United States"] and one["posted_epoch"] == 1767225600
    assert one["details_url"] == "https://jobs.apple.com/en-us/details/p1/data-sci-entist"
    assert two["external_job_id"] == "p2" and two["posted_epoch"] == 1772323200
    assert two["details_url"].endswith("/p2/a-b") and two["apply_url"] == "https://jobs.apple.com/app/en-us/apply/p2"
    text = _describe(spark, "apple", json.dumps({"postingTitle": "T", "jobSummary": "<p>S</p>", "eeoContent": "E"}))
    assert text == "T\n\nSummary\nS\n\nE"


def test_google(spark):
    row = ["9", "Staff Software Engineer", "https://apply", None, None, None, None, None, None, ["NYC", ["London, UK", 1]], None, None,
           [1700000000, 0], None]
    page = "AF_initDataCallback({key: 'ds:1', hash: '3', data:%s, sideChannel: {}});" % json.dumps([[row], None, 1, 20])
    got = _parse(spark, S.parse_google, page, page=2)[0]
    assert got["raw_locations"] == ["NYC", "London, UK"] and got["posted_epoch"] == 1700000000
    assert got["details_url"].endswith("/jobs/results/9-staff-software-engineer?page=2") and got["job_level"] == "staff"
    with pytest.raises(Exception, match="no embedded data"):
        _parse(spark, S.parse_google, "<p></p>")
    detail = ["9", "T", None, [None, "<ul><li>- do</li></ul>"], [None, "<p>Minimum qualifications:</p><p>a</p><p>Preferred qualifications:</p><p>b</p>"],
              None, None, None, None, None, [None, "<p>about</p>"]]
    page = "AF_initDataCallback({key: 'ds:0', hash: '3', data:%s, sideChannel: {}});" % json.dumps([detail])
    frame = spark.createDataFrame([(1, page)], "page long, payload string")
    text = D.google_description(frame).first()["description"]
    assert text == ("T\n\nAbout the job\nabout\n\nMinimum Qualifications\na\n\nPreferred Qualifications\nb\n\n"
                    "Responsibilities\ndo")


def test_microsoft(spark):
    job = {"id": 5, "name": "IC3 Engineer", "postedTs": 1700000000, "positionUrl": "http://x.com/5", "standardizedLocations": [" A ", ""]}
    got = _parse(spark, S.parse_microsoft, json.dumps({"data": {"count": 1, "positions": [job]}}))[0]
    assert got["external_job_id"] == "5" and got["details_url"] == "https://x.com/5" and got["raw_locations"] == ["A"]
    with pytest.raises(Exception, match="postedTs"):
        _parse(spark, S.parse_microsoft, json.dumps({"data": {"positions": [{**job, "postedTs": "soon"}]}}))
    text = _describe(spark, "microsoft", json.dumps({"name": "T", "jobDescription": "<b>Overview</b><div><p>One</p></div>tail"}))
    assert text == "T\n\nOverview\nOne\ntail"
    assert _describe(spark, "microsoft", json.dumps({"name": "T", "responsibilities": "<p>r</p>"})) == "T\n\nResponsibilities\nr"


def test_meta(spark):
    payload = "for (;;);" + json.dumps({"data": {"job_search_with_featured_jobs": {"all_jobs": [
        {"id": "a b", "title": "Research Scientist", "locations": ["Remote", " "]}]}}})
    got = _parse(spark, S.parse_meta, payload)[0]
    assert got["details_url"] == "https://www.metacareers.com/jobs/a%20b/" and got["raw_locations"] == ["Remote"]
    assert got["posted_epoch"] is None and got["job_type"] == "data_scientist"
    text = _describe(spark, "meta", json.dumps({
        "title": "T", "description": json.dumps({"__html": "<p>d</p>"}), "responsibilities": [{"item": "a &amp; b"}, "c", " c "],
        "public_compensation": [{"compensation_amount_minimum": "$1", "has_bonus": True}]}))
    assert text.startswith("T\n\nDescription\nd\n\nResponsibilities\na & b\nc\n\nAbout Meta\n$1 + bonus + benefits\n\n")


def test_netflix(spark):
    payload = json.dumps({"count": 2, "positions": [
        {"id": 1, "posting_name": "Engineer L4", "t_create": 0, "t_update": 1700000000, "locations": ["A"]},
        {"id": "2", "name": "Engineer", "location": "B", "canonicalPositionUrl": "https://c"}]})
    one, two = _parse(spark, S.parse_netflix, payload)
    assert one["posted_epoch"] == 1700000000 and one["apply_url"].endswith("/careers/job/1#apply")
    assert two["raw_locations"] == ["B"] and two["apply_url"] == "https://c#apply"
    describe = lambda text: _describe(spark, "netflix", json.dumps({"name": "Role", "job_description": text}))
    assert describe(["<p>Hello</p>", " ", "* x"]) == "Role\n\nHello\n\nx"
    assert describe("<p>Hello</p>") == "Role\n\nHello"
    assert describe("Role text") == "Role text"
    assert _describe(spark, "netflix", json.dumps({"name": "Role"})) is None
