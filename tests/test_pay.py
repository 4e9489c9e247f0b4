from pyspark.sql import functions as F

from postmill.operators.pay import extract_pay, merge_pay
from postmill.sources.descriptions import compensation_line, public_compensation


def _pay(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [
        (None if r["pay_ranges"] is None else [tuple(x) for x in r["pay_ranges"]], r["pay_notes"])
        for r in extract_pay(frame).orderBy("i").collect()
    ]


def test_ranges_and_notes(spark):
    got = _pay(spark, [
        "<p>Base salary range is $120,000 - $150,000 per year.</p><p>Bonus and benefits may apply.</p>",
        "Base salary range is $120,000 - $150,000. Base salary range is $120,000 - $150,000. "
        "Compensation includes bonus. Compensation includes bonus.",
        "Range 120000 - 130000 in text",
        "No compensation info.",
        None,
        "<p><br/></p>",
        "Pays CA 90,000 to 95,000 here! EUR 50000–60000 hourly",
        "$500 - $900, 100 - 200",
    ])
    assert got[0] == (
        [(120000, 150000, "USD", "year", "Base salary range is $120,000 - $150,000 per year.")],
        ["Bonus and benefits may apply."])
    assert len(got[1][0]) == 1 and got[1][0][0][3] == "year"
    assert got[1][1] == ["Compensation includes bonus."]
    assert [g for g in got[2:6]] == [(None, None)] * 4
    assert [r[:4] for r in got[6][0]] == [(90000, 95000, "CAD", "hour"), (50000, 60000, "EUR", "hour")]
    assert got[7] == (None, None)


def test_against_a_plain_scan(spark):
    """Positions and contexts of many ranges in one text, next to a direct scan with Python's re."""
    import re

    text = "\n".join(f"Salary {i},000 - {i + 5},000 a. Next $ {i}0000 to ${i}5000 per month! é {i}" for i in range(10, 60))
    got = _pay(spark, [text])[0][0]
    amounts = re.findall(r"(\d{1,3}(?:,\d{3})+|\d{4,})\s*(?:-|–|to)\s*\$?(\d{1,3}(?:,\d{3})+|\d{4,})", text)
    assert [(r[0], r[1]) for r in got] == [(int(a.replace(",", "")), int(b.replace(",", ""))) for a, b in amounts]
    assert got[0][4] == "Salary 10,000 - 15,000 a."
    assert got[1][4] == "Next $ 100000 to $105000 per month!"


def test_public_compensation(rows):
    items = ('[{"compensation_amount_minimum":"$100,000/year","compensation_amount_maximum":"$150,000/year",'
             '"has_bonus":true,"has_equity":true}]')
    found = rows("x string", [(items,), ("[]",), (None,)], public_compensation(F.col("x")))
    assert tuple(found[0]["ranges"][0]) == (100000, 150000, "USD", "year", "public_compensation")
    assert found[0]["notes"] == ["Bonus eligible", "Equity eligible"]
    assert found[1:] == [None, None]
    assert rows("x string", [(items,)], compensation_line(F.col("x"))) == [
        "$100,000/year to $150,000/year + bonus + equity + benefits"]


def test_merge(spark):
    kind = ("struct<ranges:array<struct<min_amount:long,max_amount:long,currency:string,interval:string,context:string>>,"
            "notes:array<string>>")
    one, two = (1, 2, "USD", "year", "a"), (3, 4, "USD", "year", "b")
    data = [(([one], ["a"]), ([one, two], ["a", "b"])), (None, ([two], [])), (([one], []), None)]
    frame = spark.createDataFrame(data, f"a {kind}, b {kind}")
    got = frame.select(merge_pay(F.col("a"), F.col("b")).alias("m")).collect()
    assert [(len(r["m"]["ranges"]), r["m"]["notes"]) for r in got] == [(2, ["a", "b"]), (1, []), (1, [])]
