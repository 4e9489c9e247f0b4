"""Texts of 100,000 characters of one kind must not overflow a pattern's stack or take quadratic time."""

import time

import pytest
from pyspark.sql import functions as F

from postmill.functions import html as H
from postmill.functions import text as T
from postmill.operators import pay as P
from postmill.operators import skills as K
from postmill.sources import payloads as S

N = 100_000
LONG = {
    "marks": "a." * (N // 2), "letters": "a" * N, "plus": "+" * N, "blanks": " " * N, "lines": "\n" * N,
    "items": "- x\n" + "\n" * N, "dashes": "- " * (N // 2), "tags": "<" * N, "open": "<svg>" * (N // 50), "comments": "<!--" * (N // 50),
    "digits": "1" * N, "commas": "1," * (N // 2), "entities": "&" * N, "slashes": "\\" * N,
}


@pytest.mark.parametrize("kind", sorted(LONG))
def test_patterns(spark, kind):
    # Replaced on the JVM's side: a test row is made of one short literal.
    frame = spark.createDataFrame([(LONG[kind],)], "x string")
    x = F.col("x")
    began = time.time()
    frame.select(
        F.size(K.phrase_tokens(x)), F.length(H.plain_description(x)), F.length(H.drop_elements(x)),
        F.length(H.html_to_text(x, decode=H.unescape)), F.size(H.json_ld_scripts(x)), F.size(P.pay_ranges(x)), F.size(T.tokens(x)),
        F.length(S.hydration_json(x)), F.length(S.without_loop_prefix(x)),
    ).collect()
    assert time.time() - began < 120


def test_many_ranges_in_one_text(spark):
    text = "".join(f"Base salary is ${100000 + i:,} - ${120000 + i:,} per year.\n" for i in range(10_000))
    frame = spark.createDataFrame([(text,)], "text string")
    began = time.time()
    assert frame.select(F.size(P.pay_ranges(F.col("text")))).first()[0] == 10_000
    assert time.time() - began < 60


def test_marks_of_the_input_do_not_shift_contexts(spark):
    frame = spark.createDataFrame([("Base\u0001 salary is $100,000 - $120,000 per year.",)], "text string")
    found = frame.select(P.pay_ranges(F.col("text")).alias("r")).first()["r"]
    assert [r["context"] for r in found] == ["Base salary is $100,000 - $120,000 per year."]


def test_white_space_between_words_is_not_searched_from_each_of_its_characters(rows):
    began = time.time()
    assert rows("x string", [("a" + " " * 300_000 + "b",)], F.length(T.strip(F.col("x")))) == [300_002]
    assert rows("x string", [("a" + "\t " * 150_000 + "b",)], T.collapse_space(F.col("x"))) == ["a b"]
    assert time.time() - began < 10


def test_strip_and_collapse_are_the_plain_patterns(rows):
    marks = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    data = [(f"{m}a{m}b {m}c  d{m}",) for m in marks] + [("",), (None,), (" \u3000\n",), ("a\n",), ("\r\na\u2028",)]
    plain = F.regexp_replace(F.col("x"), r"(?U)^\s+|\s+$", "")
    assert rows("x string", data, T.strip(F.col("x"))) == rows("x string", data, plain)
    joined = F.regexp_replace(F.regexp_replace(F.col("x"), r"(?U)\s+", " "), r"(?U)^\s+|\s+$", "")
    assert rows("x string", data, T.collapse_space(F.col("x"))) == rows("x string", data, joined)
