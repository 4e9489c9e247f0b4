"""Pay ranges and notes in posting texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import unescape_all
from ..functions.money import code_currency, interval_word, lookup
from ..functions.text import bind, collapse_space, strip
from ..schemas import PAY_RANGE

# --- Fixed values -----------------------------------------------------------------------------
# Possessive, and with starts only where an earlier start in the same run of blanks or digits has not failed already, so
# long runs take linear time; what matches is the same.
_SIDE = r"(\b[A-Z]{2,3}\b)?\s*+([$€£¥])?\s*+"
AMOUNT = r"(?:(?<!\d)|(?!\d{4}))(\d{1,3}+(?:,\d{3})++|\d{4,}+)"
RANGE = rf"(?iuU)(?:(?<!\s)|(?=\S)){_SIDE}{AMOUNT}\s*+(?:-|–|to)\s*+{_SIDE}{AMOUNT}"
# All of a text with a range, for its groups at once.
WHOLE = rf"(?s)\A.*?(?:{RANGE}).*\z"
# What every range has between its amounts; it begins with a digit, so a text without one costs a look at each character.
BETWEEN = r"(?U)\d\s*+(?:[-–]|[tT][oO])"
CONTEXT_WORDS = ["salary", "base pay", "base salary", "pay range", "compensation"]
NOTE_WORDS = ["salary", "pay", "compensation", "bonus", "equity", "benefits"]
SYMBOL_CURRENCY = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
SENTENCE_ENDS = ".!?\n"
TRAILING_CHARS = 64
MINIMUM = 1000
MARK, HELD = "\u0001", "\u0002"
# ----------------------------------------------------------------------------------------------


def clean_fragment(x: Column) -> Column:
    """An HTML fragment as lines of text."""
    lines = F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.regexp_replace(lines, r"<br ?/?>|</p>|</li>", "\n")
    bare = F.regexp_replace(lines, r"<[^>]+>", " ")
    # Only texts with an entity go to Python.
    plain = F.coalesce(unescape_all(F.when(F.contains(x, F.lit("&")), bare)), bare)
    # A single blank or line end stays as it is, so it is no match.
    return strip(F.regexp_replace(F.regexp_replace(plain, r" [ \t]++|\t[ \t]*+", " "), r"\n{2,}+", "\n"))


def _has_any(x: Column, words: list[str]) -> Column:
    return x.rlike("|".join(words))


def _range_at(match: Column, context: Column, trailing: Column) -> Column:
    """One range: its amounts, currency and interval, given the sentence around it and the text behind it."""
    amount = lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("bigint")

    def build(p: Column) -> Column:
        around = F.lower(F.concat_ws(" ", p["context"], p["trailing"]))
        marked = F.concat(p["code1"], p["sym1"], p["code2"], p["sym2"]) != ""
        symbol = F.when(p["sym1"] != "", p["sym1"]).otherwise(p["sym2"])
        wanted = ((p["low"] >= MINIMUM) | (p["high"] >= MINIMUM)) & (
            marked | _has_any(F.lower(p["context"]), CONTEXT_WORDS)
        )
        currency = F.coalesce(code_currency(p["code1"]), code_currency(p["code2"]), lookup(symbol, SYMBOL_CURRENCY))
        return F.when(
            wanted,
            F.struct(
                p["low"].alias("min_amount"), p["high"].alias("max_amount"), currency.alias("currency"),
                bind(around, interval_word).alias("interval"), F.nullif(p["context"], F.lit("")).alias("context"),
            ),
        )

    def parted(groups: Column) -> Column:
        code1, sym1, low, code2, sym2, high = [F.get(groups, i) for i in range(6)]
        return bind(
            F.struct(
                code1.alias("code1"), sym1.alias("sym1"), amount(low).alias("low"), code2.alias("code2"),
                sym2.alias("sym2"), amount(high).alias("high"), context.alias("context"), trailing.alias("trailing"),
            ),
            build,
        )

    # One search gives all six groups; the mark is in no text.
    return bind(F.split(F.regexp_replace(match, WHOLE, MARK.join(f"${i}" for i in range(1, 7))), MARK, -1), parted)


def _ranges_of_sentence(sentences: Column, sentence: Column, index: Column) -> Column:
    """The ranges marked in one sentence. The interval may stand up to ``TRAILING_CHARS`` characters behind a range, also
    in the next sentences; that bound is part of the rule."""
    plain = lambda x: F.replace(F.replace(x, F.lit(MARK), F.lit("")), F.lit(HELD), F.lit("\n"))

    def ranges(p: Column) -> Column:
        def one(j: Column) -> Column:
            # A match has nine characters at least, so these parts reach far enough.
            rest = F.concat(F.array_join(F.slice(p["parts"], j + 2, F.lit(TRAILING_CHARS // 4)), ""), p["after"])
            return _range_at(plain(F.get(p["parts"], j)), p["context"], F.substring(plain(rest), 1, TRAILING_CHARS))

        return F.transform(F.sequence(F.lit(1), F.size(p["parts"]) - 2, F.lit(2)), one)

    after = plain(F.array_join(F.slice(sentences, index + 2, F.lit(TRAILING_CHARS)), ""))
    return bind(
        F.struct(F.split(sentence, MARK, -1).alias("parts"), F.substring(after, 1, TRAILING_CHARS).alias("after"),
                 collapse_space(plain(sentence)).alias("context")),
        ranges,
    )


def pay_ranges(text: Column) -> Column:
    """The distinct ranges of a cleaned text, in order of appearance.

    The text is cut where no range can go on, and the pieces that may hold one are searched; one regex pass marks their ranges. Then
    the marked text is cut into sentences: a range's context is its sentence, so the work grows with the length of the text.
    """

    def mark(part: Column) -> Column:
        pieces = F.split(F.regexp_replace(part, RANGE, f"{MARK}$0{MARK}"), MARK, -1)
        # A line end inside a range ends no sentence.
        return F.array_join(F.transform(pieces, lambda piece, i: F.when(
            i % 2 == 1, F.concat(F.lit(MARK), F.replace(piece, F.lit("\n"), F.lit(HELD)), F.lit(MARK))).otherwise(piece)), "")

    def scan(t: Column) -> Column:
        # No range has one of these marks inside.
        parts = F.regexp_extract_all(t, F.lit(r"[^.!?]*+[.!?]|[^.!?]++"), F.lit(0))
        marked = F.transform(parts, lambda part: F.when(part.rlike(BETWEEN), mark(part)).otherwise(part))
        sentence = f"[^{SENTENCE_ENDS}]*+[{SENTENCE_ENDS}]|[^{SENTENCE_ENDS}]++"
        return F.regexp_extract_all(F.array_join(marked, ""), F.lit(sentence), F.lit(0))

    def ranges(sentences: Column) -> Column:
        none = F.array().cast(f"array<{PAY_RANGE.simpleString()}>")
        found = F.transform(sentences, lambda s, i: F.when(
            F.contains(s, F.lit(MARK)),
            _ranges_of_sentence(sentences, s, i).cast(f"array<{PAY_RANGE.simpleString()}>")).otherwise(none))
        return F.array_distinct(F.filter(F.flatten(found), lambda r: r.isNotNull()))

    # Marks of the input are removed before anything is located in it.
    unmarked = F.translate(text, MARK + HELD, "")
    return bind(bind(unmarked, scan), ranges)


def pay_notes(text: Column, ranges: Column) -> Column:
    """Distinct sentences or lines with a pay word that are not the context of a range."""
    # A word has no white space inside, so pieces without one are dropped as they are.
    pieces = F.filter(F.split(text, r"(?U)\n+|(?<=[.!?])\s+"), lambda s: _has_any(F.lower(s), NOTE_WORDS))
    contexts = F.transform(ranges, lambda r: r["context"])
    return F.array_except(F.array_distinct(F.transform(pieces, collapse_space)), contexts)


def extract_pay(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pay_ranges`` and ``pay_notes``; both NULL when a text has no range. Only texts with digits are scanned."""
    worth = F.col(text).rlike(r"(?U)\d")
    cleaned = docs.withColumn("_clean", F.when(worth, clean_fragment(F.col(text))))
    found = cleaned.withColumn("pay_ranges", pay_ranges(F.col("_clean")))
    any_range = F.coalesce(F.size("pay_ranges"), F.lit(0)) > 0
    return (
        found.withColumn("pay_notes", F.when(any_range, pay_notes(F.col("_clean"), F.col("pay_ranges"))))
        .withColumn("pay_ranges", F.when(any_range, F.col("pay_ranges")))
        .drop("_clean")
    )


def pay_range_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per range. The outer explode keeps Spark from testing, and so computing, the ranges twice."""
    found = extract_pay(docs, text).select(key, F.explode_outer("pay_ranges").alias("r"))
    return found.where(F.col("r").isNotNull()).select(key, "r.*")


def pay_note_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    found = extract_pay(docs, text).select(key, F.explode_outer("pay_notes").alias("note"))
    return found.where(F.col("note").isNotNull())


def merge_pay(primary: Column, fallback: Column) -> Column:
    """Ordered union of two (ranges, notes) structs without copies; the other one when one is NULL."""
    both = F.struct(
        F.array_distinct(F.concat(primary["ranges"], fallback["ranges"])).alias("ranges"),
        F.array_distinct(F.concat(primary["notes"], fallback["notes"])).alias("notes"),
    )
    return F.when(primary.isNull(), fallback).when(fallback.isNull(), primary).otherwise(both)
