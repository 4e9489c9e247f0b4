"""String and array Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LOCATIONS

# Letter-or-digit runs.
TOKEN = r"[\p{L}\p{N}]+"
# All Unicode white space, what ``(?U)\s`` matches.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def bind(x: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(x)`` with ``x`` computed once, however often ``fn`` uses it; keeps long rule chains compact."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def strip(x: Column) -> Column:
    """Trim all Unicode white space on both ends; what is between them is not looked at."""
    return F.btrim(x, F.lit(WHITE_SPACE))


def blank_to_null(x: Column) -> Column:
    """NULL for an empty text; computes ``x`` once."""
    return bind(x, lambda v: F.nullif(v, F.lit("")))


def optional_string(x: Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(strip(x), F.lit(""))


def to_int(x: Column) -> Column:
    """Text of an optionally signed whole number as a long, else NULL."""
    cleaned = strip(x.cast("string"))
    return F.when(cleaned.rlike(r"^-*\d+$"), cleaned.try_cast("bigint"))


def collapse_space(x: Column) -> Column:
    # A single blank stays as it is, so it is no match.
    return strip(F.regexp_replace(x, r"(?U)\s{2,}+|[^\S ]", " "))


def unix_newlines(x: Column) -> Column:
    return F.regexp_replace(x, r"\r\n?", "\n")


def squeeze_blank_lines(x: Column) -> Column:
    """At most one blank line in a row."""
    return strip(F.regexp_replace(unix_newlines(x), r"\n{3,}", "\n\n"))


def trim_lines(x: Column) -> Column:
    """Trim each line and keep one blank line between paragraphs."""
    lines = F.array_join(F.transform(F.split(unix_newlines(x), "\n"), strip), "\n")
    return F.nullif(squeeze_blank_lines(lines), F.lit(""))


def join_lines(x: Column) -> Column:
    """All non-blank lines on one line."""
    lines = F.filter(F.transform(F.split(unix_newlines(x), "\n"), strip), lambda line: line != "")
    return F.nullif(F.array_join(lines, " "), F.lit(""))


def slug(x: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("job"))


def strip_list_markers(x: Column) -> Column:
    """Remove one leading ``- ``, ``* `` or ``• `` from each line."""
    lines = F.transform(
        F.split(unix_newlines(x), "\n"),
        lambda line: F.regexp_replace(F.regexp_replace(line, r"(?U)^\s+", ""), r"^[-*•] ", ""),
    )
    return F.nullif(strip(F.array_join(lines, "\n")), F.lit(""))


def dedupe(xs: Column) -> Column:
    """First occurrence of each element, order kept."""
    return F.array_distinct(xs)


def clean_strings(xs: Column) -> Column:
    """Trimmed non-blank elements."""
    return F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), strip), lambda x: x != "")


def clean_locations(xs: Column) -> Column:
    """Trim the parts, turn blanks into NULL and drop elements without any part."""
    cleaned = F.transform(
        F.coalesce(xs, F.array().cast(LOCATIONS)),
        lambda e: F.struct(
            optional_string(e["city"]).alias("city"),
            optional_string(e["region"]).alias("region"),
            optional_string(e["country"]).alias("country"),
        ),
    )
    return F.filter(cleaned, lambda e: F.coalesce(e["city"], e["region"], e["country"]).isNotNull())


def tokens(x: Column) -> Column:
    """Lower-case letter-or-digit runs, the analyzer of the search index."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(f"({TOKEN})"), 1)


def count_tokens(x: Column) -> Column:
    """Number of tokens, without building them."""
    return F.regexp_count(F.lower(F.coalesce(x, F.lit(""))), F.lit(TOKEN))


def split_location(x: Column) -> Column:
    """Comma-separated text to a struct by position alone: country, or city + region/country, or city, region, rest."""
    # Country codes that a two-part location may end in, and two-letter codes always read as a region.
    country_codes = [
        "AE", "AU", "BR", "CA", "DE", "FR", "GB", "IN", "IE", "IT", "JP", "KR", "MX", "NL", "SG", "UK", "US",
    ]
    region_codes = ["CA", "NY", "WA", "TX", "MA", "IL"]
    parts = clean_strings(F.split(x, ","))
    second = F.get(parts, F.lit(1))
    is_code = second.rlike(r"(?U)\p{Lu}") & (second == F.upper(second)) & (F.length(second) <= 3)
    is_region = (is_code & ~second.isin(country_codes)) | second.isin(region_codes)
    n = F.size(parts)
    return F.struct(
        F.when(n >= 2, F.get(parts, F.lit(0))).otherwise("").alias("city"),
        F.when(n >= 3, second).when((n == 2) & is_region, second).otherwise("").alias("region"),
        F.when(n == 1, F.get(parts, F.lit(0)))
        .when((n == 2) & ~is_region, second)
        .when(n >= 3, F.array_join(F.slice(parts, 3, F.greatest(n - 2, F.lit(0))), ", "))
        .otherwise("")
        .alias("country"),
    )


def status_ok(x: Column) -> Column:
    """NULL counts as fine; else a number in [200, 300)."""
    code = x.cast("string").try_cast("int")
    return F.when(x.isNull(), F.lit(True)).otherwise(F.coalesce(code.between(200, 299), F.lit(False)))


def quote(x: Column) -> Column:
    """Percent-encode a path segment, keeping slashes."""
    encoded = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))
