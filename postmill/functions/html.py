"""HTML Column functions: entities, markup removal, embedded JSON-LD."""

from __future__ import annotations

import html as _html
import json as _json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dates import any_epoch
from .text import bind, blank_to_null, optional_string, squeeze_blank_lines, strip, unix_newlines


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(_html.unescape, na_action="ignore")


# Entities decoded without Python.
_COMMON = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&middot;": "\u00b7",
    "&copy;": "\u00a9", "&ndash;": "\u2013", "&mdash;": "\u2014", "&bull;": "\u2022", "&hellip;": "\u2026",
    "&lsquo;": "\u2018", "&rsquo;": "\u2019", "&ldquo;": "\u201c", "&rdquo;": "\u201d",
}


def unescape(x: Column) -> Column:
    """Decode the common entities in the JVM. ``&amp;`` goes last, so an escaped entity is decoded once."""
    out = x
    for entity, char in _COMMON.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def unescape_all(x: Column) -> Column:
    """Decode every HTML entity, in Arrow batches. ``x`` stands here once, so a long chain behind it is computed once."""
    return _unescape(x)


# --- Text of a page ---------------------------------------------------------------------------

# Elements that hold no content of their own, and elements that end a line.
SKIPPED = ["script", "style", "noscript", "template", "head", "nav", "header", "footer", "aside", "form", "iframe", "svg"]
BLOCKS = "p|div|li|ul|ol|h[1-6]|section|article|main|table|tr|blockquote|pre|br|hr|dt|dd|title"


def _replace_to_last(x: Column, element: str, last: str, by: str = " ") -> Column:
    """Replace ``element`` up to the last text that can end one; what starts behind it is never closed and not searched."""

    def cut(page: Column) -> Column:
        return F.struct(page.alias("page"), F.regexp_extract(page, rf"(?is)^.*{last}", 0).alias("head"))

    def replaced(c: Column) -> Column:
        tail = F.substring(c["page"], F.length(c["head"]) + 1, F.length(c["page"]))
        return F.when(c["head"] == "", c["page"]).otherwise(F.concat(F.regexp_replace(c["head"], element, by), tail))

    return bind(bind(x, cut), replaced)


def drop_elements(x: Column, names: list[str] = SKIPPED) -> Column:
    out = _replace_to_last(x, r"(?s)<!--.*?-->", "-->")
    for name in names:
        out = _replace_to_last(out, rf"(?is)<{name}\b[^>]*+>.*?</{name}\s*+>", rf"</{name}\s*+>")
    return out


def main_content(x: Column) -> Column:
    """Inside of the first ``article`` or ``main`` element up to its last end tag, else the whole page."""

    def inside(page: Column) -> Column:
        inner = [F.nullif(F.regexp_extract(page, rf"(?is)<{name}\b[^>]*>(.*)</{name}\s*>", 1), F.lit(""))
                 for name in ("article", "main")]
        return F.coalesce(*inner, page)

    return bind(x, inside)


def _text_lines(decoded: Column) -> Column:
    lines = F.transform(F.split(decoded, "\n"), lambda line: strip(F.regexp_replace(line, r"(?U)\s+", " ")))
    return blank_to_null(F.array_join(F.filter(lines, lambda line: line != ""), "\n"))


def render(x: Column, decode: Callable[[Column], Column] = unescape_all) -> Column:
    """Markup to lines of text: blocks on lines of their own, cells set apart, tags dropped, entities decoded."""
    out = F.regexp_replace(x, r"(?i)</t[dh]\s*>", " | ")
    out = _replace_to_last(out, rf"(?i)</?(?:{BLOCKS})\b[^>]*+>", ">", "\n")
    return bind(decode(_replace_to_last(out, r"<[^>]*+>", ">", "")), _text_lines)


def html_to_text(x: Column, full_document: bool = False, decode: Callable[[Column], Column] = unescape_all) -> Column:
    """Main text of a fragment or of a whole page; NULL when there is none.

    Inside array functions, where Python cannot run, pass ``decode=unescape``.
    """
    cleaned = drop_elements(x)
    return render(main_content(cleaned) if full_document else cleaned, decode)


def meta_description(x: Column) -> Column:
    found = F.regexp_extract(x, r'(?i)<meta\s+name="description"\s+content="([^"]*)"', 1)
    return optional_string(found)


# --- Embedded JSON-LD -------------------------------------------------------------------------


def _objects(value, deep: bool):
    """The objects of a JSON value in document order: all of them, or only lists and ``@graph`` members."""
    if isinstance(value, dict):
        yield value
        children = value.values() if deep else [value["@graph"]] if isinstance(value.get("@graph"), list) else []
        for child in children:
            yield from _objects(child, deep)
    elif isinstance(value, list):
        for child in value:
            yield from _objects(child, deep)


def _parsed(scripts):
    for text in [] if scripts is None else scripts:
        try:
            yield _json.loads(text)
        except ValueError:
            continue


def _posting(scripts, deep: bool):
    for value in _parsed(scripts):
        for item in _objects(value, deep):
            if str(item.get("@type") or "").strip().lower() == "jobposting":
                return _json.dumps(item, ensure_ascii=False)
    return None


def _value_of(scripts, key: str):
    for value in _parsed(scripts):
        for item in _objects(value, True):
            for name, found in item.items():
                if name.lower() == key and found is not None:
                    return found if isinstance(found, str) else _json.dumps(found)
    return None


@F.pandas_udf(T.StringType())
def _deep_posting(scripts: pd.Series) -> pd.Series:
    return scripts.map(lambda s: _posting(s, True))


@F.pandas_udf(T.StringType())
def _listed_posting(scripts: pd.Series) -> pd.Series:
    return scripts.map(lambda s: _posting(s, False))


@F.pandas_udf(T.StringType())
def _date_posted(scripts: pd.Series) -> pd.Series:
    return scripts.map(lambda s: _value_of(s, "dateposted"))


def json_ld_scripts(page: Column) -> Column:
    """Texts of the JSON-LD scripts of a page, NULL when it has none, so that Python sees few pages in full."""
    found = F.regexp_extract_all(
        page, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    return F.when(F.size(found) > 0, F.transform(found, strip))


def job_posting(page: Column, deep: bool = True) -> Column:
    """JSON text of the first ``JobPosting`` object; ``deep`` looks into every value, else into lists and graphs."""
    scripts = json_ld_scripts(page)
    return _deep_posting(scripts) if deep else _listed_posting(scripts)


def date_posted(page: Column) -> Column:
    """``datePosted`` of the JSON-LD, else of any matching text, as epoch seconds."""
    loose = F.regexp_extract(page, r'(?i)"datePosted"\s*:\s*"([^"]+)"', 1)
    return F.coalesce(any_epoch(_date_posted(json_ld_scripts(page))), any_epoch(loose))


def page_description(page: Column) -> Column:
    """Description of a job page: the JSON-LD posting with its title in front, else the meta tag, else the page text."""
    posting = job_posting(page, deep=False)
    body = description_text(F.get_json_object(posting, "$.description"))
    title = optional_string(F.get_json_object(posting, "$.title"))
    described = F.when(body.isNotNull(), prepend_title(title, body))
    return F.coalesce(described, description_text(meta_description(page)), html_to_text(page, full_document=True))


def description_text(x: Column, decode: Callable[[Column], Column] = unescape_all) -> Column:
    """A description that may be markup or plain text with list marks."""
    marked = F.contains(x, F.lit("<")) & F.contains(x, F.lit(">"))
    return bind(F.when(marked, html_to_text(x, decode=decode)).otherwise(x), plain_description)


def plain_description(x: Column) -> Column:
    """Trim lines, drop list marks and the blank lines after list items, keep one blank line elsewhere."""
    unlisted = F.regexp_replace(unix_newlines(x), r"(?mU)^[^\S\n]*+[-*][^\S\n]++(\S.*+)\n(?:[^\S\n]*+\n)++", "- $1\n")
    lines = F.transform(F.split(unlisted, "\n"), lambda line: F.regexp_replace(strip(line), r"(?U)^[-*]\s+", ""))
    return blank_to_null(squeeze_blank_lines(F.array_join(lines, "\n")))


# --- Sections ---------------------------------------------------------------------------------


def section(heading: str, body: Column) -> Column:
    """Heading over body, NULL without a body."""
    return bind(body, lambda b: F.when(b != "", F.concat(F.lit(f"{heading}\n"), b)))


def join_sections(*parts: Column) -> Column:
    """Parts set apart by a blank line; empty ones skipped."""
    kept = F.filter(F.array(*parts), lambda part: F.coalesce(part, F.lit("")) != "")
    return blank_to_null(F.array_join(kept, "\n\n"))


def prepend_title(title: Column, body: Column) -> Column:
    """Title over body, unless the body starts with it."""

    def build(p: Column) -> Column:
        t, b = p["title"], p["body"]
        both = F.when(b.startswith(t), b).otherwise(F.concat(t, F.lit("\n\n"), b))
        return F.when(t.isNotNull() & b.isNotNull(), both).otherwise(F.coalesce(t, b))

    return bind(F.struct(title.alias("title"), body.alias("body")), build)
