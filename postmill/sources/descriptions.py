"""Detail payloads of the sources as description texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import (
    BLOCKS, description_text, drop_elements, html_to_text, join_sections, prepend_title, section, unescape, unescape_all,
)
from ..functions.money import public_amount
from ..functions.text import bind, blank_to_null, collapse_space, dedupe, join_lines, optional_string, squeeze_blank_lines, strip
from ..functions.text import strip_list_markers
from ..schemas import PAY_RANGE
from .payloads import CALLBACK

# Fixed value: the note below a public compensation line.
COMPENSATION_NOTE = (
    "Individual compensation is determined by skills, qualifications, experience, and location. "
    "Compensation details listed in this posting reflect the base hourly rate, monthly rate, or annual salary only, "
    "and do not include bonus, equity or sales incentives, if applicable. In addition to base compensation, Meta "
    "offers benefits. Learn more about benefits at Meta."
)


def _json(name: str) -> Column:
    return F.get_json_object("payload", f"$.{name}")


def amazon_description(details: DataFrame) -> DataFrame:
    """From the description field; adds ``description`` to (…, payload) rows, like the functions below."""
    text = F.coalesce(optional_string(_json("description")), optional_string(_json("description_short")))
    return details.withColumn("description", html_to_text(text))


def headed_sections(page: Column, tags: str) -> Column:
    """Sections of a page that start at a heading element: ``Heading`` over its text, set apart by blank lines."""
    pieces = F.split(drop_elements(page), rf"(?i)<(?:{tags})\b[^>]*>", -1)

    def piece(x: Column, i: Column) -> Column:
        parts = F.split(x, rf"(?i)</(?:{tags})\s*>", 2)
        heading = collapse_space(_inline_text(F.get(parts, F.lit(0))))
        body = _block_text(F.get(parts, F.lit(1)))
        headed = F.concat_ws("\n", blank_to_null(heading), body)
        return F.when(i == 0, _block_text(x)).otherwise(headed)

    kept = F.filter(F.transform(pieces, piece), lambda s: F.coalesce(s, F.lit("")) != "")
    return blank_to_null(F.array_join(kept, "\n\n"))


def _inline_text(x: Column) -> Column:
    """Text of inline markup, decoded in the JVM (usable inside array functions)."""
    return unescape(F.regexp_replace(x, r"<[^>]*>", ""))


def _block_text(x: Column) -> Column:
    lines = _inline_text(F.regexp_replace(x, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n"))
    cleaned = F.transform(F.split(lines, "\n"), lambda line: F.regexp_replace(strip(line), r"^[-•* ]+", ""))
    return blank_to_null(F.array_join(F.filter(cleaned, lambda line: line != ""), "\n"))


def amazon_page_description(pages: DataFrame) -> DataFrame:
    """From a detail page: its title, then each section of the job body; NULL without a job body."""
    page = F.col("payload")
    title = collapse_space(_inline_text(
        F.regexp_extract(page, r"""(?is)<h1[^>]*class=["'][^"']*title[^"']*["'][^>]*>(.*?)</h1>""", 1)))
    body = F.regexp_extract(page, r"""(?is)<div[^>]*id=["']job-detail-body["'][^>]*>(.*)$""", 1)
    text = F.when(body != "", join_sections(title, headed_sections(body, "h2")))
    return pages.withColumn("description", text)


def apple_description(details: DataFrame) -> DataFrame:
    text = lambda name: html_to_text(_json(name))
    return details.withColumn("description", join_sections(
        text("postingTitle"),
        section("Summary", text("jobSummary")),
        section("Description", text("description")),
        section("Minimum Qualifications", text("minimumQualifications")),
        section("Preferred Qualifications", text("preferredQualifications")),
        section("Responsibilities", text("responsibilities")),
        text("eeoContent"),
    ))


def _google_qualifications(x: Column) -> Column:
    """The qualifications text under its two headings; the first heading is added when it is missing."""
    compact = F.array_join(F.filter(F.split(x, "\n"), lambda line: strip(line) != ""), "\n")
    minimum = r"(?im)^Minimum qualifications:?[^\S\n]*$"
    with_preferred = F.regexp_replace(compact, r"(?im)^Preferred qualifications:?[^\S\n]*$", "\nPreferred Qualifications")
    named = F.regexp_replace(with_preferred, minimum, "Minimum Qualifications")
    return F.when(compact.rlike(minimum), named).otherwise(F.concat(F.lit("Minimum Qualifications\n"), with_preferred))


def google_description(details: DataFrame) -> DataFrame:
    """(page, external_job_id, description) from the detail block of each page."""
    data = F.regexp_extract("payload", CALLBACK % 0, 1)
    rows = details.select("page", F.try_variant_get(F.try_parse_json(F.nullif(data, F.lit(""))), "$[0]", "variant").alias("j"))
    field = lambda i: html_to_text(F.coalesce(
        F.try_variant_get("j", f"$[{i}][1]", "string"), F.try_variant_get("j", f"$[{i}]", "string")))
    quals = field(4)
    return rows.select(
        "page", F.try_variant_get("j", "$[0]", "string").alias("external_job_id"),
        join_sections(
            F.try_variant_get("j", "$[1]", "string"),
            section("About the job", field(10)),
            bind(quals, _google_qualifications),
            section("Responsibilities", strip_list_markers(field(3))),
        ).alias("description"),
    )


def microsoft_description(details: DataFrame) -> DataFrame:
    text = lambda name: html_to_text(_json(name))
    rendered = F.replace(headed_sections(_json("jobDescription"), "b|strong"), F.lit(":\n\n"), F.lit(":\n"))
    fallback = join_sections(
        section("Responsibilities", text("responsibilities")),
        section("Required Qualifications", text("requiredQualifications")),
        section("Minimum Qualifications", text("minimumQualifications")),
        section("Other Requirements", text("otherRequirements")),
        section("Preferred Qualifications", text("preferredQualifications")),
        text("jobQualifications"), text("qualification"),
    )
    return details.withColumn(
        "description", prepend_title(optional_string(_json("name")), F.coalesce(rendered, fallback))
    )


def netflix_description(details: DataFrame) -> DataFrame:
    """A description is one text or a list of texts."""
    raw = _json("job_description")
    texts = F.transform(F.from_json(F.when(raw.startswith("["), raw), "array<string>"),
                        lambda t: description_text(t, decode=unescape))
    listed = blank_to_null(F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n\n"))
    body = F.when(raw.startswith("["), listed).otherwise(description_text(raw))
    title = F.coalesce(optional_string(_json("posting_name")), optional_string(_json("name")))
    return details.withColumn("description", bind(
        F.struct(title.alias("title"), body.alias("body")),
        lambda p: F.when(p["body"].isNotNull(), prepend_title(p["title"], p["body"])),
    ))


# --- meta -------------------------------------------------------------------------------------


def html_fragment(x: Column) -> Column:
    """The markup of a text that may be wrapped as ``{"__html": …}``."""
    value = optional_string(x)
    wrapped = F.when(value.startswith("{") & F.try_parse_json(value).isNotNull(),
                     optional_string(F.get_json_object(value, "$.__html")))
    return F.coalesce(wrapped, value)


def detail_items(array_json: Column) -> Column:
    """Distinct texts of a list whose elements are texts or objects with an ``item``."""
    elements = F.try_variant_get(F.try_parse_json(array_json), "$", "array<variant>")
    raw = F.transform(elements, lambda e: F.coalesce(F.try_variant_get(e, "$.item", "string"),
                                                     F.try_variant_get(e, "$", "string")))
    texts = F.transform(raw, lambda t: collapse_space(unescape(t)))
    return dedupe(F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != ""))


_COMPENSATION = (
    "array<struct<compensation_amount_minimum:string,compensation_amount_maximum:string,has_bonus:boolean,"
    "has_equity:boolean,error_apology_note:string>>"
)


def public_compensation(array_json: Column) -> Column:
    """(ranges, notes) of a public compensation list, NULL when it holds neither."""
    items = F.from_json(array_json, _COMPENSATION)

    def to_range(x: Column) -> Column:
        low, high = public_amount(x["compensation_amount_minimum"]), public_amount(x["compensation_amount_maximum"])
        currency = F.coalesce(low["currency"], high["currency"])
        interval = F.coalesce(low["interval"], high["interval"])
        known = F.coalesce(low["amount"], high["amount"]).isNotNull() | currency.isNotNull() | interval.isNotNull()
        return F.when(known, F.struct(
            low["amount"].alias("min_amount"), high["amount"].alias("max_amount"), currency.alias("currency"),
            interval.alias("interval"), F.lit("public_compensation").alias("context"),
        ))

    def to_notes(x: Column) -> Column:
        return F.array(F.when(x["has_bonus"], "Bonus eligible"), F.when(x["has_equity"], "Equity eligible"),
                       optional_string(x["error_apology_note"]))

    ranges = F.filter(F.transform(items, to_range), lambda r: r.isNotNull()).cast(f"array<{PAY_RANGE.simpleString()}>")
    notes = dedupe(F.filter(F.flatten(F.transform(items, to_notes)), lambda n: n.isNotNull()))
    both = F.struct(ranges.alias("ranges"), notes.alias("notes"))
    return F.when(F.size(ranges) + F.size(notes) > 0, both)


def compensation_line(array_json: Column) -> Column:
    """``min to max + bonus + equity + benefits`` of the first entry."""
    first = F.get(F.from_json(array_json, _COMPENSATION), F.lit(0))
    low, high = (optional_string(first[f"compensation_amount_{end}"]) for end in ("minimum", "maximum"))
    extras = F.concat_ws(" + ", F.when(first["has_bonus"], "bonus"), F.when(first["has_equity"], "equity"),
                         F.lit("benefits"))
    return F.when(F.coalesce(low, high).isNotNull(), F.concat(F.concat_ws(" to ", low, high), F.lit(" + "), extras))


def meta_description(details: DataFrame) -> DataFrame:
    lines = lambda name: F.array_join(detail_items(_json(name)), "\n")
    pay = compensation_line(_json("public_compensation"))
    about = join_sections(
        html_to_text(html_fragment(_json("boiler_plate_intro"))),
        join_lines(html_to_text(html_fragment(_json("california_disclaimer")))),
        pay, F.when(pay.isNotNull(), F.lit(COMPENSATION_NOTE)),
    )
    return details.withColumn("description", join_sections(
        squeeze_blank_lines(unescape_all(optional_string(_json("title")))),
        section("Description", html_to_text(html_fragment(_json("description")))),
        section("Responsibilities", lines("responsibilities")),
        section("Minimum Qualifications", lines("minimum_qualifications")),
        section("Preferred Qualifications", lines("preferred_qualifications")),
        section("About Meta", about),
    ))


DESCRIBE = {
    "amazon": amazon_description,
    "apple": apple_description,
    "google": google_description,
    "microsoft": microsoft_description,
    "meta": meta_description,
    "netflix": netflix_description,
}
