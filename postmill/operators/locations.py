"""Normalization of free-text locations to (city, region, country) with a gazetteer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_strings, strip
from ..session import materialize

# --- Fixed values -----------------------------------------------------------------------------
FIRST_LEVEL_TYPES = [
    "state", "province", "territory", "region", "prefecture", "autonomous community", "canton", "land", "emirate",
    "governorate",
]
COUNTRY_PRIORITY = ["US", "CA", "AU", "GB", "DE", "JP", "FR", "IN"]
PREFIX = r"(?i)^(remote\s*[-–]?\s*|hybrid\s*[-–]?\s*|onsite\s*[-–]?\s*|greater\s+|metro\s+|downtown\s+)"
NO_PLACE = ["remote", "hybrid", "onsite"]
FUZZY_RATIO = 0.88
# ----------------------------------------------------------------------------------------------


def _priority(code: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(c) for c in COUNTRY_PRIORITY]), code)
    return F.when(place == 0, F.lit(len(COUNTRY_PRIORITY))).otherwise(place - 1).cast("int")


@dataclass
class Gazetteer:
    """One row per lower-case key with what the key may be: a country, a region by name, regions by code, cities."""

    entries: DataFrame

    @classmethod
    def of(cls, countries: DataFrame, subdivisions: DataFrame, cities: DataFrame) -> Gazetteer:
        """From countries (alias, name, iso2), subdivisions (code, name, country_code, type, seq) and
        cities (name, countrycode, admin1code, population, seq). The entries are stored, as they are read often."""
        by_alias = countries.groupBy(F.lower("alias").alias("key")).agg(
            F.min_by(F.struct("name", "iso2"), "name").alias("country"))
        names = by_alias.select(F.col("key").alias("_iso"), F.col("country.name").alias("country_name"))
        first_level = (
            subdivisions.where(F.lower("type").isin(FIRST_LEVEL_TYPES))
            .withColumn("_iso", F.lower("country_code"))
            .join(names, "_iso", "left")
            .withColumn("code", F.element_at(F.split("code", "-"), -1))
            .withColumn("place", F.struct(_priority(F.col("country_code")).alias("priority"), "seq", "name", "code",
                                          "country_code", "country_name"))
        )
        named = cities.where(F.coalesce("name", F.lit("")) != "").withColumn("_iso", F.lower("countrycode")).join(
            names, "_iso", "left")
        city = F.struct(
            F.coalesce("population", F.lit(0)).cast("bigint").alias("population"),
            (-_priority(F.col("countrycode"))).alias("priority"),
            (-F.col("seq")).alias("seq"),
            "name",
            F.col("countrycode").alias("country_code"),
            F.col("admin1code").alias("admin1"),
            "country_name",
        )
        stacked = (
            by_alias
            .unionByName(first_level.select(F.lower("name").alias("key"), F.col("place").alias("region")), True)
            .unionByName(first_level.select(F.lower("code").alias("key"), F.col("place").alias("code")), True)
            .unionByName(named.select(F.lower("name").alias("key"), city.alias("city")), True)
        )
        # The lists hold the places of one name.
        entries = stacked.groupBy("key").agg(
            F.max("country").alias("country"),
            F.max_by("region", "region.seq").alias("region"),
            F.sort_array(F.collect_list("code")).alias("codes"),
            F.collect_list("city").alias("cities"),
        )
        some = lambda name: F.when(F.size(name) > 0, F.col(name))
        return cls(materialize(entries.withColumns({"codes": some("codes"), "cities": some("cities")})))


# --- Fuzzy names ------------------------------------------------------------------------------


def _edits(length: Column) -> Column:
    """Most edits a name of this length can be away and still reach the ratio."""
    return F.floor(length * F.lit((1 - FUZZY_RATIO) / FUZZY_RATIO)).cast("int")


def _cut(length: Column, edits: Column, i: Column) -> Column:
    return F.floor(i * length / (edits + 1)).cast("int")


def fuzzy_best(keys: DataFrame, names: DataFrame) -> DataFrame:
    """(key, group, name): for each key and group of names the most similar name, if 1 - levenshtein / longer length
    reaches the ratio. ``names`` holds (group, name).

    A name that may be ``d`` edits away is cut into d + 1 pieces. A key within that distance holds at least one
    piece unchanged, at most d characters from its place, so an equi-join on the pieces finds every pair.
    """
    indexed = (
        names.select("group", "name", F.length("name").alias("len"))
        .withColumn("edits", _edits(F.col("len")))
        .where(F.col("edits") > 0)
        .select("group", "name", "len", "edits", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("i"))
        .withColumn("from", _cut(F.col("len"), F.col("edits"), F.col("i")))
        .withColumn("to", _cut(F.col("len"), F.col("edits"), F.col("i") + 1))
        .select("group", "name", "len", "i", F.substring("name", F.col("from") + 1, F.col("to") - F.col("from")).alias("piece"))
    )
    reach = _edits(F.length("key")) + 1
    probes = (
        keys.select("key", F.length("key").alias("n"), reach.alias("reach"))
        .select("key", "n", F.explode(F.sequence(F.greatest(F.col("n") - F.col("reach"), F.lit(1)),
                                                 F.col("n") + F.col("reach"))).alias("len"))
        .withColumn("edits", _edits(F.col("len")))
        .where(F.col("edits") > 0)
        .select("key", "n", "len", "edits", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("i"))
        .withColumn("from", _cut(F.col("len"), F.col("edits"), F.col("i")))
        .withColumn("size", _cut(F.col("len"), F.col("edits"), F.col("i") + 1) - F.col("from"))
        .withColumn("first", F.greatest(F.lit(0), F.col("from") - F.col("edits")))
        .withColumn("last", F.least(F.col("n") - F.col("size"), F.col("from") + F.col("edits")))
        .where(F.col("first") <= F.col("last"))
        .select("key", "len", "i", "size", F.explode(F.sequence("first", "last")).alias("at"))
        .select("key", "len", "i", F.substring("key", F.col("at") + 1, F.col("size")).alias("piece"))
        .distinct()
    )
    ratio = 1 - F.levenshtein("key", "name") / F.greatest(F.length("key"), F.length("name"))
    return (
        probes.join(indexed, ["len", "i", "piece"])
        .select("key", "group", "name")
        .distinct()
        .withColumn("ratio", ratio)
        .where(F.col("ratio") >= FUZZY_RATIO)
        .groupBy("key", "group")
        .agg(F.min_by("name", F.struct(-F.col("ratio"), F.col("name"))).alias("name"))
    )


# --- Interpretation ---------------------------------------------------------------------------


def _best_city(cities: Column, country: Column, admin1: Column | None = None) -> Column:
    """The largest city of the country (and region)."""

    def fits(c: Column) -> Column:
        inside = c["country_code"] == country
        return inside & (c["admin1"] == admin1) if admin1 is not None else inside

    return F.array_max(F.filter(cities, fits))


def _first(items: Column) -> Column:
    return F.get(F.filter(items, lambda x: x.isNotNull()), F.lit(0))


def _place(city: Column, region: Column, country: Column) -> Column:
    return F.struct(
        city.cast("string").alias("city"), region.cast("string").alias("region"), country.cast("string").alias("country")
    )


def _city_in_region(cities: Column, regions: Column, country: Column | None) -> Column:
    """First region (of the country, if given) that has one of the cities."""

    def attempt(s: Column) -> Column:
        city = _best_city(cities, s["country_code"], s["code"])
        owner = s["country_name"] if country is None else country["name"]
        fits = city.isNotNull() & owner.isNotNull()
        if country is not None:
            fits = fits & (s["country_code"] == country["iso2"])
        return F.when(fits, _place(city["name"], s["name"], owner))

    return _first(F.transform(regions, attempt))


def _region_in_country(regions: Column, country: Column) -> Column:
    null = F.lit(None)
    return _first(F.transform(regions, lambda s: F.when(
        s["country_code"] == country["iso2"], _place(null, s["name"], country["name"]))))


def _city_in_country(cities: Column, country: Column) -> Column:
    city = _best_city(cities, country["iso2"])
    return F.when(country.isNotNull() & city.isNotNull(), _place(city["name"], F.lit(None), country["name"]))


def _scored(t: list[Column]) -> Column:
    """Readings of two or three tokens, best score first (fixed order of the readings)."""
    a, b, c = t
    three = F.coalesce(
        _city_in_region(a["cities"], b["regions"], c["country"]),
        _city_in_region(c["cities"], b["regions"], a["country"]),
        _city_in_region(b["cities"], a["regions"], c["country"]),
        _city_in_region(b["cities"], c["regions"], a["country"]),
    )
    two = F.coalesce(
        _city_in_region(a["cities"], b["regions"], None),
        _region_in_country(a["regions"], b["country"]),
        _region_in_country(b["regions"], a["country"]),
        _city_in_country(a["cities"], b["country"]),
        _city_in_country(b["cities"], a["country"]),
        _city_in_region(b["cities"], a["regions"], None),
    )
    return F.when(F.col("n") == 3, three).when(F.col("n") == 2, two)


def _with_kind(tokens: DataFrame) -> DataFrame:
    """What each token is on its own: country, region, city or unknown."""
    region = F.coalesce("by_name", F.get("by_code", F.lit(0)), F.col("fuzzy_region"))
    cities = F.coalesce("cities", "fuzzy_cities")
    kind = (
        F.when(F.col("key") == "", "unknown")
        .when(F.col("bare_country").isNotNull(), "country")
        .when(F.coalesce("by_name", F.get("by_code", F.lit(0))).isNotNull(), "region")
        .when(F.col("cities").isNotNull(), "city")
        .when(F.col("fuzzy_region").isNotNull(), "region")
        .when(F.col("fuzzy_cities").isNotNull(), "city")
        .otherwise("unknown")
    )
    return tokens.withColumns({"kind": kind, "region": region, "options": cities, "city": F.array_max(cities)})


def _lookups(tokens: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """Attach the gazetteer entries of each token, and of the most similar names where a token has none.

    Only tokens of distinct texts come here, so Spark may choose the joins; AQE broadcasts what it measures small.
    """
    entries = gazetteer.entries
    alias = entries.where(F.col("country").isNotNull()).select(F.col("key").alias("whole"), "country")
    own = entries.select("key", F.col("country").alias("bare_country"), F.col("region").alias("by_name"),
                         F.col("codes").alias("by_code"), "cities")
    found = materialize(tokens.join(alias, "whole", "left").join(own, "key", "left"))
    nothing = F.coalesce(F.col("bare_country.name"), F.col("by_name.name"), F.get("by_code", F.lit(0))["name"],
                         F.get("cities", F.lit(0))["name"]).isNull()
    unknown = found.where((F.col("key") != "") & nothing).select("key").distinct()
    groups = F.array(F.when(F.col("region").isNotNull(), "region"), F.when(F.col("cities").isNotNull(), "city"))
    names = entries.select(F.explode(groups).alias("group"), F.col("key").alias("name")).where(F.col("group").isNotNull())
    near = fuzzy_best(unknown, names).join(
        entries.select(F.col("key").alias("name"), "region", "cities"), "name"
    ).groupBy("key").agg(
        F.max(F.when(F.col("group") == "region", F.col("region"))).alias("fuzzy_region"),
        F.max(F.when(F.col("group") == "city", F.col("cities"))).alias("fuzzy_cities"),
    )
    return found.join(near, "key", "left")


def _context(t: Column) -> Column:
    """Of two tokens, a city next to a region code that has such a city: (city index, city, region)."""
    null = F.lit(None)
    found = null
    for i in (1, 0):
        one, other = F.get(t, F.lit(i)), F.get(t, F.lit(1 - i))
        hit = _first(_context_hits(one, other, i))
        found = F.when(one["kind"] == "city", F.coalesce(hit, found)).otherwise(found)
    return found


def _context_hits(one: Column, other: Column, i: int) -> Column:
    def attempt(s: Column) -> Column:
        city = _best_city(one["options"], s["country_code"], s["code"])
        return F.when(city.isNotNull(), F.struct(F.lit(i).alias("i"), city.alias("city"), s.alias("region")))

    return F.transform(other["by_code"], attempt)


def _first_of(kind: str) -> Column:
    return F.get(F.filter("t", lambda x: x["kind"] == kind), F.lit(0))


def _assembled(df: DataFrame) -> DataFrame:
    """First country, region and city among the tokens; the city is chosen to fit, a missing country is inferred."""
    context = F.when(F.col("n") == 2, _context(F.col("t")))
    df = df.withColumn("ctx", context)
    df = df.withColumns({
        "country_token": _first_of("country")["bare_country"],
        "region_token": F.coalesce(F.col("ctx.region"), _first_of("region")["region"]),
        "city_token": _first_of("city"),
    })
    # With a context hit the other token is the region, whatever it was on its own.
    df = df.withColumn(
        "country_token",
        F.when(F.col("ctx").isNull() | (F.get("t", 1 - F.col("ctx.i"))["kind"] != "country"), F.col("country_token")),
    )
    options = F.when(F.col("ctx").isNotNull(), F.get("t", F.col("ctx.i"))["options"]).otherwise(F.col("city_token.options"))
    start = F.coalesce(F.col("ctx.city"), F.col("city_token.city"))
    country_code = F.coalesce(F.col("region_token.country_code"), F.col("country_token.iso2"))
    fitted = (
        F.when(F.col("region_token").isNotNull(), _best_city(options, country_code, F.col("region_token.code")))
        .when(country_code.isNotNull(), _best_city(options, country_code))
        .otherwise(start)
    )
    df = df.withColumn("chosen", F.coalesce(fitted, start))
    df = df.withColumns({
        "a_city": F.col("chosen.name"),
        "a_region": F.col("region_token.name"),
        "a_country": F.coalesce("country_token.name", "chosen.country_name", "region_token.country_name"),
    })
    bare = lambda i: F.nullif(F.get("t", F.lit(i))["bare"], F.lit(""))
    is_country = lambda i: F.get("t", F.lit(i))["kind"] == "country"
    unknown = F.filter(F.reverse("t"), lambda x: (x["kind"] == "unknown") & (x["bare"] != ""))
    filler = F.coalesce(
        F.when(is_country(0), bare(2)), F.when(is_country(2), bare(0)), F.get(unknown, F.lit(0))["bare"]
    )
    fill = F.col("a_city").isNull() & F.col("a_region").isNotNull() & F.col("a_country").isNotNull() & (F.col("n") == 3)
    return df.withColumn(
        "assembled", _place(F.when(fill, filler).otherwise(F.col("a_city")), F.col("a_region"), F.col("a_country"))
    )


def location_text(raw: Column) -> Column:
    """The text to read: an object's city, region and country joined by commas, else the text itself."""
    value = strip(raw)
    is_object = F.coalesce(value.startswith("{"), F.lit(False)) & F.try_parse_json(value).isNotNull()
    field = lambda *names: F.coalesce(*[
        F.nullif(strip(F.get_json_object(value, f"$.{name}")), F.lit("")) for name in names])
    parts = F.concat_ws(
        ", ", field("normalizedCityName", "city"), field("normalizedStateName", "region"),
        field("normalizedCountryName", "countryIso2a"),
    )
    return F.when(is_object & (parts != ""), parts).otherwise(value)


def normalize_distinct(raws: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """(raw, city, region, country) for a table of distinct texts."""
    text = location_text(F.col("raw"))
    usable = F.when((text != "") & ~F.lower(text).isin(NO_PLACE), text)
    parts = raws.select("raw", clean_strings(F.split(usable, ",")).alias("parts"))
    exploded = parts.select("raw", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "token"))
    bare = strip(F.regexp_replace("token", PREFIX, ""))
    tokens = exploded.withColumn("bare", bare).withColumn("key", F.lower("bare")).withColumn("whole", F.lower("token"))
    looked_up = _with_kind(_lookups(tokens, gazetteer)).withColumn(
        "regions", F.when(F.col("by_name").isNotNull(), F.array("by_name")).otherwise(F.col("by_code"))
    )
    token = F.struct("pos", "bare", "kind", "country", "bare_country", "regions", "by_code", "cities", "options", "city",
                     "region")
    # The tokens of one text.
    rows = looked_up.groupBy("raw", "n").agg(F.array_sort(F.collect_list(token), _by_pos).alias("t"))
    rows = rows.withColumn("scored", _scored([F.get("t", F.lit(i)) for i in range(3)]))
    result = _assembled(rows).withColumn("place", F.coalesce("scored", "assembled"))
    found = result.select("raw", "place.city", "place.region", "place.country")
    return raws.join(found, "raw", "left")


def _by_pos(a: Column, b: Column) -> Column:
    return a["pos"] - b["pos"]


def normalize_locations(df: DataFrame, column: str, gazetteer: Gazetteer) -> DataFrame:
    """Adds (city, region, country) for a text column. Each distinct text is read once and joined back."""
    raws = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("raw")).agg(F.lit(1).alias("_")).drop("_")
    places = normalize_distinct(raws, gazetteer).withColumnRenamed("raw", column)
    return df.join(places, column, "left")


def normalize_location_arrays(df: DataFrame, key: list[str], column: str, gazetteer: Gazetteer) -> DataFrame:
    """(key, locations): the texts of an array column, normalized and put back in order."""
    each = df.select(*key, F.posexplode(column).alias("pos", "raw"))
    read = normalize_locations(each, "raw", gazetteer)
    # The group is one posting's own list of locations.
    item = F.struct("pos", F.struct("city", "region", "country").alias("place"))
    lists = read.groupBy(*key).agg(F.array_sort(F.collect_list(item), _by_pos).alias("_l"))
    return df.select(*key).join(lists, key, "left").select(
        *key, F.transform(F.coalesce("_l", F.array().cast(lists.schema["_l"].dataType)), lambda x: x["place"])
        .alias("locations"),
    )
