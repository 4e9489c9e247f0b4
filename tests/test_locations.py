import pytest

from postmill.operators import locations as L


@pytest.fixture(scope="module")
def gazetteer(spark):
    countries = [
        ("usa", "United States", "US"), ("us", "United States", "US"), ("United States", "United States", "US"),
        ("uk", "United Kingdom", "GB"), ("gb", "United Kingdom", "GB"), ("il", "Israel", "IL"), ("jp", "Japan", "JP"),
        ("japan", "Japan", "JP"), ("france", "France", "FR"), ("fr", "France", "FR"), ("germany", "Germany", "DE"),
        ("de", "Germany", "DE"), ("canada", "Canada", "CA"),
    ]
    subdivisions = [
        ("US-WA", "Washington", "US", "State", 1), ("US-CA", "California", "US", "State", 2),
        ("US-IL", "Illinois", "US", "State", 3), ("CA-ON", "Ontario", "CA", "Province", 4),
        ("CA-AB", "Alberta", "CA", "Province", 5), ("JP-13", "Tokyo", "JP", "Prefecture", 6),
        ("DE-BY", "Bavaria", "DE", "Land", 7), ("FR-75", "Paris", "FR", "Metropolitan department", 8),
    ]
    cities = [
        ("Seattle", "US", "WA", 700000, 1), ("London", "GB", "ENG", 9000000, 2), ("Paris", "FR", "11", 2000000, 3),
        ("Mountain View", "CA", "AB", 1500, 4), ("Mountain View", "US", "CA", 82000, 5),
        ("Menlo Park", "CA", "AB", 500, 6), ("Menlo Park", "US", "CA", 34000, 7), ("Chicago", "US", "IL", 2700000, 8),
        ("Tokyo", "JP", "13", 9000000, 9), ("San Francisco", "US", "CA", 800000, 10),
    ]
    return L.Gazetteer.of(
        spark.createDataFrame(countries, "alias string, name string, iso2 string"),
        spark.createDataFrame(subdivisions, "code string, name string, country_code string, type string, seq int"),
        spark.createDataFrame(cities, "name string, countrycode string, admin1code string, population int, seq int"),
    )


NONE = (None, None, None)
US_MV = ("Mountain View", "California", "United States")
CASES = {
    "": NONE, "Remote": NONE, " hybrid ": NONE, "Alpha, Beta": NONE, "{broken": NONE,
    "Seattle, WA, USA": ("Seattle", "Washington", "United States"),
    "London, UK": ("London", None, "United Kingdom"),
    "UK, London": ("London", None, "United Kingdom"),
    "Bavaria, Germany": (None, "Bavaria", "Germany"),
    "USA, Washington": (None, "Washington", "United States"),
    "Mountain View, Canada": ("Mountain View", None, "Canada"),
    "Mountain View, CA, USA": US_MV,
    "USA, CA, Mountain View": US_MV,
    "Menlo Park, CA": ("Menlo Park", "California", "United States"),
    "Chicago, IL": ("Chicago", "Illinois", "United States"),
    "Menlo Park, USA": ("Menlo Park", None, "United States"),
    "Japan, Tokyo-to, Tokyo": ("Tokyo", "Tokyo", "Japan"),
    '{"normalizedCityName": "Seattle", "normalizedStateName": "Washington", "normalizedCountryName": "USA"}':
        ("Seattle", "Washington", "United States"),
    '{"city": "London", "countryIso2a": "GB"}': ("London", None, "United Kingdom"),
    "washngton": (None, "Washington", "United States"),
    "San Fransisco": ("San Francisco", None, "United States"),
    "Remote - Seattle, WA": ("Seattle", "Washington", "United States"),
    "Greater Seattle": ("Seattle", None, "United States"),
    "Seattle": ("Seattle", None, "United States"),
}


def test_cases(spark, gazetteer):
    frame = spark.createDataFrame(list(enumerate(CASES)), "i int, raw string")
    frame = frame.union(spark.createDataFrame([(99, None)], "i int, raw string"))
    got = {r["i"]: (r["city"], r["region"], r["country"]) for r in
           L.normalize_locations(frame, "raw", gazetteer).collect()}
    assert got.pop(99) == NONE
    wanted = dict(enumerate(CASES.values()))
    # The fixture names Tokyo-to as unknown: the country comes first, so the third token is the city.
    assert got == wanted


def test_arrays_keep_their_order(spark, gazetteer):
    frame = spark.createDataFrame([(1, ["London, UK", "Remote", "Seattle"]), (2, []), (3, None)], "k int, l array<string>")
    got = {r["k"]: [p["city"] for p in r["locations"]] for r in
           L.normalize_location_arrays(frame, ["k"], "l", gazetteer).collect()}
    assert got == {1: ["London", None, "Seattle"], 2: [], 3: []}


def test_fuzzy_join_finds_every_pair(spark):
    import random

    rng = random.Random(3)
    names = sorted({"".join(rng.choices("abcd", k=rng.randint(3, 28))) for _ in range(150)})
    keys = set()
    for name in names:
        letters = list(name)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(letters))
            letters[at:at + 1] = rng.choice([[], ["a"], ["x", letters[at]]])
            letters = letters or ["z"]
        keys.add("".join(letters))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    wanted = {}
    for key in keys - set(names):
        best = min(((-(1 - distance(key, n) / max(len(key), len(n))), n) for n in names))
        if -best[0] >= L.FUZZY_RATIO:
            wanted[key] = best[1]
    got = L.fuzzy_best(
        spark.createDataFrame([(k,) for k in keys - set(names)], "key string"),
        spark.createDataFrame([("g", n) for n in names], "group string, name string"),
    ).collect()
    assert {r["key"]: r["name"] for r in got} == wanted
