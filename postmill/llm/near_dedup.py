"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its distinct 5-word shingles. Two collections of ``KEYS`` small keys are made of two minhashes each, and
every pair of a key of the first and a key of the second collection is a table key of four minhashes. So ``4 * KEYS``
minhashes serve ``KEYS ** 2`` tables. Two sets of similarity J share a table unless one collection has no key in common:
at J = 0.75 that is 2 * (1 - 0.75 ** 2) ** 14, about 2 in 100,000, and less for every larger J.

1. Documents with equal sets are one class, so copies cost nothing further.
2. Only keys that two classes share can lead to a shared table; the others are dropped before the pairs of keys are formed.
3. Each class is compared with one centre, the first class by a fixed random order among all its tables. That joins copies and
   crowds at the cost of one pair per class.
4. The classes of tables that still hold several components are joined exactly. Of a set only the shingles that another
   component has too matter; sets that share all of these are a crowd, say around one passage, which its smallest set stands
   for. Crowds are joined by their first shingles: in one order, rare ones first by their exact counts, two sets that are similar
   enough share a shingle among the first seventh of the smaller and the first quarter of the larger one, at places that leave
   room for the rest. Each crowd first meets one hub per shingle, the crowd that shares most with all others; the pairs that no
   link has brought together by then are all compared. A member of a crowd is compared by its size alone, so no pairs inside a
   crowd are formed.
5. A pair is a link only after its full sets, or all that they can share, have been compared; components are labels that spread
   over the links.

A shingle that is frequent among the first ones of many crowds is dealt over several salts.

Defined results: null and empty texts and texts without words have an empty set and are linked with nothing; equal rows get equal
results; a doc_id with several texts stands for each of them; a row without doc_id is linked with nothing, has no
component_id and is kept; a very long text is a set like any other, of all its shingles; an empty table gives no rows. Extra
columns, whatever their names, pass through ``keep_first`` and are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .arrow import flat_bytes, process_cache, slices

SHINGLE = 5
# Keys in each of the two collections; a key is made of two minhashes.
KEYS = 14
PERCENT = 75
CHUNK = 2 << 20
SEED = 20
# One more salt for each HOT crowds of a shingle, up to MOST_SALTS.
HOT = 2000
MOST_SALTS = 64


def _constants():
    rng = np.random.default_rng(SEED)

    def odd(n):
        return rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)

    base = odd(1)[0]
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    return {"letters": odd(256), "base": base, "inverse": inverse, "words": odd(SHINGLE + 1), "mask": odd(4 * KEYS),
            "times": odd(4 * KEYS), "join": odd(2 * KEYS)}


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(of: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, of, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, number of words before each text): words of many texts at once."""
    c = process_cache("near_constants", _constants)
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64)
    inside = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    # A word is a polynomial of its letters: a difference of two prefix sums, moved to power 0.
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(c["letters"][low] * _powers(c["base"], n), dtype=np.uint64)])
    hashes = _mix((sums[ends] - sums[starts]) * _powers(c["inverse"], n)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(column) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    c = process_cache("near_constants", _constants)
    bounds, data = flat_bytes(column)
    hashes, upto = word_hashes(bounds, data)
    n = max(0, len(hashes) - SHINGLE + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        rolled += hashes[k : k + n] * c["words"][k]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        if b - a >= SHINGLE:
            found = np.sort(rolled[a : b - SHINGLE + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            whole = (hashes[a:b] * c["words"][: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(_mix(whole + c["words"][SHINGLE:] * np.array([b - a], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """[set, 2 * KEYS]: the keys of both collections of non-empty sets."""
    c = process_cache("near_constants", _constants)
    flat = np.concatenate(sets)
    firsts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((len(sets), 4 * KEYS), dtype=np.uint64)
    for k in range(4 * KEYS):
        least[:, k] = np.minimum.reduceat((flat ^ c["mask"][k]) * c["times"][k], firsts)
    return _mix(least[:, 0::2] * c["join"] + _mix(least[:, 1::2])).view(np.int64)


def _sketches(batches):
    for part in slices(batches, max_bytes=CHUNK):
        sets = shingle_sets(part.column("text"))
        full = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        if full:
            for i, row in zip(full, half_keys([sets[i] for i in full])):
                keys[i] = row
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
             pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "digest", "keys"],
        )


def _sets(batches):
    for part in slices(batches, max_bytes=CHUNK):
        sets = [s.view(np.int64) for s in shingle_sets(part.column("text"))]
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))],
            names=["id", "digest", "members"],
        )


def _shared_parts(sets: DataFrame) -> DataFrame:
    """(id, digest, n, label, part): the sorted shingles of each set that a set of another label holds too, if there are any."""
    rows = sets.select("id", "digest", "label", F.size("members").alias("n"), F.explode("members").alias("shingle"))
    met = rows.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    # A set's own shingles are gathered, no others; a repeated row has them twice.
    return rows.join(met.select("shingle"), "shingle", "left_semi").groupBy("id", "digest").agg(
        F.first("n").alias("n"), F.first("label").alias("label"), F.array_sort(F.collect_set("shingle")).alias("part")
    )


def _postings(crowds: DataFrame) -> DataFrame:
    """(shingle, often, crowd, n, place, index, weight): the first shingles of each crowd, rare ones first.

    Two crowds that are similar enough share one of them, marked ``index`` in the smaller one. Shingles of a passage are in the
    same crowds. The first of all shingles that are in the same crowds stands for them: it comes before the others in every
    set, so a pair that meets in one of them meets in it. ``weight`` is what a crowd shares with all others, by its size.
    """
    rows = crowds.select("crowd", "least", F.size("part").alias("size"), F.explode("part").alias("shingle"))
    often = _stored(rows.groupBy("shingle").agg(
        F.count("*").alias("often"), F.bit_xor(F.xxhash64("crowd")).alias("these"),
        F.bit_xor(F.xxhash64("crowd", F.lit(SEED))).alias("too"),
    ), "often")
    leads = often.where("often > 1").groupBy("often", "these", "too").agg(F.min("shingle").alias("shingle"))
    often = often.select("shingle", "often")
    order = rows.join(often, "shingle").groupBy("crowd").agg(
        F.first("least").alias("n"), F.first("size").alias("size"), (F.sum("often") / F.first("least")).alias("weight"),
        F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("order"),
    )
    # Shingles that no other label has come before all others and meet nothing.
    placed = order.select("crowd", "n", "size", "weight", F.posexplode("order").alias("at", "entry")).select(
        "crowd", "n", "weight", F.col("entry.shingle").alias("shingle"), F.col("entry.often").alias("often"),
        (F.col("at") + F.col("n") - F.col("size")).alias("place"),
    )
    probe = F.expr(f"n - cast(ceil({PERCENT} * n / 100) AS int) + 1")
    index = F.expr(f"n - cast(ceil({2 * PERCENT} * n / {100 + PERCENT}) AS int) + 1")
    return _stored(
        placed.where((F.col("often") > 1) & (F.col("place") < probe)).withColumn("index", F.col("place") < index).join(
            leads.select("shingle"), "shingle", "left_semi"
        ), "postings"
    )


def _salts():
    """(the salt of one row, a row for each salt) of a shingle."""
    salts = F.least(F.expr(f"cast(often div {HOT} AS int) + 1"), F.lit(MOST_SALTS))
    return F.pmod(F.xxhash64("crowd"), salts).cast("int"), F.explode(F.sequence(F.lit(0), salts - 1))


def _with_facts(postings: DataFrame, facts: DataFrame) -> DataFrame:
    """Each posting with what ``facts`` (shingle, often, ...) holds on its shingle, if anything."""
    dealt, everywhere = _salts()
    each = facts.select("*", everywhere.alias("salt")).drop("often")
    return postings.withColumn("salt", dealt).join(each, ["shingle", "salt"]).drop("salt")


def _with_hubs(postings: DataFrame) -> DataFrame:
    """(x, y): each crowd with the crowd of its shingle that shares most with all others: one pair a posting at most."""
    hubs = postings.groupBy("shingle", "often").agg(F.max(F.struct("weight", "crowd", "n", "one")).alias("hub"))
    size = 100 * F.least("n", "hub.n") >= PERCENT * F.greatest("n", "hub.n")
    other = F.col("one").isNull() | F.col("hub.one").isNull() | (F.col("one") != F.col("hub.one"))
    met = _with_facts(postings, hubs).where((F.col("crowd") != F.col("hub.crowd")) & size & other)
    return met.select(F.col("hub.crowd").alias("x"), F.col("crowd").alias("y")).distinct()


def _first_meetings(postings: DataFrame) -> DataFrame:
    """(x, y): pairs of crowds, not of one and the same label, that share a shingle among the first ones of both.

    Crowds of the most frequent label of a shingle have nothing to add to each other, so only the others meet all.
    """
    sizes = postings.groupBy("shingle", "often", "one").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("shingle", "often").agg(
        F.max(F.when(F.col("one").isNotNull(), F.struct("size", "one"))).alias("main"), F.sum("size").alias("all")
    ).where("main IS NULL OR main.size < all")
    apart = ~F.coalesce(F.col("one") == F.col("main.one"), F.lit(False))
    rows = _stored(_with_facts(postings, mixed).withColumn("apart", apart).drop("main", "all"), "meetings")
    dealt, everywhere = _salts()

    def side(of: DataFrame, salt, name: str) -> DataFrame:
        return of.select("shingle", salt.alias("salt"), F.col("crowd").alias(name), F.col("one").alias(f"{name}_one"),
                         F.col("n").alias(f"{name}_n"), F.col("place").alias(f"{name}_place"))

    ahead = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x") < F.col("y")))
    # At the first common shingle of a pair, so many can be common at most.
    common = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    enough = (100 + PERCENT) * common >= PERCENT * (F.col("x_n") + F.col("y_n"))
    # Two crowds of one and the same label have nothing to add.
    other = F.col("x_one").isNull() | F.col("y_one").isNull() | (F.col("x_one") != F.col("y_one"))
    possible = other & ahead & (100 * F.col("x_n") >= PERCENT * F.col("y_n")) & enough
    apart, key = rows.where("apart"), ["shingle", "salt"]
    first = side(apart.where("index"), everywhere, "x").join(side(rows, dealt, "y"), key).where(possible)
    second = side(rows.where("index AND NOT apart"), dealt, "x").join(side(apart, everywhere, "y"), key).where(possible)
    return first.select("x", "y").unionByName(second.select("x", "y")).distinct()


def _crowd_links(pairs: DataFrame, crowds: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """(x, y): links inside crowds and between those of ``pairs``."""
    side = crowds.select("crowd", "centre", "least", "part")
    both = pairs.join(side.toDF("x", "x_centre", "x_least", "x_part"), "x").join(
        side.toDF("y", "y_centre", "y_least", "y_part"), "y"
    ).withColumn("most", F.expr(f"{100 + PERCENT} * size(array_intersect(x_part, y_part)) div {PERCENT}"))
    # A set of the one crowd is similar to the centre of the other if both sizes together are at most ``most``.
    met = _stored(both.where("x_least + y_least <= most").select(
        "x", "y", "x_centre", "y_centre", (F.col("most") - F.col("y_least")).alias("x_room"),
        (F.col("most") - F.col("x_least")).alias("y_room"),
    ), f"{name}-met")
    own = side.select(
        "crowd", F.expr(f"{100 + PERCENT} * size(part) div {PERCENT} - least").alias("room"), F.col("centre").alias("of")
    )
    rooms = own.unionByName(met.select(F.col("x").alias("crowd"), F.col("x_room").alias("room"), F.col("y_centre").alias("of")))
    rooms = rooms.unionByName(met.select(F.col("y").alias("crowd"), F.col("y_room").alias("room"), F.col("x_centre").alias("of")))
    widest = rooms.groupBy("crowd").agg(F.max(F.struct("room", "of")).alias("best"))
    members = parts.select("crowd", "id", "n").join(widest, "crowd").where("n <= best.room AND id <> best.of").select(
        F.col("id").alias("x"), F.col("best.of").alias("y")
    )
    centres = met.select(F.col("x_centre").alias("x"), F.col("y_centre").alias("y"))
    return _stored(centres.unionByName(members).distinct(), name)


def _rest(sets: DataFrame) -> DataFrame:
    """(x, y): links that join all components of ``sets`` (id, digest, label, members) that are similar enough; exact.

    Two sets of different labels share what their parts share. Sets with equal parts are a crowd, and the smallest set of a
    crowd stands for it: whatever links with a larger one links with the smallest, so a member only needs the crowd that
    lets the largest sets in. Links with the hubs of shingles join most labels first, at a cost in proportion to the shingles;
    the pairs of what is still apart are then compared, all of them.
    """
    parts = _stored(_shared_parts(sets).withColumn("crowd", F.md5(F.concat_ws(",", F.col("part").cast("array<string>")))), "parts")
    crowds = _stored(parts.groupBy("crowd").agg(F.min(F.struct("n", "id")).alias("first"), F.first("part").alias("part")).select(
        "crowd", "part", F.col("first.n").alias("least"), F.col("first.id").alias("centre")
    ), "crowds")
    postings = _postings(crowds)
    labels = parts.select("crowd", "id", "label")

    def labelled(labels: DataFrame) -> DataFrame:
        """The postings with the label that all members of the crowd have, if they have one."""
        ones = labels.groupBy("crowd").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low = high")
        return postings.join(ones.select("crowd", F.col("low").alias("one")), "crowd", "left")

    near = _crowd_links(_with_hubs(labelled(labels)), crowds, parts, "links-hubs")
    label_of = labels.select("id", "label").distinct()
    joined = near.join(label_of.toDF("x", "x_label"), "x").join(label_of.toDF("y", "y_label"), "y").where("x_label <> y_label")
    moved = _components(joined.select(F.col("x_label").alias("x"), F.col("y_label").alias("y")))
    labels = _stored(labels.join(moved.toDF("label", "onward"), "label", "left").select(
        "crowd", "id", F.coalesce("onward", "label").alias("label")), "labels-hubs")
    far = _crowd_links(_first_meetings(labelled(labels)), crowds, parts, "links-apart")
    return near.unionByName(far).distinct()


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: computed once, and safe if executors go."""
    where = scratch_path(df.sparkSession, f"near-{name}")
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def _tables(classes: DataFrame) -> DataFrame:
    """(table, id): the table keys of classes that may meet another one in a table."""
    rows = classes.select("id", F.posexplode("keys").alias("slot", "key"))
    shared = rows.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    met = rows.join(shared, ["slot", "key"], "left_semi")
    first, second = F.col("slot") < KEYS, F.col("slot") >= KEYS
    # At most KEYS keys of each collection.
    pair = F.struct("slot", "key")
    lists = met.groupBy("id").agg(
        F.collect_list(F.when(first, pair)).alias("a"), F.collect_list(F.when(second, pair)).alias("b")
    ).where((F.size("a") > 0) & (F.size("b") > 0))
    left = lists.select("id", F.explode("a").alias("a"), "b")
    return left.select("id", "a", F.explode("b").alias("b")).select(F.xxhash64("a.slot", "a.key", "b.slot", "b.key").alias("table"), "id")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough."""
    x = sets.select(F.col("id").alias("x"), F.col("members").alias("x_members"))
    y = sets.select(F.col("id").alias("y"), F.col("members").alias("y_members"))
    both = pairs.join(x, "x").join(y, "y")
    common = F.size(F.array_intersect("x_members", "y_members"))
    union = F.size("x_members") + F.size("y_members") - common
    return both.where(100 * common >= PERCENT * union).select("x", "y")


def _components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that links lead to, for every id with a link."""
    edges = _stored(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = _stored(edges.groupBy("x").agg(F.min("y").alias("m")).select(
        F.col("x").alias("id"), F.least("x", "m").alias("label")), "labels")
    while True:
        # The least label among the neighbours, then the label of the label.
        near = edges.join(labels.withColumnRenamed("id", "y"), "y").groupBy("x").agg(F.min("label").alias("m"))
        moved = labels.join(near, F.col("id") == F.col("x")).select(
            "id", F.col("label").alias("old"), F.least("label", "m").alias("label")
        )
        onward = labels.select(F.col("id").alias("at"), F.col("label").alias("further"))
        jumped = moved.join(onward, F.col("label") == F.col("at"), "left").select(
            "id", "old", F.least("label", F.coalesce("further", "label")).alias("label")
        )
        jumped = _stored(jumped, "labels")
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("id", "label")
        if not changed:
            return labels


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    sketches = _stored(
        docs.mapInArrow(_sketches, "doc_id bigint, n_shingles bigint, digest binary, keys array<bigint>"), "sketches"
    )
    filled = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = _stored(
        filled.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.max("n_shingles").alias("n")),
        "classes",
    )
    tables = _stored(_tables(classes), "tables")
    sizes = classes.select("id", "n")
    ids = tables.select("id").distinct()
    text_of = docs.where("doc_id IS NOT NULL").join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    sets = _stored(text_of.mapInArrow(_sets, "id bigint, digest binary, members array<bigint>"), "sets")
    small_x, small_y = sizes.toDF("x", "x_n"), sizes.toDF("y", "y_n")

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        """Links among pairs whose sizes allow one."""
        sized = pairs.distinct().join(small_x, "x").join(small_y, "y")
        possible = sized.where(100 * F.least("x_n", "y_n") >= PERCENT * F.greatest("x_n", "y_n")).select("x", "y").distinct()
        return _stored(_links(possible, sets).distinct(), name)

    order = F.struct(F.xxhash64("id", F.lit(SEED)).alias("turn"), F.col("id").alias("centre"))
    centres = tables.groupBy("table").agg(F.min(order).alias("first"))
    nearest = tables.join(centres, "table").groupBy("id").agg(F.min("first").alias("first"))
    links = similar(
        nearest.where(F.col("first.centre") != F.col("id")).select(F.col("first.centre").alias("x"), F.col("id").alias("y")), "links"
    )
    labels = _components(links)
    # Tables that hold several components: all pairs of their classes are settled at once.
    placed = tables.join(labels, "id", "left").select("table", "id", F.coalesce("label", "id").alias("label"))
    several = placed.groupBy("table").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    left = _stored(placed.join(several.select("table"), "table", "left_semi").select("id", "label").distinct(), "left")
    found = _stored(_rest(sets.join(left, "id")), "links-rest")
    if found.limit(1).count():
        labels = _components(links.unionByName(found))
    reach = labels.select(F.col("id").alias("of"), "label")
    by_class = classes.select("digest", "id").join(reach, F.col("id") == F.col("of"), "left").select(
        F.col("digest").alias("class"), F.coalesce("label", "id").alias("class_id")
    )
    joined = sketches.join(by_class, (F.col("digest") == F.col("class")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("class_id", "doc_id")
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without those that are linked with a smaller doc_id; all columns stay."""
    dropped = components(docs).where("NOT kept").select("doc_id").distinct().withColumnRenamed("doc_id", "id")
    # All columns in one, so that none can clash.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = whole.join(dropped, F.col("row.doc_id").cast("bigint") == F.col("id"), "left_anti")
    return kept.select("row.*")
