"""Skill extraction: phrases of a vocabulary found in texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..session import is_small, scratch_path
from .phrases import CHUNK_BYTES, PhraseTrie, Tokens, chunks

# Bytes of text that a task takes apart at a time.
TASK_BYTES = CHUNK_BYTES // 4

# A word may hold + # . ' & / - inside or + # at its end, so C++, C#, Node.js and CI/CD stay whole; any other mark
# is a token of its own. Possessive throughout, so a long unspaced string needs no backtracking stack.
WORD = r"[\p{L}\p{N}_]++(?:[.+#'&/\-]*+[\p{L}\p{N}_]++)*+[+#]*+|[^\s\p{L}\p{N}_]"


def phrase_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(f"({WORD})"), 1)


def phrase_key(x: Column) -> Column:
    return F.array_join(phrase_tokens(x), " ")


def lemma(word: Column) -> Column:
    """A rule-based base form: plural and verb endings removed. Used where no lemma model is at hand."""
    w = F.lower(word)
    return (
        F.when(F.length(w) <= 3, w)
        .when(w.endswith("ies"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(ss|us|is)$"), w)
        .when(w.rlike("(x|ch|sh|ss)es$"), F.regexp_replace(w, "es$", ""))
        .when(w.endswith("s"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


# --- Vocabulary -------------------------------------------------------------------------------


def _first_spelling(rows: DataFrame) -> DataFrame:
    """One row per case-insensitive skill: the spelling that comes first."""
    named = rows.withColumn("skill", strip(F.col("skill"))).where(F.coalesce(F.col("skill"), F.lit("")) != "")
    return (
        named.groupBy(F.lower("skill").alias("key"))
        .agg(F.min_by("skill", F.struct("source", "line")).alias("skill"),
             F.min(F.struct("source", "line")).alias("place"))
        .select("skill", F.col("place.source").alias("source"), F.col("place.line").alias("line"))
    )


def vocabulary(*parts: DataFrame) -> DataFrame:
    """(skill, source, line) from (skill, line) tables; an earlier table wins over a later one. Lines may be of any one type."""
    stacked = None
    for position, part in enumerate(parts):
        part = part.select("skill", F.lit(position).alias("source"), "line")
        stacked = part if stacked is None else stacked.unionByName(part)
    return _first_spelling(stacked)


def read_vocabulary(spark: SparkSession, technical: str, keywords: str | None = None) -> DataFrame:
    """A technical CSV (TAB-separated when .txt or .tsv) and an optional file with one skill per line.

    The technical file must exist; a keyword file that is missing counts as empty. Either may be a folder of files, which are read
    side by side; their lines follow each other in the order of the files' names.
    """
    # Columns that may hold the skill, in order of preference.
    names = ["Example", "Skill Name", "preferredLabel", "title"]
    separator = "\t" if technical.lower().endswith((".txt", ".tsv")) else ","
    table = spark.read.csv(technical, header=True, sep=separator, multiLine=True, escape='"')
    known = {name.lstrip("﻿"): name for name in table.columns}
    found = [F.nullif(F.col(f"`{known[name]}`"), F.lit("")) for name in names if name in known]
    skill = F.coalesce(*found) if found else F.lit(None).cast("string")
    # Rows of one part of a file are numbered in order; how files are packed into tasks does not matter.
    line = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("row"),
    )
    parts = [table.select(skill.alias("skill"), line.alias("line"))]
    if keywords is not None and _exists(spark, keywords):
        lines = spark.read.text(keywords).select(
            F.regexp_replace("value", "^﻿", "").alias("skill"), line.alias("line"))
        parts.append(lines)
    return vocabulary(*parts)


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(path).schema  # noqa: B018
        return True
    except AnalysisException:
        return False


# --- Matching ---------------------------------------------------------------------------------

# A vocabulary beyond the broadcast limits is parted into tries of about so many keys, and a part's texts into so many places.
PART_KEYS, PART_PLACES = 200_000, 1_000_000
FIRST_BITS = 1 << 24
MATCH = "id {}, stage int, pos int, size int, skill string"


def lemma_of(word: str) -> str:
    """``lemma`` of one lower-case word, for the distinct words of a batch."""
    if len(word) <= 3:
        return word
    if word.endswith("ies"):
        return word[:-3] + "y"
    if word.endswith(("ss", "us", "is")):
        return word
    if word.endswith(("xes", "ches", "shes", "sses")):
        return word[:-2]
    return word[:-1] if word.endswith("s") else word


def _keys(vocab: DataFrame, lemmas: bool) -> DataFrame:
    """(stage, key, skill): the words of each skill, joined by spaces; of base forms the first skill has the key."""
    keys = vocab.select(F.lit(1).alias("stage"), phrase_key(F.col("skill")).alias("key"), "skill")
    if lemmas:
        base = F.array_join(F.transform(phrase_tokens(F.col("skill")), lemma), " ")
        first = vocab.groupBy(base.alias("key")).agg(F.min_by("skill", F.struct("source", "line")).alias("skill"))
        keys = keys.unionByName(first.select(F.lit(2).alias("stage"), "key", "skill"))
    return keys.where(F.col("key") != "")


def _words_of(tokens: Tokens, stage: int) -> pa.Array:
    """The distinct words of texts as a stage sees them."""
    if stage == 1:
        return tokens.distinct
    return pa.array([lemma_of(w) for w in tokens.distinct.to_pylist()], pa.string())


class _Matcher:
    """The tries of one or two stages over the same skills."""

    def __init__(self, rows: list[tuple[int, str, str]]):
        self.skills = sorted({skill for _, _, skill in rows})
        place = {skill: i for i, skill in enumerate(self.skills)}
        self.tries, self.skill_of = {}, {}
        for stage in sorted({stage for stage, _, _ in rows}):
            here = [(key.split(" "), place[skill]) for s, key, skill in rows if s == stage]
            self.tries[stage] = PhraseTrie([words for words, _ in here])
            self.skill_of[stage] = np.array([p for _, p in here], dtype=np.int64)

    def __call__(self, tokens: Tokens) -> np.ndarray:
        """[text, stage, pos, size, skill] of each skill's first match in each text, by stage and place; exact ones first."""
        parts = [np.zeros((5, 0), dtype=np.int64)]
        for stage, trie in self.tries.items():
            codes = trie.places(_words_of(tokens, stage))[tokens.codes] if len(tokens.codes) else tokens.codes
            text, phrase, pos, size = trie.first_matches(codes, tokens.bounds)
            parts.append(np.stack([text, np.full(len(text), stage), pos, size, self.skill_of[stage][phrase]]))
        found = np.concatenate(parts, axis=1)
        # A skill that several keys, or both stages, lead to keeps its first match.
        found = found[:, np.lexsort((found[3], found[2], found[1], found[4], found[0]))]
        new = np.ones(found.shape[1], dtype=bool)
        new[1:] = (found[0, 1:] != found[0, :-1]) | (found[4, 1:] != found[4, :-1])
        found = found[:, new]
        return found[:, np.lexsort((found[4], found[3], found[2], found[1], found[0]))]


def _texts(docs: DataFrame) -> DataFrame:
    # Lower case is the JVM's, as in the rest of the library.
    return docs.select("id", F.lower("text").alias("text"))


def _in_tasks(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, found): one row per text with its matches (stage, pos, size, skill) in order. No shuffle."""
    rows = [(r["stage"], r["key"], r["skill"]) for r in keys.collect()]
    # Within the measured limits of a broadcast.
    sent = docs.sparkSession.sparkContext.broadcast(_Matcher(rows))

    def run(batches):
        match = sent.value
        names = pa.array(match.skills, pa.string())
        for part in chunks(batches, max_bytes=TASK_BYTES):
            text, stage, pos, size, skill = match(Tokens(pc.fill_null(part.column("text"), "").to_pylist()))
            offsets = np.searchsorted(text, np.arange(part.num_rows + 1))
            found = pa.StructArray.from_arrays(
                [*[pa.array(x, pa.int32()) for x in (stage, pos, size)], names.take(pa.array(skill))],
                names=["stage", "pos", "size", "skill"],
            )
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)
            yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "found"])

    kind = docs.schema["id"].dataType.simpleString()
    return _texts(docs).mapInArrow(run, f"id {kind}, found array<struct<stage:int,pos:int,size:int,skill:string>>")


def _slots(stage: int, words) -> np.ndarray:
    texts = np.array([f"{stage} {w}" for w in words.to_pylist()], dtype=object)
    return (pd.util.hash_array(texts) % FIRST_BITS).astype(np.int64) if len(texts) else np.zeros(0, dtype=np.int64)


def _by_first_word(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, stage, pos, size, skill) with a vocabulary of any size: its tries are parted by the first word of a phrase.

    A text sends the words from each place on, as far as the longest phrase goes, if a phrase may begin there; a table of
    ``FIRST_BITS`` bits tells which words begin one, so a wrong bit only sends more. A part of the vocabulary whose first words are
    frequent is repeated for several salts, over which its places are dealt.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "phrase-places")
    rows = keys.withColumn("words", F.split("key", " ")).withColumn("first", F.get("words", F.lit(0)))
    size = rows.agg(F.max(F.size("words")).alias("longest"), F.count("*").alias("n")).first()
    longest, parts = size["longest"] or 1, max(1, -(-size["n"] // PART_KEYS))

    def mark(batches):
        for part in batches:
            for stage in (1, 2):
                here = part.column("first").filter(pc.equal(part.column("stage"), stage))
                slots = np.unique(_slots(stage, here))
                yield pa.RecordBatch.from_pydict({"word": pa.array(slots >> 6), "bit": pa.array(np.int64(1) << (slots & 63))})

    bits = rows.select("stage", "first").distinct().mapInArrow(mark, "word bigint, bit bigint")
    marked = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(FIRST_BITS >> 6, dtype=np.int64)
    table[marked["word"].to_numpy(dtype=np.int64)] = marked["bits"].to_numpy(dtype=np.int64)
    sent = spark.sparkContext.broadcast(table)  # FIRST_BITS bits, whatever the size of the vocabulary
    stages = [r["stage"] for r in rows.select("stage").distinct().collect()]

    def places(batches):
        begins = sent.value
        for part in chunks(batches, max_bytes=TASK_BYTES):
            tokens = Tokens(pc.fill_null(part.column("text"), "").to_pylist())
            for stage in stages:
                words = _words_of(tokens, stage)
                slots = _slots(stage, words)
                known = (begins[slots >> 6] >> (slots & 63) & 1).astype(bool)
                at = np.flatnonzero(known[tokens.codes]) if len(tokens.codes) else tokens.codes
                owner = np.searchsorted(tokens.bounds, at, side="right") - 1
                many = np.minimum(longest, tokens.bounds[owner + 1] - at)
                ends = np.append(0, np.cumsum(many))
                run = np.arange(ends[-1]) + np.repeat(at - ends[:-1], many)
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("id").take(pa.array(owner)), "stage": pa.array(np.full(len(at), stage), pa.int32()),
                    "pos": pa.array(at - tokens.bounds[owner], pa.int32()),
                    "first": words.take(pa.array(tokens.codes[at])),
                    "run": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(tokens.codes[run]))),
                })

    kind = docs.schema["id"].dataType.simpleString()
    _texts(docs).mapInArrow(places, f"id {kind}, stage int, pos int, first string, run array<string>").withColumn(
        "part", F.pmod(F.xxhash64("first"), F.lit(parts))
    ).write.parquet(path)
    found = spark.read.parquet(path)
    # One row per part of the vocabulary.
    salts = found.groupBy("part").agg((F.expr(f"count(*) div {PART_PLACES}") + 1).alias("salts"))
    dealt = found.join(salts, "part").withColumn("salt", F.pmod(F.xxhash64("id", "pos"), "salts"))
    known = rows.withColumn("part", F.pmod(F.xxhash64("first"), F.lit(parts))).join(salts, "part").select(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), "stage", "words", "skill"
    )

    def match(texts, vocab):
        out = []
        for stage in stages:
            mine = vocab.filter(pc.equal(vocab["stage"], stage))
            here = texts.filter(pc.equal(texts["stage"], stage))
            if not mine.num_rows or not here.num_rows:
                continue
            trie = PhraseTrie(mine["words"].to_pylist())
            runs = here["run"].combine_chunks()
            bounds = np.append(0, np.cumsum(pc.list_value_length(runs).to_numpy()))
            coded = runs.flatten().dictionary_encode()
            codes = trie.places(coded.dictionary)[coded.indices.to_numpy()]
            text, place, size, phrase = trie.walk(codes, bounds)
            kept = place == 0
            at = pa.array(text[kept])
            out.append(pa.table({
                "id": here["id"].take(at), "stage": here["stage"].take(at), "pos": here["pos"].take(at),
                "size": pa.array(size[kept], pa.int32()), "skill": mine["skill"].take(pa.array(phrase[kept])),
            }))
        empty = pa.table({
            "id": texts["id"].slice(0, 0), "stage": pa.array([], pa.int32()), "pos": pa.array([], pa.int32()),
            "size": pa.array([], pa.int32()), "skill": pa.array([], pa.string()),
        })
        return pa.concat_tables([empty, *out])

    matched = dealt.groupBy("part", "salt").cogroup(known.groupBy("part", "salt")).applyInArrow(match, MATCH.format(kind))
    return matched.groupBy("id", "skill").agg(F.min(F.struct("stage", "pos", "size")).alias("at")).select("id", "at.*", "skill")


def skill_matches(docs: DataFrame, vocab: DataFrame, lemmas: bool = False) -> DataFrame:
    """(id, skill, stage, pos, size): case-insensitive phrase matches on token boundaries, each skill once per text.

    ``lemmas`` adds a second stage on base forms for skills that have no exact match in the text.
    """
    keys = _keys(vocab, lemmas)
    if is_small(keys):
        found = _in_tasks(docs, keys).select("id", F.explode("found").alias("m")).select("id", "m.*")
    else:
        found = _by_first_word(docs, keys)
    return found.select("id", "skill", "stage", "pos", "size")


def extract_skills(docs: DataFrame, vocab: DataFrame, lemmas: bool = False) -> DataFrame:
    """(id, skills) for every text (id, text), in match order; a text without a match has an empty list."""
    keys = _keys(vocab, lemmas)
    if is_small(keys):
        return _in_tasks(docs, keys).select("id", F.transform("found", lambda m: m["skill"]).alias("skills"))
    # At most one row per skill of the vocabulary.
    ordered = F.sort_array(F.collect_list(F.struct("stage", "pos", "size", "skill")))
    lists = _by_first_word(docs, keys).groupBy("id").agg(F.transform(ordered, lambda m: m["skill"]).alias("skills"))
    empty = F.array().cast(T.ArrayType(T.StringType()))
    return docs.select("id").join(lists, "id", "left").withColumn("skills", F.coalesce("skills", empty))
