"""Full-text and vector search over the documents of one run.

The searchable document has ``id``, ``title`` and ``job_description`` (analyzed), ``skills`` (exact keywords) and
``job_description_embedding``. Text statistics are those of the whole run; request filters only choose documents.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TOKEN, bind, clean_strings, count_tokens, tokens
from .browse import PAGE_SIZE, newest_first, page_of
from .filters import apply_filters, has_description
from .ranking import rrf_fuse, top_per_group

# Field weights, BM25 constants, candidate counts, fusion constant.
BOOSTS = {"title": 4.0, "skills": 3.0, "job_description": 1.0}
K1, B = 1.2, 0.75
TEXT_CANDIDATES = 100
VECTOR_CANDIDATES = 100
RRF_K = 60
# Documents of a block's range, and the ranges that are scored first.
RANGE = 128
FIRST_RANGES = 16
# Bytes of text whose blocks one task builds and stores in one file.
SHARD_BYTES = 16 << 20
BLOCKS_OF_A_BATCH = 20_000
RESULT_COLUMNS = [
    "run_id", "company", "external_job_id", "title", "job_type", "job_level", "details_url", "apply_url", "locations",
]


def search_docs(jobs: DataFrame, details: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Documents to index: postings whose details point at a description, with its text and a run-wide id."""
    key = ["run_id", "company", "external_job_id"]
    described = (
        details.select(*key, "job_description_path")
        .join(jobs.where(~F.col("is_missing_details")), key)
        .where(has_description())
        .withColumn("job_description_path", F.trim("job_description_path"))
    )
    out = described.join(descriptions, "job_description_path").withColumnRenamed("description", "job_description")
    return (
        out.withColumn("skills", clean_strings(F.col("skills")))
        .withColumn("id", F.concat_ws(":", *key))
        .drop("version_ts", "updated_at", "is_missing_details", "job_description_path")
    )


# --- Inverted index ---------------------------------------------------------------------------


def _fields(docs: DataFrame) -> dict[str, Column]:
    """Terms of each field. Keywords count once per document and have no length norm."""
    return {
        "title": tokens(F.col("title")),
        "skills": F.array_distinct(clean_strings(F.col("skills"))),
        "job_description": tokens(F.col("job_description")),
    }


def _field_terms(docs: DataFrame, keep: dict[str, list[str]] | None) -> DataFrame:
    """(id, field, terms, dl), one row per field; ``keep`` drops all other terms before anything is exploded."""
    rows = [_field_row(field, terms, keep) for field, terms in _fields(docs).items()]
    return docs.select("id", F.explode(F.array(*rows)).alias("r")).select("id", "r.field", "r.terms", "r.dl")


def _field_row(field: str, terms: Column, keep: dict[str, list[str]] | None) -> Column:
    def build(t: Column) -> Column:
        kept = t if keep is None else _only(t, keep[field])
        return F.struct(F.lit(field).alias("field"), kept.alias("terms"), F.size(t).alias("dl"))

    return bind(terms, build)


def _only(terms: Column, wanted: list[str]) -> Column:
    return F.filter(terms, lambda t: t.isin(wanted))


def _counted(terms: Column) -> Column:
    """(term, tf) of the distinct terms of an array: runs of equal terms in the sorted array."""

    def entries(t: Column) -> Column:
        places = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        return bind(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(t, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(t)) - i).cast("bigint").alias("tf"))))

    return bind(F.sort_array(terms), entries)


def build_postings(docs: DataFrame, keep: dict[str, list[str]] | None = None) -> DataFrame:
    """(field, term, id, tf, dl). Terms of a document are counted in its own row: no shuffle."""
    return (
        _field_terms(docs, keep)
        .select("field", "id", "dl", F.explode(_counted(F.col("terms"))).alias("e"))
        .select("field", "e.term", "id", "dl", "e.tf")
    )


def _blocks(docs: DataFrame) -> DataFrame:
    """Postings in blocks: one row per field, term and range of ``RANGE`` documents, with the block's best tf and shortest dl.

    ``docs`` has doc_no. A range holds documents of similar length, so the two bound every score of the block closely. The texts of a
    range are brought together before their terms are counted: only texts are shuffled, and no posting. A task gets the terms of its
    documents as they are and counts and sorts them as numbers, so no posting is a row before its block is made.
    """
    size = docs.agg(F.sum(F.octet_length("job_description"))).first()[0] or 0
    placed = docs.select("id", F.expr(f"doc_no div {RANGE}").alias("range"), "title", "skills", "job_description")
    rows = placed.repartition(max(1, -(-size // SHARD_BYTES)), "range")
    terms = rows.select("id", "range", *[terms.alias(field) for field, terms in sorted(_fields(rows).items())])
    return terms.mapInArrow(_packed, T.StructType([
        T.StructField("term", T.StringType()), T.StructField("field", T.StringType()), rows.schema["range"],
        T.StructField("n", T.LongType()), T.StructField("max_tf", T.LongType()), T.StructField("min_dl", T.IntegerType()),
        T.StructField("postings", T.ArrayType(T.StructType([
            rows.schema["id"], T.StructField("dl", T.IntegerType()), T.StructField("tf", T.LongType())]))),
    ]))


def _packed(batches):
    """The blocks of a task's documents, in the order of (term, field, range); the postings of each in the order of their ids."""
    fields, held, docs, terms, n = sorted(BOOSTS), [], [], [], 0
    for batch in batches:
        docs.append(batch.select(["id", "range"]))
        for number, field in enumerate(fields):
            dl = pc.list_value_length(batch.column(field)).to_numpy(zero_copy_only=False).astype(np.int32)
            words = batch.column(field).flatten().dictionary_encode()
            wide = max(1, len(words.dictionary))
            # The occurrences of a document's term fall together; only the distinct ones are kept.
            own = np.repeat(np.arange(len(dl), dtype=np.int64), dl) * wide + words.indices.to_numpy()
            own, tf = np.unique(own, return_counts=True)
            terms.append(pa.DictionaryArray.from_arrays(pa.array((own % wide).astype(np.int32)), words.dictionary))
            held.append((own // wide + n, np.full(len(own), number, np.int8), tf.astype(np.int32), dl[own // wide]))
        n += batch.num_rows
    if not sum(len(t) for t in terms):
        return
    docs = pa.Table.from_batches(docs).combine_chunks()
    by_id = pc.sort_indices(docs, sort_keys=[("range", "ascending"), ("id", "ascending")]).to_numpy()
    ids, ranges = docs.column("id").take(by_id).combine_chunks(), docs.column("range").to_numpy()[by_id]
    terms = pa.chunked_array(terms).unify_dictionaries().combine_chunks()
    by_term = pc.sort_indices(terms.dictionary).to_numpy()
    vocabulary = terms.dictionary.take(pa.array(by_term))
    doc, field, tf, dl = [np.concatenate(parts) for parts in zip(*held)]
    del held
    # One number per posting: its term's place, its field, its document's place.
    key = (_places(by_term)[terms.indices.to_numpy()] * len(fields) + field) * n + _places(by_id)[doc]
    del terms, doc, field
    order = np.argsort(key)
    key, tf, dl = key[order], tf[order], dl[order]
    place = key % n
    key //= n
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (ranges[place[1:]] != ranges[place[:-1]])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(key))
    names = pa.array(fields)
    for at in range(0, len(starts), BLOCKS_OF_A_BATCH):
        first, stop = starts[at : at + BLOCKS_OF_A_BATCH], ends[at : at + BLOCKS_OF_A_BATCH]
        part, heads = slice(first[0], stop[-1]), first - first[0]
        entries = pa.StructArray.from_arrays(
            [ids.take(pa.array(place[part])), pa.array(dl[part]), pa.array(tf[part].astype(np.int64))], ["id", "dl", "tf"])
        offsets = pa.array(np.append(heads, stop[-1] - first[0]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [vocabulary.take(pa.array(key[first] // len(fields))), names.take(pa.array(key[first] % len(fields))),
             pa.array(ranges[place[first]]), pa.array(stop - first),
             pa.array(np.maximum.reduceat(tf[part], heads).astype(np.int64)), pa.array(np.minimum.reduceat(dl[part], heads)),
             pa.ListArray.from_arrays(offsets, entries)],
            names=["term", "field", "range", "n", "max_tf", "min_dl", "postings"],
        )


def _places(order: np.ndarray) -> np.ndarray:
    """The place of each row in an order of rows."""
    places = np.empty(len(order), dtype=np.int64)
    places[order] = np.arange(len(order))
    return places


def build_term_stats(postings: DataFrame) -> DataFrame:
    # Counting on ``tf`` keeps the input the same as for scoring, so both read one exchange.
    return postings.groupBy("field", "term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def build_field_stats(docs: DataFrame) -> DataFrame:
    """Per field: documents that have it, and the mean number of terms (one pass, one row per field)."""
    lengths = docs.select(
        count_tokens(F.col("title")).alias("title"),
        F.size(F.array_distinct(clean_strings(F.col("skills")))).alias("skills"),
        count_tokens(F.col("job_description")).alias("job_description"),
    )
    names = list(BOOSTS)
    totals = lengths.agg(
        *[F.count_if(F.col(n) > 0).alias(f"n_{n}") for n in names], *[F.sum(n).alias(f"s_{n}") for n in names]
    )
    rows = F.array(*[
        F.struct(
            F.lit(n).alias("field"), F.col(f"n_{n}").alias("n_docs"),
            F.try_divide(F.col(f"s_{n}"), F.col(f"n_{n}")).alias("avg_dl"),
        )
        for n in names
    ])
    return totals.select(F.explode(rows).alias("r")).select("r.*")


@dataclass
class SearchIndex:
    """The index tables of one run. ``of`` computes them from documents; requests are meant to use ``read``."""

    docs: DataFrame
    blocks: DataFrame | None
    field_stats: DataFrame
    term_stats: DataFrame | None = None

    @classmethod
    def of(cls, docs: DataFrame) -> SearchIndex:
        """An index computed on the fly: only the terms of a query are ever exploded, but every request reads all texts."""
        return cls(docs, None, build_field_stats(docs))

    def without_vectors(self) -> SearchIndex:
        return replace(self, docs=self.docs.drop("job_description_embedding"))

    @property
    def postings(self) -> DataFrame | None:
        """(field, term, id, tf, dl) of all blocks."""
        return None if self.blocks is None else _unpacked(self.blocks)

    def lookup(self, keep: dict[str, list[str]], ranges: DataFrame | None = None) -> DataFrame:
        """The postings of the wanted terms, of all documents or of those in some ``ranges`` (range)."""
        if self.blocks is None:
            return build_postings(self.docs, keep)
        # Each file of blocks is sorted by (term, field, range): the term list prunes its row groups and pages.
        found = self.blocks.where(_wanted(keep))
        return _unpacked(found if ranges is None else found.join(ranges, "range", "left_semi"))

    def frequencies(self, keep: dict[str, list[str]], rows: DataFrame) -> DataFrame:
        """(field, term, df) of the wanted terms: stored, else counted from their postings."""
        return build_term_stats(rows) if self.term_stats is None else self.term_stats.where(_wanted(keep))

    def write(self, path: str, docs_per_file: int = 1_000_000) -> None:
        """Store the tables. Documents are numbered by length within their task, so a range has similar ones and the documents are
        computed and written in one pass; a frequent term has a block per range."""
        spark = self.docs.sparkSession
        length = F.coalesce(F.length("job_description"), F.lit(0))
        numbered = self.docs.sortWithinPartitions(length, "id").withColumn("doc_no", F.monotonically_increasing_id())
        numbered.write.option("maxRecordsPerFile", docs_per_file).parquet(f"{path}/docs")
        stored = spark.read.parquet(f"{path}/docs")
        _blocks(stored).write.parquet(f"{path}/blocks")
        blocks = spark.read.parquet(f"{path}/blocks")
        blocks.groupBy("field", "term").agg(F.sum("n").alias("df")).repartitionByRange("field", "term").sortWithinPartitions(
            "field", "term").write.parquet(f"{path}/term_stats")
        build_field_stats(stored).write.parquet(f"{path}/field_stats")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SearchIndex:
        docs, *tables = [spark.read.parquet(f"{path}/{name}") for name in ("docs", "blocks", "field_stats", "term_stats")]
        return cls(docs.drop("doc_no"), *tables)


def _unpacked(blocks: DataFrame) -> DataFrame:
    return blocks.select("field", "term", F.explode("postings").alias("p")).select("field", "term", "p.id", "p.tf", "p.dl")


def _wanted(keep: dict[str, list[str]]) -> Column:
    every = sorted({term for terms in keep.values() for term in terms})
    match = F.lit(False)
    for field, terms in keep.items():
        match = match | ((F.col("field") == field) & F.col("term").isin(terms))
    return F.col("term").isin(every) & match


# --- Text match -------------------------------------------------------------------------------


def query_terms(query: str) -> dict[str, int]:
    return dict(Counter(regex.findall(TOKEN, query.lower())))


def _keep(query: str) -> dict[str, list[str]]:
    """The terms that a query looks for in each field."""
    counts = query_terms(query)
    return {"title": list(counts), "job_description": list(counts), "skills": [query.strip()]}


def _weights(index: SearchIndex, query: str, rows: DataFrame) -> DataFrame:
    """(field, term, weight, avg_dl): one row per query term and field, so a broadcast of it is bounded."""
    repeats = F.lit(1)
    for term, n in query_terms(query).items():
        if n > 1:
            repeats = F.when((F.col("field") != "skills") & (F.col("term") == term), F.lit(n)).otherwise(repeats)
    idf = F.log1p((F.col("n_docs") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    return (
        index.frequencies(_keep(query), rows)
        .join(F.broadcast(index.field_stats), "field")
        .select("field", "term", (idf * repeats).alias("weight"), "avg_dl")
    )


def _part(tf: Column, dl: Column) -> Column:
    """What one term adds to a field's score: it grows with tf and falls with dl."""
    norm = F.when(F.col("field") == "skills", F.lit(K1)).otherwise(
        F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / F.col("avg_dl"))
    )
    return F.col("weight") * tf * F.lit(K1 + 1) / (tf + norm)


def _best_field(parts: DataFrame, key: str) -> DataFrame:
    """(key, score): the best of the weighted sums of the fields."""
    sums = [
        (F.lit(boost) * F.coalesce(F.sum(F.when(F.col("field") == field, F.col("part"))), F.lit(0.0))).alias(field)
        for field, boost in BOOSTS.items()
    ]
    return parts.groupBy(key).agg(*sums).select(key, F.greatest(*BOOSTS).alias("score"))


def text_scores(index: SearchIndex, query: str, ranges: DataFrame | None = None) -> DataFrame:
    """(id, score): any term may match; a document scores the best of its weighted BM25 fields.

    The shuffled rows are the postings of the query's terms; without a stored index they are counted for the document frequencies
    and scored from the same exchange. ``ranges`` keeps the documents of some ranges of a stored index.
    """
    rows = index.lookup(_keep(query), ranges)
    weights = _weights(index, query, rows)
    scored = rows.join(F.broadcast(weights), ["field", "term"]).select("id", "field", _part(F.col("tf"), F.col("dl")).alias("part"))
    return _best_field(scored, "id")


def range_bounds(index: SearchIndex, query: str) -> DataFrame:
    """(range, score, blocks): the greatest score that a document of each range can have, from the heads of the blocks alone."""
    heads = index.blocks.where(_wanted(_keep(query))).select("field", "term", "range", "max_tf", "min_dl")
    parts = heads.join(F.broadcast(_weights(index, query, heads)), ["field", "term"]).select(
        "range", "field", _part(F.col("max_tf"), F.col("min_dl")).alias("part"))
    return _best_field(parts, "range")


def hopeful_ranges(index: SearchIndex, query: str, k: int, **filters) -> DataFrame:
    """(range): the ranges that can hold one of the ``k`` best documents; the blocks of all others need not be read.

    The ranges with the highest bounds are scored first. The k-th score among their documents that pass the filters is reached by k
    documents, so a range whose bound is below it has none of the best. With fewer documents than that, every range stays.
    """
    bounds = range_bounds(index, query)
    first = bounds.orderBy(F.col("score").desc(), "range").limit(max(FIRST_RANGES, -(-4 * k // RANGE)))
    found = apply_filters(index.docs, **filters).select("id").join(text_scores(index, query, first.select("range")), "id")
    kth = [r["score"] for r in found.orderBy(F.col("score").desc()).limit(k).select("score").collect()]
    least = kth[-1] if len(kth) == k else 0.0
    # Sums of the same parts in another order may differ in the last places.
    return bounds.where(F.col("score") >= least * (1 - 1e-9)).select("range")


def text_hits(index: SearchIndex, query: str, ranges: DataFrame | None = None, **filters) -> DataFrame:
    """Matching documents that pass the filters, with their score."""
    return apply_filters(index.docs, **filters).join(text_scores(index, query, ranges), "id")


def text_top(index: SearchIndex, query: str, k: int = TEXT_CANDIDATES, **filters) -> DataFrame:
    """The ``k`` best documents; of a stored index only the blocks of hopeful ranges are read."""
    slim = index.without_vectors()
    ranges = None if index.blocks is None else hopeful_ranges(slim, query, k, **filters)
    hits = text_hits(slim, query, ranges, **filters).select("id", "posted_ts", "score", _shown(slim.docs))
    return _numbered(hits.orderBy(F.col("score").desc(), F.col("id").asc()).limit(k))


def _shown(docs: DataFrame) -> Column:
    """What a result page shows of a document. It stays with the candidates, so documents are not read again."""
    shown = [name for name in RESULT_COLUMNS if name in docs.columns]
    return F.struct(*shown).alias("doc") if shown else F.lit(None).alias("doc")


def _numbered(top: DataFrame) -> DataFrame:
    """Rank of at most a candidate list of rows."""
    return top_per_group(top.withColumn("_all", F.lit(1)), ["_all"], [F.col("score").desc(), F.col("id").asc()],
                         2**31 - 1, "rank").drop("_all")


# --- Vector search ----------------------------------------------------------------------------


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity in double precision, NULL for an empty or zero vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    add = lambda acc, x: acc + x
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), add)
    norm = F.sqrt(F.aggregate(F.transform(v, lambda a: a * a), F.lit(0.0), add))
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    return F.try_divide(dot, norm * F.lit(length))


def vector_top(docs: DataFrame, query: list[float], k: int = VECTOR_CANDIDATES, **filters) -> DataFrame:
    """The ``k`` nearest documents by cosine among those that pass the filters: an exact scan and a top-k."""
    if not query:
        return docs.limit(0).select("id", "posted_ts", F.lit(0.0).alias("score"), _shown(docs), F.lit(0).alias("rank"))
    scored = (
        apply_filters(docs, **filters)
        .where(F.size("job_description_embedding") == len(query))
        .select("id", "posted_ts", cosine(F.col("job_description_embedding"), query).alias("score"), _shown(docs))
        .where(F.col("score").isNotNull())
    )
    return _numbered(scored.orderBy(F.col("score").desc(), F.col("id").asc()).limit(k))


def vector_top_batch(docs: DataFrame, queries: DataFrame, k: int, chunk: int = 512, slice_rows: int = 16_384) -> DataFrame:
    """Exact (query_id, id, score, rank) for a table of queries (query_id, embedding).

    Queries and documents are cut into blocks by a hash; each block of queries meets each slice of the documents in one task,
    as a matrix product that keeps its own ``k`` best per query. No query passes through the driver, and the plan
    has the same size for any number of queries.
    """
    vectors = docs.where(F.size("job_description_embedding") > 0).select(
        "id", F.col("job_description_embedding").cast("array<double>").alias("v"))
    asked = queries.where(F.size("embedding") > 0).select("query_id", F.col("embedding").cast("array<double>").alias("v"))
    blocks = max(1, math.ceil(asked.count() / chunk))
    slices = max(1, math.ceil(vectors.count() / slice_rows))
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("id", docs.schema["id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumns({"block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")}).withColumn("slice", every(slices))
    right = vectors.withColumns({"slice": F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")}).withColumn("block", every(blocks))
    keys = ("block", "slice")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_nearest(k), schema)
    return top_per_group(found, ["query_id"], [F.col("score").desc(), F.col("id").asc()], k, "rank")


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1, norms)


def _nearest(k: int):
    def run(queries, vectors):
        rows = []
        # Vectors meet queries of their own length.
        lengths = vectors["v"].map(len)
        for size, asked in queries.groupby(queries["v"].map(len)):
            near = vectors[lengths == size]
            if near.empty:
                continue
            scores = _unit(np.array(asked["v"].tolist())) @ _unit(np.array(near["v"].tolist())).T
            ids = near["id"].to_numpy()
            for name, own in zip(asked["query_id"], scores):
                # Ties at the k-th score all stay; the final ranking settles them by id.
                cut = np.partition(own, -k)[-k] if len(own) > k else -np.inf
                kept = pd.DataFrame({"query_id": name, "id": ids[own >= cut], "score": own[own >= cut]})
                rows.append(kept.sort_values(["score", "id"], ascending=[False, True], kind="stable").head(k))
        if rows:
            return pd.concat(rows, ignore_index=True)
        return queries[:0][["query_id"]].assign(id=vectors[:0]["id"].astype(object), score=0.0)

    return run


# --- Requests ---------------------------------------------------------------------------------


def _candidates(index: SearchIndex, query: str, vector: list[float], k: int, filters: dict) -> DataFrame:
    return rrf_fuse([text_top(index, query, k, **filters), vector_top(index.docs, vector, k, **filters)], RRF_K)


def search_relevance(
    index: SearchIndex, query: str, vector: list[float], page: int = 1, size: int = PAGE_SIZE, k: int = TEXT_CANDIDATES, **filters
) -> DataFrame:
    """One page of the fused candidates, best first: the ``k`` best by text and the ``k`` best by vector.

    Pages end with the candidates, at most 2 ``k`` rows; a larger ``k`` reaches further.
    """
    return page_of(_candidates(index, query, vector, k, filters), page, size).select("id", "score", "posted_ts", "doc.*")


def fused_total(index: SearchIndex, query: str, vector: list[float], k: int = TEXT_CANDIDATES, **filters) -> DataFrame:
    """The number of fused candidates, which is what can be paged through; not the number of matches."""
    return _candidates(index, query, vector, k, filters).agg(F.count("*").alias("total_results"))


def search_recency(index: SearchIndex, query: str, page: int = 1, size: int = PAGE_SIZE, **filters) -> DataFrame:
    """Documents that match the text at all, newest first."""
    slim = index.without_vectors()
    matched = apply_filters(slim.docs, **filters).join(text_matches(slim, query), "id", "left_semi")
    return page_of(newest_first(matched), page, size)


def text_matches(index: SearchIndex, query: str) -> DataFrame:
    """Ids of the documents in which any term matches; no statistics are needed."""
    keep = _keep(query)
    if index.blocks is not None:
        return index.lookup(keep).select("id").distinct()
    hit = F.lit(False)
    for field, terms in _fields(index.docs).items():
        hit = hit | F.arrays_overlap(terms, F.array(*[F.lit(t) for t in keep[field]]).cast("array<string>"))
    return index.docs.where(hit).select("id")


def query_embedding(vectors: DataFrame, key: str, value) -> list[float]:
    """The stored vector of a query; an unknown query has an empty one."""
    row = vectors.where(F.col(key) == value).select("embedding").first()
    return [] if row is None or row["embedding"] is None else [float(x) for x in row["embedding"]]
