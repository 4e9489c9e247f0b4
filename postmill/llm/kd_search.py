"""Exact top-k inner products with a KD-tree per shard.

Vectors are dealt to shards by a hash of their id. A shard's tree splits at the median of its widest component and keeps a
tight bounding box per node. A query walks a tree best-first: the box-to-query bound of a node is the largest inner product
that a vector in its box can have, and the walk ends when the best bound left cannot reach the query's k-th score. Queries
first meet one shard each; the k-th score found there goes with them to all other shards and prunes these from the start.

A task holds one tree and one block of queries. Only the stated queries meet all rows, block by block.

Defined results: ids or vectors that are null, and vectors with a null or non-finite component, take no part; rows of
the query's id are no candidates, and rows with one id are one query; vectors of different lengths do not meet, and empty ones score 0; scores are 64-bit.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

SHARD_ROWS = 8192
LEAF_ROWS = 128
BLOCK_QUERIES = 512
QUERY_STEP = 50
SCALE = 256
# Sums below this are exact in doubles; larger ones are made in integers.
EXACT = float(1 << 53)
_NONE = -(1 << 63)


def integer_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, dim, v): floor(256 x) of the vectors that take part."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (
        rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(~F.coalesce(bad, F.lit(False)))
        .select(
            F.col("vec_id").cast("bigint"), F.size("embedding").alias("dim"),
            F.transform(whole, lambda x: F.floor(x * SCALE).cast("bigint")).alias("v"),
        )
    )


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), dim)


def grow_tree(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS) -> dict:
    """A tree in heap order: node n has the children 2n + 1 and 2n + 2; boxes, least ids and row ranges per node."""
    n, dim = vectors.shape
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    nodes = 2 ** (depth + 1) - 1
    order = np.arange(n)
    bounds = np.zeros((nodes, 2), dtype=np.int64)
    low, high = np.zeros((nodes, dim), dtype=np.int64), np.zeros((nodes, dim), dtype=np.int64)
    least = np.zeros(nodes, dtype=np.int64)
    bounds[0] = (0, n)
    for node in range(nodes):
        a, b = bounds[node]
        if a == b:
            continue
        part = vectors[order[a:b]]
        low[node], high[node] = part.min(axis=0), part.max(axis=0)
        least[node] = ids[order[a:b]].min()
        if 2 * node + 1 < nodes:
            middle = (a + b) // 2
            if dim:
                widest = int(np.argmax(high[node].astype(np.float64) - low[node]))
                order[a:b] = order[a:b][np.argpartition(part[:, widest], middle - a if middle < b else 0)]
            bounds[2 * node + 1], bounds[2 * node + 2] = (a, middle), (middle, b)
    return {"ids": ids[order], "vectors": vectors[order], "bounds": bounds, "low": low, "high": high, "least": least}


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of both."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if reach < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product that a vector in each box can have with each query."""
    return _product(np.maximum(queries, 0), high) + _product(np.minimum(queries, 0), low)


def search_tree(tree: dict, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int):
    """Best ``k`` (query row, id, score) of each query that reach its floor; ties go to the smaller id."""
    out = []
    bounds = tree["bounds"]
    reach = box_bounds(queries, tree["low"], tree["high"])
    leaves = len(bounds) // 2
    for q in range(len(queries)):
        best = []  # the worst of the k best on top: (score, -id)
        floor = int(floors[q])
        ahead = [(-int(reach[q, 0]), 0)]
        while ahead:
            bound, node = heapq.heappop(ahead)
            bound = -bound
            if bound < floor or (len(best) == k and bound < best[0][0]):
                break
            a, b = bounds[node]
            # Equal scores only count with a smaller id.
            if a == b or (len(best) == k and bound == best[0][0] and -int(tree["least"][node]) <= best[0][1]):
                continue
            if node < leaves:
                for child in (2 * node + 1, 2 * node + 2):
                    heapq.heappush(ahead, (-int(reach[q, child]), child))
                continue
            scores = _product(queries[q : q + 1], tree["vectors"][a:b])[0]
            least = max(floor, best[0][0]) if len(best) == k else floor
            for i in np.flatnonzero(scores >= least):
                vec_id = int(tree["ids"][a + i])
                if vec_id == query_ids[q]:
                    continue
                entry = (int(scores[i]), -vec_id)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        out.extend((q, -negative, score) for score, negative in best)
    return out


_TREE = "dim int, shard int, ids binary, vectors binary, bounds binary, low binary, high binary, least binary"
_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _build(key, table):
    dim, shard = key[0].as_py(), key[1].as_py()
    tree = grow_tree(np.asarray(table.column("vec_id"), dtype=np.int64), _matrix(table.column("v"), dim))
    parts = {name: pa.array([np.ascontiguousarray(tree[name]).tobytes()], pa.binary()) for name in tree}
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()),
                     **{n: parts[n] for n in ("ids", "vectors", "bounds", "low", "high", "least")}})


def _searcher(k: int):
    def run(key, trees, queries):
        dim = key[0].as_py()
        rows = []
        ids = np.asarray(queries.column("query_id"), dtype=np.int64)
        for row in trees.select(["ids", "vectors", "bounds", "low", "high", "least"]).to_pylist() if len(ids) else []:
            tree = {name: np.frombuffer(row[name], dtype=np.int64) for name in row}
            for name, width in (("vectors", dim), ("low", dim), ("high", dim), ("bounds", 2)):
                tree[name] = tree[name].reshape(-1 if width else len(tree["ids"] if name == "vectors" else tree["least"]), width)
            found = search_tree(tree, ids, _matrix(queries.column("v"), dim), np.asarray(queries.column("floor")), k)
            rows += [(int(ids[q]), vec_id, score) for q, vec_id, score in found]
        names = ("query_id", "vec_id", "score")
        return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})

    return run


def search(rows: DataFrame, k: int = 5, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for each row whose id is divisible by ``step``."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows)
    is_query = F.col("vec_id") % step == 0
    total, asked = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    shards = max(1, -(-total // SHARD_ROWS))
    blocks = max(1, -(-asked // BLOCK_QUERIES))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    where = scratch_path(spark, "kd-trees")
    dealt.groupBy("dim", "shard").applyInArrow(_build, _TREE).write.parquet(where)
    trees = spark.read.parquet(where)
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")
    queries = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "dim", "v", block.alias("block"))
    # Each block meets one shard first, another one for each block.
    home = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    first = _meet(
        trees, queries.withColumns({"shard": home, "floor": F.lit(_NONE)}), blocks, k,
        only=lambda t: F.pmod(F.col("block"), F.lit(shards)) == t,
    )
    first_at = scratch_path(spark, "kd-first")
    first.write.parquet(first_at)
    first = spark.read.parquet(first_at)
    kth = first.groupBy("query_id").agg(F.min("score").alias("_kth"), F.count("*").alias("_n"))
    floors = queries.join(kth, "query_id", "left").withColumn(
        "floor", F.when(F.col("_n") >= k, F.col("_kth")).otherwise(F.lit(_NONE))
    ).drop("_kth", "_n")
    others = floors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
    rest = _meet(trees, others, blocks, k, only=lambda t: F.pmod(F.col("block"), F.lit(shards)) != t)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _meet(trees: DataFrame, queries: DataFrame, blocks: int, k: int, only) -> DataFrame:
    """Every tree with the blocks of queries that are to meet it."""
    copies = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where(only(F.col("shard")))
    keys = ("dim", "shard", "block")
    return copies.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_searcher(k), _FOUND)


SQL = """
WITH valid AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]), 0) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
WHERE rank <= 5
"""
