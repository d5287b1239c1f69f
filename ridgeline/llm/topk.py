"""Exact top-k inner products with Fagin's threshold algorithm.

Rows are read in blocks.  A block keeps, for each dimension, its rows sorted by value.  For a query the lists are walked side by
side, from the end that the sign of the query's component favours; every row met is scored in full.  The sum of the query's
components times the values at the present depth bounds the score of all rows not met yet, and the walk stops as soon as it is below
the k-th score, which is carried from block to block.  Queries come in blocks of bounded size, each meeting all rows once; the few
best of every task are merged by query.
"""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ridgeline.session import staged

K = 10
SCALE = 1024
BLOCK_ROWS = 8192
BLOCK_QUERIES = 4096
FIRST_DEPTH = 16


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if the vector is null or holds a null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class Block:
    """Rows of one block with a list of row numbers per dimension in order of value."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.lists = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32)
        self.most = int(np.abs(self.rows).max(initial=0))
        self.exact = self.rows.astype(np.float64)

    def scores(self, which, query):
        if self.most * int(np.abs(query).max(initial=0)) * max(1, len(query)) < 1 << 53:
            return (self.exact[which] @ query.astype(np.float64)).astype(np.int64)  # all sums are exact in doubles
        return self.rows[which] @ query

    def search(self, query_id, query, k, best):
        """The k best (score, id) of `best` and this block: largest score first, ties to the smaller id."""
        n, use = len(self.ids), np.flatnonzero(query)
        if not len(use):
            use = np.arange(min(1, len(query)))
        lists, weight = self.lists[use], query[use]
        lists = np.where((weight > 0)[:, None], lists[:, ::-1], lists) if n else lists
        met, low, depth = np.zeros(n, bool), 0, FIRST_DEPTH
        while low < n:
            high = min(n, low + depth)
            seen = np.zeros(n, bool)
            seen[lists[:, low:high].ravel()] = True
            new = np.flatnonzero(seen & ~met)
            met |= seen
            score, ids = self.scores(new, query), self.ids[new]
            other = ids != query_id
            score, ids = np.concatenate([best[0], score[other]]), np.concatenate([best[1], ids[other]])
            top = np.lexsort((ids, -score))[:k]
            best = score[top], ids[top]
            bound = sum(int(w) * int(v) for w, v in zip(weight, self.rows[lists[:, high - 1], use]))
            if len(best[0]) == k and best[0][-1] > bound:
                break
            low, depth = high, depth * 2
        return best


def _blocks(batches):
    """Blocks of rows with an equal number of components."""
    waiting = {}
    for batch in batches:
        ids = batch.column("vec_id").to_numpy()
        vectors = batch.column("vector")
        sizes = vectors.value_lengths().to_numpy()
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            rows = vectors.take(pa.array(which)).flatten().to_numpy(zero_copy_only=False).reshape(len(which), size)
            held = waiting.setdefault(int(size), [])
            held.append((ids[which], rows))
            if sum(len(i) for i, _ in held) >= BLOCK_ROWS:
                yield Block(*map(np.concatenate, zip(*held)))
                held.clear()
    for held in waiting.values():
        if held:
            yield Block(*map(np.concatenate, zip(*held)))


def _search(batches, queries, k):
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    best = [none] * len(queries)
    for block in _blocks(batches):
        for n, (query_id, query) in enumerate(queries):
            if len(query) == block.rows.shape[1]:
                best[n] = block.search(query_id, query, k, best[n])
    sizes = [len(ids) for _, ids in best]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.array([q for q, _ in queries], np.int64), sizes)),
         pa.array(np.concatenate([none[1], *(ids for _, ids in best)])), pa.array(np.concatenate([none[0], *(s for s, _ in best)]))],
        ["query_id", "vec_id", "score"])


def _query_blocks(queries: DataFrame, size: int):
    block = []
    for row in queries.toLocalIterator():
        block.append((row["vec_id"], np.array(row["vector"], np.int64)))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query, ties to the smaller vec_id.

    Both tables have (vec_id, vector array<long>); rows with a null id or vector have no part, a query never meets rows of its own
    id, and only vectors with as many components as the query are compared.  A vec_id given twice is one query (its smallest vector)
    but two candidates.  Empty tables give an empty result.
    """
    usable = "vec_id is not null and vector is not null"
    rows = vectors.select("vec_id", "vector").where(usable)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for block in _query_blocks(queries.where(usable).groupBy("vec_id").agg(F.min("vector").alias("vector")), block_queries):
        near = rows.mapInArrow(partial(_search, queries=block, k=k), "query_id long, vec_id long, score long")
        # written, so that the driver lets go of the block
        found = found.unionByName(staged(near.withColumn("rank", rank).where(F.col("rank") <= k)))
    return found


def nearest(embeddings: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """top_k of embeddings(vec_id, embedding, ...) for the rows whose vec_id is divisible by `every`, against all rows."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("vector"))
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)
