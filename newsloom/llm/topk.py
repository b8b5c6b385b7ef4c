"""Exact top-k by inner product without random access.

Each dimension of a block of vectors is a sorted list; a query reads it from the end that adds most.
The lists are read in slices. Each slice's entries are added to the sums of the vectors they belong to,
and then every vector has a lower bound (what was read, plus the least the unread lists can add) and
an upper bound (plus what the lists' current positions can add). A query stops reading when no
outsider's upper bound reaches the k-th best lower bound, or the k-th best score that earlier blocks of
the task have left; then the final scores of those that may be among the best are resolved. Bounds of
all queries of a block are advanced together, so a slice is a few matrix products. A block's winners
meet in one ranked window per query with a rank limit before the shuffle.

Queries are taken in blocks of bounded bytes; each block passes over all vectors once, and vectors
are read in blocks of bounded rows, so no task holds a partition.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; rows
without an id neither; vectors of several dimensions are searched among those of their own; ties go to
the smaller id; rows that repeat an id are each a candidate of the other ids' queries, and the results
of the distinct vectors of a repeated query id are ranked together; no valid row gives an empty
result. Components so large that their sums would not be exact (beyond sqrt(2**53 / dimension) after
scaling) raise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.llm.common import finite_vector, matrix, written

BLOCK_ROWS = 8192
QUERY_BYTES = 32 << 20
QUERY_SLICE = 512


RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(id, vec) of the rows that take part."""
    fine = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("array<double>").alias("vec"))
    return fine.where(F.col("id").isNotNull() & finite_vector(F.col("vec")))


def by_dimension(fine: DataFrame, search: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The results of `search(vectors of one dimension, the dimension)` for every dimension there is."""
    dims = [r["dim"] for r in fine.select(F.size("vec").alias("dim")).distinct().orderBy("dim").collect()]
    parts = [search(fine.where(F.size("vec") == dim), dim) for dim in dims]
    out = parts[0] if parts else fine.sparkSession.createDataFrame([], RESULT)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def search_in_blocks(fine: DataFrame, dim: int, is_query: Column, k: int, search: Callable) -> DataFrame:
    """query_id, rank, vec_id, score: runs `search(query ids, query vectors, vector batches)` for each block of queries.

    `search` yields (query_id, vec_id, score) arrays for the vectors of one task. A block of queries
    is at most QUERY_BYTES, chosen by a hash of the id, so what the driver holds does not grow.
    """
    spark = fine.sparkSession
    queries = fine.where(is_query)
    blocks = max(1, -(-queries.count() * (dim + 1) * 8 // QUERY_BYTES))
    schema = "query_id bigint, vec_id bigint, score double"
    names = ["query_id", "vec_id", "score"]

    def block(number: int) -> DataFrame:
        found = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).distinct().toArrow().combine_chunks().sort_by("id")
        held = (found["id"].to_numpy(), matrix(found["vec"].combine_chunks(), dim)) if found.num_rows else (np.zeros(0, np.int64), np.zeros((0, dim)))
        shared = spark.sparkContext.broadcast(held)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vecs = shared.value
            if len(ids):
                for arrays in search(ids, vecs, batches):
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)

        return fine.mapInArrow(run, schema)

    if blocks == 1:
        return block(0)
    parts = [written(block(i), "top-k") for i in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best found per query, ties to the smaller id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def vector_blocks(batches: Iterable[pa.RecordBatch], dim: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at most `rows` rows, sorted by id."""
    held, count = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            if count and count + part.num_rows > rows:
                yield _joined(held)
                held, count = [], 0
            held.append((part.column(0).to_numpy(), matrix(part.column(1), dim)))
            count += part.num_rows
    if count:
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids, vecs = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    order = np.argsort(ids, kind="stable")
    return ids[order], vecs[order]


def merge_best(k: int, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class SortedLists:
    """The lists of one block of vectors: one per dimension, ascending. `read` and `entries` count for all queries."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray):
        self.ids, self.vecs = ids, vecs
        self.place = np.argsort(np.argsort(vecs, axis=0, kind="stable"), axis=0, kind="stable")
        self.values = np.sort(vecs, axis=0)
        self.read = self.entries = 0

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int, first_depth: float = 1 / 16, beaten: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(query number, ids, scores) of up to k best vectors per query; those that score below `beaten` may be missing."""
        n = len(self.ids)
        beaten = np.full(len(query_ids), -np.inf) if beaten is None else beaten
        up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T
        known = np.zeros((n, len(query_ids)))  # what the entries read so far add up to
        # What the lists that are unread for a vector add at least: at first all of them.
        floor = np.repeat((self.values[0] @ up + self.values[-1] @ down)[None, :], n, axis=0)
        self.entries += n * queries.shape[1] * len(query_ids)
        active, out, before, depth = np.arange(len(query_ids)), [], 0, max(1, int(n * first_depth))
        while len(active):
            depth = min(depth, n)
            # The slice that each list gives next, from its high end for positive weights, from its low end for others.
            high = (self.place >= n - depth) & (self.place < n - before)
            low = (self.place < depth) & (self.place >= before)
            u, d = up[:, active], down[:, active]
            known += (self.vecs * high) @ u + (self.vecs * low) @ d
            floor -= high @ (u * self.values[0][:, None]) + low @ (d * self.values[-1][:, None])
            self.read += (depth - before) * queries.shape[1] * len(active)
            before = depth
            own = self.ids[:, None] == query_ids[active][None, :]
            if depth == n:
                lower = upper = np.where(own, -np.inf, known)
            else:
                front_h, front_l = u * self.values[n - 1 - depth][:, None], d * self.values[depth][:, None]
                unread = (front_h.sum(0) + front_l.sum(0)) - ((self.place >= n - depth) @ front_h + (self.place < depth) @ front_l)
                upper = np.where(own, -np.inf, known + unread)
                lower = np.where(own, -np.inf, known + floor)
            kth = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(active), -np.inf)
            least = np.maximum(kth, beaten[active])
            # Those that may still be among the best. Reading stops when they are few: their scores are resolved.
            maybe = (upper >= least) & ~own
            stops = (maybe.sum(0) <= 4 * k) | (depth == n)
            for j in np.flatnonzero(stops):
                rows = np.flatnonzero(maybe[:, j])
                out.append((active[j], *merge_best(k, self.ids[rows], self.vecs[rows] @ queries[active[j]])))
            active, known, floor = active[~stops], known[:, ~stops], floor[:, ~stops]
            depth *= 2
        return out


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long) of the k best of floor(scale * x); `is_query` speaks of `id`."""

    def of_dimension(fine: DataFrame, dim: int) -> DataFrame:
        whole = fine.select("id", F.transform("vec", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("vec"))
        in_range = F.forall("vec", lambda x: F.abs(x) <= float(np.sqrt(2**53 / dim)))
        whole = whole.select("id", F.when(in_range, F.col("vec")).otherwise(F.raise_error(F.lit("a component is too large for exact sums"))).alias("vec"))

        def search(query_ids, queries, batches):
            best = [(np.zeros(0, np.int64), np.zeros(0))] * len(query_ids)
            for ids, vecs in vector_blocks(batches, dim, BLOCK_ROWS):
                lists = SortedLists(ids, vecs)
                for start in range(0, len(query_ids), QUERY_SLICE):
                    part = slice(start, start + QUERY_SLICE)
                    beaten = np.array([scores[-1] if len(scores) == k else -np.inf for _, scores in best[part]])
                    for j, found, scores in lists.top(query_ids[part], queries[part], k, beaten=beaten):
                        ids_so_far, scores_so_far = best[start + j]
                        best[start + j] = merge_best(k, np.concatenate([ids_so_far, found]), np.concatenate([scores_so_far, scores]))
            yield np.repeat(query_ids, [len(b[0]) for b in best]), np.concatenate([b[0] for b in best]), np.concatenate([b[1] for b in best])

        return search_in_blocks(whole, dim, is_query, k, search)

    found = by_dimension(valid_vectors(vectors, id_col, col), of_dimension)
    return ranked(found.select("query_id", "vec_id", "score"), k).withColumn("score", F.col("score").cast("long"))
