"""Approximate nearest neighbours: stable projections in a kd-tree, and a chi-square stopping test.

Nearness is the inner product. With one more component, sqrt(M*M - |x|*|x|) for the largest norm M,
it becomes the Euclidean distance, whose few Gaussian (2-stable) projections keep it in this sense:
projected over true squared distance follows a chi-square law. A block of vectors is indexed as a
kd-tree of its projections. All queries of a task advance together, a leaf each at a time, and those
in one leaf share its matrix products. A query visits leaves in the order of their projected distance and, in
them, verifies on the original components the vectors that the test leaves open: one is passed over
when its projected distance is so far that a vector nearer than the current k-th best would be there
with a probability of at most 1 - `certainty`. The search of a block ends when that holds for all
leaves that are left. The k best so far are carried from block to block of a task.

A score is the sum of the products in the order of the components, and so the same bits wherever a
vector lies; matrix products only decide which vectors are summed up so, with a margin for their error.

Every row is indexed; nothing is fitted on a sample. The projection is drawn from a seed.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors of several dimensions are searched among those of their own; ties go to the smaller id;
a repeated id is a candidate per row and never its own neighbour; no valid row gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.topk import by_dimension, ranked, search_in_blocks, valid_vectors, vector_blocks

BLOCK_ROWS = 32768
LEAF_ROWS = 64
QUERY_SLICE = 2048


def chi_square_quantile(p: float, freedom: int) -> float:
    """By bisection on the regularised lower gamma function."""

    def below(x: float) -> float:
        a, half = freedom / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= half / n
            total += term
        return total * math.exp(-half + a * math.log(half) - math.lgamma(a))

    low, high = 1e-12, 10.0 * freedom + 100
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


class ProjectedTree:
    """kd-tree over projections; leaves are slices of one order, with the boxes of their points."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.leaves: list[tuple[int, int]] = []
        waiting = [(0, len(points))]
        while waiting:
            start, end = waiting.pop()
            if end - start <= leaf_rows:
                self.leaves.append((start, end))
                continue
            part = self.order[start:end]
            spread = np.ptp(points[part], axis=0)
            middle = (end - start) // 2
            self.order[start:end] = part[np.argpartition(points[part, int(spread.argmax())], middle)]
            waiting += [(start + middle, end), (start, start + middle)]
        self.starts = np.array([a for a, _ in self.leaves])
        self.sizes = np.array([b - a for a, b in self.leaves])
        self.low = np.stack([points[self.order[a:b]].min(0) for a, b in self.leaves])
        self.high = np.stack([points[self.order[a:b]].max(0) for a, b in self.leaves])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each leaf's box."""
        total = np.zeros((len(points), len(self.leaves)))
        for j in range(points.shape[1]):
            x = points[:, j : j + 1]
            total += np.maximum(np.maximum(self.low[:, j] - x, x - self.high[:, j]), 0) ** 2
        return total


def exact_scores(queries: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up component by component."""
    return np.cumsum(queries * vecs, axis=1)[:, -1] if len(vecs) else np.zeros(0)


@dataclass
class Search:
    """What a block of queries knows while it goes through the vectors of a task."""

    ids: np.ndarray
    queries: np.ndarray
    projected: np.ndarray
    largest: float
    k: int
    limit: float

    def __post_init__(self):
        self.norms = np.linalg.norm(self.queries, axis=1)
        self.margin = 4 * self.queries.shape[1] * 2.0**-53 * self.norms * self.largest
        self.best_ids = np.full((len(self.ids), self.k), -1, np.int64)
        self.best_scores = np.full((len(self.ids), self.k), -np.inf)
        self.verified = self.met = 0

    def block(self, ids: np.ndarray, vecs: np.ndarray, projected: np.ndarray) -> None:
        """Improves each query's k best (best first) by a block of vectors."""
        tree = ProjectedTree(projected)
        ids, vecs, projected = ids[tree.order], vecs[tree.order], projected[tree.order]
        squares = (projected**2).sum(1)
        self.met += len(ids) * len(self.ids)
        for start in range(0, len(self.ids), QUERY_SLICE):
            part = np.arange(start, min(start + QUERY_SLICE, len(self.ids)))
            away = tree.distances(self.projected[part])
            visits = np.argsort(away, axis=1, kind="stable")
            away = np.take_along_axis(away, visits, axis=1)
            active = np.arange(len(part))
            for step in range(visits.shape[1]):
                active = active[away[active, step] <= self.limit * self._kth_distance(part[active])]
                if not len(active):
                    break
                leaf_of = visits[active, step]
                by = np.argsort(leaf_of, kind="stable")
                self._visit(part[active[by]], leaf_of[by], tree, ids, vecs, projected, squares)

    def _kth_distance(self, group: np.ndarray) -> np.ndarray:
        """Squared distance of the k-th best so far; infinite while fewer than k are known."""
        return np.maximum(self.norms[group] ** 2 + self.largest**2 - 2 * self.best_scores[group, -1], 1e-12)

    def _visit(self, group, leaf_of, tree, ids, vecs, projected, squares) -> None:
        """Each query of the group meets the vectors of its leaf; the queries come by leaf, the vectors in the order of the tree."""
        starts, sizes = tree.starts[leaf_of], tree.sizes[leaf_of]
        place = np.arange(tree.sizes.max())
        rows = np.minimum(starts[:, None] + place, len(ids) - 1)
        queries, twice = self.queries[group], 2 * self.projected[group]
        about, away = np.empty(rows.shape), np.empty(rows.shape)
        cuts = np.flatnonzero(np.diff(leaf_of)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)]):
            start, size = starts[a], sizes[a]
            about[a:b, :size] = queries[a:b] @ vecs[start : start + size].T
            away[a:b, :size] = twice[a:b] @ projected[start : start + size].T
        away = (self.projected[group] ** 2).sum(1)[:, None] + squares[rows] - away
        near = (place < sizes[:, None]) & (away <= (self.limit * self._kth_distance(group))[:, None])
        near &= self.ids[group][:, None] != ids[rows]
        self.verified += int(near.sum())
        near &= about >= (self.best_scores[group, -1] - self.margin[group])[:, None]
        i, j = np.nonzero(near)
        if len(i):
            found = rows[i, j]
            self._improve(group, i, ids[found], exact_scores(queries[i], vecs[found]))

    def _improve(self, group, i, ids, scores) -> None:
        """Merges vectors found into the k best of the queries numbered i (ascending) in the group."""
        touched, first, counts = np.unique(i, return_index=True, return_counts=True)
        for few in (counts <= 4, counts > 4):  # most queries find few in a leaf
            some = touched[few]
            if not len(some):
                continue
            width = np.arange(counts[few].max())
            at, there = first[few][:, None] + width, width < counts[few][:, None]
            at = np.where(there, at, 0)
            all_scores = np.hstack([self.best_scores[group[some]], np.where(there, scores[at], -np.inf)])
            all_ids = np.hstack([self.best_ids[group[some]], ids[at]])
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
            self.best_scores[group[some]] = np.take_along_axis(all_scores, order, axis=1)
            self.best_ids[group[some]] = np.take_along_axis(all_ids, order, axis=1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, projections: int = 16, certainty: float = 0.95, seed: int = 11, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found; `is_query` speaks of `id`."""

    def of_dimension(fine: DataFrame, dim: int) -> DataFrame:
        square = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x)
        largest = math.sqrt(fine.agg(F.max(square)).first()[0] or 0.0)
        axes = np.random.default_rng(seed).normal(size=(dim + 1, projections))
        # Vectors with a squared projected distance of over `limit` times the k-th true one are passed over.
        limit = chi_square_quantile(certainty, projections)

        def search(query_ids, queries, batches):
            state = Search(query_ids, queries, queries @ axes[:dim], largest, k, limit)
            for ids, vecs in vector_blocks(batches, dim, BLOCK_ROWS):
                rest = np.sqrt(np.maximum(largest**2 - (vecs * vecs).sum(1), 0))
                state.block(ids, vecs, vecs @ axes[:dim] + rest[:, None] * axes[dim])
            known = state.best_scores > -np.inf
            yield np.repeat(query_ids, known.sum(1)), state.best_ids[known], state.best_scores[known]

        return search_in_blocks(fine, dim, is_query, k, search)

    fine = valid_vectors(vectors, id_col, col).where(F.exists("vec", lambda x: x != 0))
    return ranked(by_dimension(fine, of_dimension).select("query_id", "vec_id", "score"), k)


__all__ = ["ProjectedTree", "Search", "chi_square_quantile", "exact_scores", "nearest"]
