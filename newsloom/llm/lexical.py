"""Ranked lexical search of all documents, term at a time first and document at a time then.

Every document is split once; what goes on is its length and its postings (term number, occurrences)
of the terms that any item of the block asks for, as a written table. Counts of documents and terms
come from that table. Then each task inverts bounded blocks of documents into lists by term, with
exact integer impacts. For an item and a block:

- its short lists, as many as fit a share of the block, are summed into accumulators (term at a time);
- the accumulators become one iterator with a bound, beside the long lists with theirs; the k-th largest
  value of any of them is a score that the k best reach at least;
- windows of documents are then walked in ascending order (document at a time). Iterators whose
  bounds add up to less than the current k-th score propose no documents: they are only looked up,
  by search and not by scan, for documents that can still reach it; a window whose own bounds stay
  below it is skipped.

The k best of an item are carried from block to block of a task, so later blocks skip more. Tasks'
winners meet in ranked windows, first by groups of tasks, then per item.

Items are taken in blocks of bounded text by a hash of their id; each block passes over the documents
once. The driver holds one block's terms and their document counts.

Defined results: a null or empty text has no term; an item without terms, or whose terms occur
nowhere, has no rows; rows with a null item_id ask nothing; the terms of rows that repeat an
item_id are one item's; documents with a null doc_id count in the statistics but are not ranked; rows
that repeat a doc_id are documents of their own; equal scores stand by ascending doc_id; empty tables
give an empty result; other columns are ignored. An item's text is a query: one of any length works,
but its terms have to fit the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from newsloom.llm.common import written

RESULT = "item_id bigint, rank int, doc_id bigint, score bigint"

# Upper-case A-Z to lower case, other ASCII letters and digits as they are, other ASCII to blanks; bytes above ASCII stay.
_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


@dataclass(frozen=True)
class SearchOptions:
    """`short_share`: postings of the lists summed first, as a share of a block's documents."""

    k: int = 50
    short_share: float = 0.5
    block_documents: int = 32_768
    block_postings: int = 2_000_000
    window: int = 4096
    item_bytes: int = 8 << 20


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


@dataclass(frozen=True)
class Statistics:
    """N documents with a term, L terms in all, and the weight of each term number."""

    documents: int
    length: int
    weights: np.ndarray

    def lengths(self, n: np.ndarray) -> np.ndarray:
        return 100 - 50 + (50 * n * self.documents) // self.length


def weight(documents: int, held_by: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held_by + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


# --- one block of documents -------------------------------------------------------------------


def better(k: int, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Block:
    """Inverted lists of a block of documents in ascending doc_id; impacts are exact."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, counts: np.ndarray, term: np.ndarray, tf: np.ndarray, stats: Statistics):
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        self.ids = ids[order]
        place = np.repeat(rank, counts)
        scores = impacts(stats.weights[term], tf, np.repeat(stats.lengths(n), counts))
        by = np.lexsort((place, term))
        by = by[scores[by] > 0]
        self.places, self.scores = place[by], scores[by]
        held, first = np.unique(term[by], return_index=True)
        ends = np.append(first[1:], len(by))
        tops = np.maximum.reduceat(self.scores, first) if len(by) else first
        self.lists = {int(t): (int(a), int(b), int(top)) for t, a, b, top in zip(held, first, ends, tops)}
        self._kth: dict[int, int] = {}
        self.opened = self.postings = 0  # postings that were touched, and those of all lists asked for

    def kth(self, term: int, k: int) -> int:
        """The k-th largest impact of a list, which its k-th document's score cannot stay below."""
        if term not in self._kth:
            a, b, _ = self.lists[term]
            self._kth[term] = int(np.partition(self.scores[a:b], b - a - k)[b - a - k]) if b - a >= k else 0
        return self._kth[term]

    def search(self, asked: np.ndarray, best: tuple[np.ndarray, np.ndarray], options: SearchOptions) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) among `best` and this block's documents."""
        held_terms = [t for t in asked.tolist() if t in self.lists]
        lists = sorted((self.lists[t] for t in held_terms), key=lambda x: x[1] - x[0])
        # k documents reach these already, whatever else they hold.
        floor = max([1, *(self.kth(t, options.k) for t in held_terms)])
        self.postings += sum(b - a for a, b, _ in lists)
        room, short = options.short_share * len(self.ids), 0
        while short < len(lists) and room >= lists[short][1] - lists[short][0]:
            room -= lists[short][1] - lists[short][0]
            short += 1
        # Term at a time: one summed iterator (places, scores, bound) from all short lists.
        iterators = [(self.places[a:b], self.scores[a:b], top) for a, b, top in lists[short:]]
        if short:
            summed = np.zeros(len(self.ids), np.int64)
            for a, b, _ in lists[:short]:
                summed[self.places[a:b]] += self.scores[a:b]
                self.opened += b - a
            held = np.flatnonzero(summed)
            iterators.append((held, summed[held], int(summed.max())))
            if len(held) >= options.k:
                floor = max(floor, int(np.partition(summed[held], len(held) - options.k)[len(held) - options.k]))
        iterators.sort(key=lambda x: x[2])
        bounds = np.cumsum([top for _, _, top in iterators])
        ids, scores = best
        for low in range(0, len(self.ids), options.window):
            least = max(floor, int(scores[-1])) if len(scores) == options.k else floor
            if not len(bounds) or bounds[-1] < least:
                break
            found = self._window(iterators, bounds, low, min(low + options.window, len(self.ids)), least)
            if found is not None:
                ids, scores = better(options.k, np.concatenate([ids, self.ids[found[0]]]), np.concatenate([scores, found[1]]))
        return ids, scores

    def _window(self, iterators, bounds, low: int, high: int, least: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Places in [low, high) that score `least` or more, and their scores."""
        # Iterators before `first` cannot reach the least score by themselves: they propose nothing.
        first = int(np.searchsorted(bounds, least))
        total = np.zeros(high - low, np.int64)
        reach = int(bounds[first - 1]) if first else 0
        proposing = []
        for places, scores, _ in iterators[first:]:
            a, b = np.searchsorted(places, (low, high))
            if a < b:
                proposing.append((places[a:b], scores[a:b]))
                reach += int(scores[a:b].max())
        if reach < least or not proposing:
            return None
        for places, scores in proposing:
            total[places - low] += scores
            self.opened += len(places)
        alive = np.flatnonzero((total > 0) & (total + (int(bounds[first - 1]) if first else 0) >= least))
        total, alive = total[alive], alive + low
        for i in range(first - 1, -1, -1):
            if not len(alive):
                return None
            places, scores, _ = iterators[i]
            at = np.minimum(np.searchsorted(places, alive), len(places) - 1)
            hit = places[at] == alive
            total[hit] += scores[at[hit]]
            self.opened += len(alive)
            fits = total + (int(bounds[i - 1]) if i else 0) >= least
            alive, total = alive[fits], total[fits]
        keep = total >= least
        return (alive[keep], total[keep]) if keep.any() else None


# --- Spark jobs -------------------------------------------------------------------------------


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers, ascending) and tfs of every document with a term."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(numbers)
    ints = pa.list_(pa.int32())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, found, counts = [], [], []
            for text in batch.column(1):
                words = terms(text.as_py())
                sizes.append(len(words))
                which = [t for t in map(number, words) if t is not None]
                held, times = np.unique(np.array(which, np.int32), return_counts=True)
                found.append(held)
                counts.append(times.astype(np.int32))
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in (found, counts)]
            out = [batch.column(0), pa.array(sizes, pa.int64()), *(pa.ListArray.from_arrays(pa.array(ends), pa.array(f, pa.int32())) for f in flat)]
            made = pa.RecordBatch.from_arrays([*out[:2], *(o.cast(ints) for o in out[2:])], names=["doc_id", "n", "terms", "tfs"])
            yield made.filter(pa.array(np.array(sizes) > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def statistics(posted: DataFrame, n_terms: int) -> Statistics:
    """Counted by task, added up by Spark; the driver gets a row per term that was asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, length = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            held += np.bincount(batch.column(1).flatten().to_numpy(), minlength=n_terms)
            documents += batch.num_rows
            length += int(batch.column(0).to_numpy().sum())
        known = np.flatnonzero(held)
        which = np.concatenate([[-2, -1], known])  # the two negative numbers stand for documents and length
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.concatenate([[documents, length], held[known]]))], names=["term", "amount"])

    counted = posted.select("n", "terms").mapInArrow(run, "term bigint, amount bigint").groupBy("term").agg(F.sum("amount").alias("amount"))
    amounts = {r["term"]: r["amount"] for r in counted.collect()}
    documents, length = amounts.get(-2, 0), amounts.get(-1, 0)
    return Statistics(documents, length, np.array([weight(documents, amounts[t]) if amounts.get(t) else 0 for t in range(n_terms)], np.int64))


def blocks_of(batches: Iterable[pa.RecordBatch], stats: Statistics, options: SearchOptions) -> Iterator[Block]:
    """Blocks of rows (doc_id, n, terms, tfs), cut by documents and by postings."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def made() -> Block:
        joined = pa.Table.from_batches(held).combine_chunks()
        lists = joined.column("terms").combine_chunks()
        counts = np.diff(lists.offsets.to_numpy())
        return Block(joined.column("doc_id").to_numpy(), joined.column("n").to_numpy(), counts, lists.flatten().to_numpy(), joined.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64), stats)

    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            weight_of = len(part.column(2).flatten())
            if held and (rows + part.num_rows > options.block_documents or size + weight_of > options.block_postings):
                yield made()
                held, rows, size = [], 0, 0
            held.append(part)
            rows += part.num_rows
            size += weight_of
    if held:
        yield made()


def best_of_tasks(found: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, score of the k best; a task's rows carry its number in `task`."""
    best = [F.desc("score"), F.asc("doc_id")]
    near = Window.partitionBy("item_id", F.floor(F.col("task") / 64)).orderBy(*best)
    fewer = found.withColumn("_near", F.row_number().over(near)).where(F.col("_near") <= k)
    ranked = fewer.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best)))
    return ranked.where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_block(docs: DataFrame, items: list[tuple[int, list[int]]], numbers: dict[bytes, int], options: SearchOptions) -> DataFrame:
    posted = written(postings(docs, numbers), "lexical-postings")
    stats = statistics(posted, len(numbers))
    asked = [(item, np.array([t for t in wanted if stats.weights[t] > 0], np.int64)) for item, wanted in items]
    shared = docs.sparkSession.sparkContext.broadcast((stats, asked))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stats, asked = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)
        for block in blocks_of(batches, stats, options):
            for i, (_, wanted) in enumerate(asked):
                best[i] = block.search(wanted, best[i], options)
        sizes = [len(ids) for ids, _ in best]
        columns = [np.repeat(np.array([item for item, _ in asked], np.int64), sizes), *(np.concatenate([b[j] for b in best]) for j in range(2))]
        columns.append(np.full(len(columns[0]), TaskContext.get().partitionId(), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item_id", "doc_id", "score", "task"])

    ranked = posted.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0)).select("doc_id", "n", "terms", "tfs")
    return best_of_tasks(ranked.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint, task bigint"), options.k)


def ranked_search(docs: DataFrame, items: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the best documents of every item (columns item_id, text)."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("item_id").isNotNull() & (F.length("text") > 0))
    blocks = 1 + (items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // options.item_bytes
    parts = []
    for number in range(blocks):
        numbers: dict[bytes, int] = {}
        wanted: dict[int, set[int]] = {}
        for row in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).toLocalIterator():
            wanted.setdefault(row["item_id"], set()).update(numbers.setdefault(t, len(numbers)) for t in terms(row["text"]))
        if numbers:
            found = _search_block(docs, sorted((i, sorted(w)) for i, w in wanted.items()), numbers, options)
            parts.append(found if blocks == 1 else written(found, "lexical-best"))
    out = parts[0] if parts else spark.createDataFrame([], RESULT)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
