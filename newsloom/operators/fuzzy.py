"""Fuzzy matching of entity mentions to ticker aliases by token-set similarity."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from newsloom.sources.tickers import alias_index

# The dictionary goes to the workers in parts of this many letters; each part is one index.
PART_LETTERS = 4_000_000
_MEMO_SIZE = 50_000
# Mentions that are matched at a time, about; Arrow batches hold a number of articles, whatever they mention.
_STEP_MENTIONS = 20_000
# Letters are counted in this many classes for an upper bound of the common subsequence.
_CLASSES = 32
_NONE = np.zeros(0, np.int64)

MATCH = "struct<alias:string,score:double,symbol:string,place:bigint>"


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one big integer as the row of the table."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _joined_length(words: set[str]) -> int:
    return sum(map(len, words)) + max(len(words) - 1, 0)


def _similarity(a: set[str], b: set[str]) -> float:
    """Token-set similarity of two word sets, 0 to 100."""
    if not a or not b:
        return 0.0
    shared = a & b
    only_a, only_b = a - b, b - a
    if shared and (not only_a or not only_b):
        return 100.0
    text_a, text_b = " ".join(sorted(only_a)), " ".join(sorted(only_b))
    shared_len = _joined_length(shared)
    gap = 1 if shared else 0
    full_a, full_b = shared_len + gap + len(text_a), shared_len + gap + len(text_b)
    edits = len(text_a) + len(text_b) - 2 * _common_subsequence(text_a, text_b)
    scores = [100.0 - 100.0 * edits / (full_a + full_b)]
    if shared:
        # Against the shared words alone, the rest of one side counts as insertions.
        for text, full in ((text_a, full_a), (text_b, full_b)):
            scores.append(100.0 - 100.0 * (gap + len(text)) / (shared_len + full))
    return max(scores)


def token_set_similarity(a: str, b: str) -> float:
    return _similarity(set((a or "").split()), set((b or "").split()))


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Column form of the similarity: case counts, word order and repetition do not."""
    return pd.Series([token_set_similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.replace(" ", "").encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(codes % _CLASSES, minlength=_CLASSES)


def _pairs(text: str) -> set[str]:
    return {text[i : i + 2] for i in range(len(text) - 1)}


class AliasIndex:
    """Aliases by their words, by the letter pairs of their sorted words, and by length.

    The best alias of a mention is found exactly at every cutoff. Aliases that share a word come
    from its list. One without a shared word scores by edits alone: its length lies near the
    mention's, and of the mention's pairs, sorted from the rarest on, more must survive than the
    edits can destroy, so it holds one of the first few. Where a cutoff allows more edits than
    there are pairs, all aliases of a near length are looked at. Each candidate has an upper bound
    from lengths and counts of letters; the similarity itself is computed in falling order of the
    bound until no bound reaches the best score.
    """

    def __init__(self, aliases: list[tuple[int, str, str]]):
        """aliases: (place, alias, symbol), places ascending."""
        self.aliases = aliases
        self.words = [set(a.split()) for _, a, _ in aliases]
        texts = [" ".join(sorted(w)) for w in self.words]
        self.length = np.array([len(t) for t in texts], np.int64)
        self.count = np.array([len(w) for w in self.words], np.int64)
        self.letters = np.array([_classes(t) for t in texts], np.int32).reshape(-1, _CLASSES)
        self.by_length = np.argsort(self.length, kind="stable")
        self.lengths = self.length[self.by_length].tolist()
        self.by_word, self.by_pair = self._lists(self.words), self._lists(map(_pairs, texts))

    @staticmethod
    def _lists(parts) -> dict[str, np.ndarray]:
        lists: dict[str, list[int]] = {}
        for i, found in enumerate(parts):
            for part in found:
                lists.setdefault(part, []).append(i)
        return {part: np.array(numbers, np.int64) for part, numbers in lists.items()}

    def _near(self, text: str, r: float) -> np.ndarray:
        """Aliases without a shared word that may score r or more by edits."""
        size = len(text)
        low, high = r * size / (2 - r), (2 - r) * size / r if r > 0 else float("inf")
        a = bisect_left(self.lengths, floor(low - 1e-9))
        b = bisect_right(self.lengths, floor(high + 1e-9)) if high < float("inf") else len(self.lengths)
        if a >= b:
            return _NONE
        pairs = _pairs(text)
        # A deletion destroys two of the mention's pairs at most, an insertion one.
        shortest = max(1.0, low)
        destroyed = 2 * size + shortest - 1.5 * r * (size + shortest) if 1.5 * r >= 1 else float("inf")
        if destroyed + 1 >= len(pairs):
            return self.by_length[a:b]
        by_pair = self.by_pair
        rarest = sorted((len(by_pair[p]) if p in by_pair else 0, p) for p in pairs)[: int(destroyed) + 1]
        lists = [by_pair[p] for count, p in rarest if count]
        if not lists:
            return _NONE
        found = np.unique(np.concatenate(lists))
        return found[(self.length[found] >= low - 1e-9) & (self.length[found] <= high + 1e-9)]

    def best(self, mention: str, cutoff: float) -> tuple[str, float, str, int] | None:
        """(alias, score, symbol, place) of the first alias with the highest score, from the cutoff on."""
        words = set(mention.split())
        if not words or not self.aliases:
            if cutoff > 0 or not self.aliases:
                return None
            place, alias, symbol = self.aliases[0]
            return alias, 0.0, symbol, place
        text = " ".join(sorted(words))
        lists = [(self.by_word[w], len(w)) for w in words if w in self.by_word]
        near = self._near(text, cutoff / 100.0)
        if not lists and not len(near):
            return None
        found = np.unique(np.concatenate([near, *(numbers for numbers, _ in lists)]))
        shared, held = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        for numbers, size in lists:
            at = np.searchsorted(found, numbers)
            shared[at] += size
            held[at] += 1
        # Lengths of the shared words and of both remainders, each joined by blanks.
        joined = shared + np.maximum(held - 1, 0)
        gap = (held > 0).astype(np.int64)
        rest_a = len(text) - joined - gap * (held < len(words))
        rest_b = self.length[found] - joined - gap * (held < self.count[found])
        letters = np.minimum(self.letters[found], _classes(text)).sum(1) - shared
        blanks = np.minimum(np.maximum(len(words) - held - 1, 0), np.maximum(self.count[found] - held - 1, 0))
        common = np.minimum(np.minimum(rest_a, rest_b), letters + blanks)
        full_a, full_b = joined + gap + rest_a, joined + gap + rest_b
        bound = 100.0 - 100.0 * (rest_a + rest_b - 2 * common) / (full_a + full_b)
        for rest, full in ((rest_a, full_a), (rest_b, full_b)):
            bound = np.where(held > 0, np.maximum(bound, 100.0 - 100.0 * (gap + rest) / np.maximum(joined + full, 1)), bound)
        bound = np.where((held > 0) & ((held == len(words)) | (held == self.count[found])), 100.0, bound) + 1e-9
        order = np.lexsort((found, -bound))
        best, best_score = None, -1.0
        for i in order[bound[order] >= cutoff].tolist():
            if bound[i] < best_score:
                break
            number = int(found[i])
            if bound[i] <= best_score + 2e-9 and best is not None and number > best:
                continue
            score = _similarity(words, self.words[number])
            if score >= cutoff and (score > best_score or score == best_score and number < best):
                best, best_score = number, score
        if best is None:
            return None
        place, alias, symbol = self.aliases[best]
        return alias, best_score, symbol, place


def _indexes(tickers: DataFrame, part_letters: int) -> Iterator[list[tuple[int, str, str]]]:
    """(place, alias, owning symbol) in dictionary order, in parts; the driver holds one at a time."""
    rows = alias_index(tickers).groupBy("alias").agg(F.min(F.struct("ord", "pos")).alias("place"), F.min_by("symbol", "ord").alias("symbol"))
    held, letters = [], 0
    for place, r in enumerate(rows.orderBy("place").select("alias", "symbol").toLocalIterator()):
        held.append((place, r["alias"], r["symbol"]))
        letters += len(r["alias"] or "")
        if letters >= part_letters:
            yield held
            held, letters = [], 0
    if held:
        yield held


def _steps(lists: pa.Array) -> Iterator[pa.Array]:
    """The lists in order, in slices of about as many elements as are matched at a time."""
    ends, start = lists.offsets.to_numpy(), 0
    while start == 0 or start < len(lists):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + _STEP_MENTIONS, side="right")) - 1)
        yield lists.slice(start, end - start)
        start = end


def best_matches(mentions: Column, tickers: DataFrame, cutoff: float = 85.0, part_letters: int = PART_LETTERS) -> Column:
    """For an array of mentions the array of their best aliases (alias, score, symbol, place), null
    where none reaches the cutoff. Among equal scores the first alias in dictionary order wins.

    Row-local for a dictionary of any size, in batches and streams. A worker builds the index of a
    part once per task and remembers the mentions it has met.
    """
    spark = tickers.sparkSession

    def part(aliases: list[tuple[int, str, str]]) -> Column:
        shared = spark.sparkContext.broadcast(aliases)

        @F.arrow_udf(f"array<{MATCH}>")
        def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            index, memo = AliasIndex(shared.value), {}
            kind = pa.struct([("alias", pa.string()), ("score", pa.float64()), ("symbol", pa.string()), ("place", pa.int64())])

            def matched(lists: pa.Array) -> pa.Array:
                values = lists.flatten().to_pylist()
                found = []
                for mention in values:
                    if mention not in memo:
                        if len(memo) >= _MEMO_SIZE:
                            memo.clear()
                        hit = index.best(mention, cutoff) if mention else None
                        memo[mention] = None if hit is None else dict(zip(("alias", "score", "symbol", "place"), hit))
                    found.append(memo[mention])
                counts = np.where(np.asarray(lists.is_valid()), np.diff(lists.offsets.to_numpy()), 0)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found, kind))

            for lists in batches:
                yield pa.concat_arrays([matched(part) for part in _steps(lists)])

        # Marked so that a filter on the result does not search again.
        return match.asNondeterministic()(F.coalesce(mentions, F.array().cast("array<string>")))

    def better(a: Column, b: Column) -> Column:
        return F.when(b.isNull() | (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["place"] < b["place"])), a).otherwise(b)

    out = None
    for aliases in _indexes(tickers, part_letters):
        found = part(aliases)
        out = found if out is None else F.zip_with(out, found, better)
    return out if out is not None else F.transform(mentions, lambda _: F.lit(None).cast(MATCH))


def match_mentions(mentions: Column, tickers: DataFrame, cutoff: float = 85.0, part_letters: int = PART_LETTERS) -> Column:
    """Symbols matched by an array of mentions, one entry per matching mention."""
    found = best_matches(mentions, tickers, cutoff, part_letters)
    return F.transform(F.filter(found, lambda m: m.isNotNull()), lambda m: m["symbol"])


def fuzzy_match(mentions: DataFrame, tickers: DataFrame, cutoff: float = 85.0, column: str = "mention", part_letters: int = PART_LETTERS) -> DataFrame:
    """Mentions with `alias, score, symbol` of their best alias at or above the cutoff, else null."""
    hit = F.get(best_matches(F.array(column), tickers, cutoff, part_letters), F.lit(0))
    return mentions.withColumn("_hit", hit).select(*mentions.columns, "_hit.alias", "_hit.score", "_hit.symbol")
