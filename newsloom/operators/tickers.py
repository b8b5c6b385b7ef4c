"""From article text to stock tickers: evidence per symbol, and the best symbols per article."""

from __future__ import annotations

import itertools
import os
import pickle
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from newsloom.functions.hints import extract_cashtags
from newsloom.functions.strings import empty_strings, entity_text
from newsloom.operators.fuzzy import match_mentions
from newsloom.operators.patterns import NameTrie, PatternTable
from newsloom.operators.symbol_index import PART_SCHEMA, Part, Windows, bit_field, part_builder, set_bits
from newsloom.settings import ResolveOptions, discard, written

# Weight of each kind of evidence. A known cashtag counts in two places.
CASHTAG_WEIGHT = 2.0 + 2.0
TITLE_WEIGHT = 1.5
HOST_WEIGHT = 1.0
MENTION_WEIGHT = 1.0

# A dictionary goes to the workers in parts of this many letters; each part is one automaton.
PART_LETTERS = 4_000_000
# A dictionary of more symbols is written to a table before it is measured.
FEW_SYMBOLS = 20_000
# Letters of titles that a worker searches at a time: what it finds in them is held together.
STEP_LETTERS = 1_000_000
# Of a dictionary of several parts, so many symbols are looked for one by one before titles are searched for all others.
FIRST_SYMBOLS = 64
_FOLDERS: list[tempfile.TemporaryDirectory] = []

_SCORES = "array<struct<score:double,ord:int,symbol:string>>"
_SCORE_FIELDS = [("score", pa.float64()), ("ord", pa.int32()), ("symbol", pa.string())]
_SCORES_TYPE = pa.list_(pa.struct(_SCORE_FIELDS))


class EntityExtractor(Protocol):
    """Turns the head of an article into organisation and product mentions, repeats kept."""

    def mentions(self, text: Column) -> Column: ...


# Signs that bind words while runs are marked: a blank, a full stop inside a word, one after an abbreviation.
_BLANK, _INNER, _AFTER = "\x01", "\x02", "\x03"
_LETTER = "[A-Za-z0-9&'-]"


def capitalized_runs(text: Column) -> Column:
    """Runs of capitalized words with one blank between, of any length.

    A full stop belongs to a word inside it ("Amazon.com") or after an abbreviation ("Inc."). What
    binds two words is marked first, so a run is one class of characters, which the regex engine
    reads in a loop; a repeated group would make it recurse once per word.
    """
    plain = F.translate(text, _BLANK + _INNER + _AFTER, "\n\n\n")
    inner = F.regexp_replace(plain, rf"(?<={_LETTER})\.(?={_LETTER})", _INNER)
    after = F.regexp_replace(inner, rf"(?<=\b(?:Inc|Corp|Co|Ltd))\.(?!{_LETTER})", _AFTER)
    bound = F.regexp_replace(after, rf"(?<=[A-Za-z0-9&'\-{_AFTER}]) (?=[A-Z])", _BLANK)
    runs = F.regexp_extract_all(bound, F.lit(f"[A-Z][A-Za-z0-9&'\\-{_BLANK}{_INNER}{_AFTER}]*+"), F.lit(0))
    return F.transform(runs, lambda r: F.translate(r, _BLANK + _INNER + _AFTER, " .."))


class CapitalizedRuns:
    """Runs of capitalized words, then dictionary names that stand in the text as whole words and were no run."""

    def __init__(self, names: list[str] | None = None):
        self.names = names or []

    def mentions(self, text: Column) -> Column:
        runs = capitalized_runs(text)
        if not self.names:
            return runs
        names = self.names

        @F.arrow_udf("array<string>")
        def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            trie = NameTrie(names)
            for texts in batches:
                yield pa.array([list(dict.fromkeys(trie.find(t.as_py() or ""))) for t in texts], pa.list_(pa.string()))

        def with_known(both: Column) -> Column:
            return F.concat(both["runs"], F.filter(both["known"], lambda n: ~F.array_contains(both["runs"], n)))

        # Bound as an element, so the runs are found once and not per name; marked, so that no later step repeats the search.
        return F.get(F.transform(F.array(F.struct(runs.alias("runs"), known.asNondeterministic()(text).alias("known"))), with_known), F.lit(0))


class NoEntities:
    """No mentions at all: tickers rest on cashtags, titles and hosts."""

    def mentions(self, text: Column) -> Column:
        return empty_strings()


def _hosts(hints: Column) -> Column:
    return F.transform(F.filter(hints, lambda h: F.startswith(h, F.lit("host:"))), lambda h: F.substr(h, F.lit(6)))


def _investor_host(hosts: Column) -> Column:
    """Whether a host is an investor-relations site, which speaks for every symbol."""
    return F.exists(hosts, lambda h: F.contains(h, F.lit("ir.")) | F.contains(h, F.lit("investor")))


def _pairs(lists: pa.Array) -> tuple[np.ndarray, list]:
    """Row number and value of every element of a list column."""
    counts = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), counts), lists.flatten().to_pylist()


def _title_score(investor: np.ndarray) -> np.ndarray:
    """What a symbol in the title scores without other evidence."""
    return TITLE_WEIGHT + HOST_WEIGHT * investor


class SymbolTable:
    """Part of a dictionary: its symbols, and one automaton over their symbols and names."""

    def __init__(self, rows: list[tuple[str, int, str, list[str]]]):
        self.symbols = [symbol for symbol, *_ in rows]
        self.spellings = [[low, *(n for n in names if n)] for _, _, low, names in rows]
        self.ords = np.array([ord_ for _, ord_, *_ in rows], np.int64)
        self.number = {symbol: i for i, symbol in enumerate(self.symbols)}
        patterns = [(low, i, True) for i, (_, _, low, _) in enumerate(rows)]
        patterns += [(name, i, False) for i, (*_, names) in enumerate(rows) for name in names if name]
        self.table = PatternTable([p for p, _, _ in patterns])
        self.owner = np.array([i for _, i, _ in patterns], np.int64)
        self.is_symbol = np.array([s for *_, s in patterns], bool)
        # A symbol without letters is contained in every text.
        self.always = np.array([i for i, (_, _, low, _) in enumerate(rows) if not low], np.int64)

    def _contained(self, rows: np.ndarray, texts: list[str], symbols_only: bool) -> np.ndarray:
        """rows[i] * symbols + symbol for texts[i], each once."""
        at, pattern = self.table.find(texts)
        if symbols_only:
            at, pattern = at[self.is_symbol[pattern]], pattern[self.is_symbol[pattern]]
        keys = [rows[at] * len(self.symbols) + self.owner[pattern]]
        keys += [rows * len(self.symbols) + i for i in self.always]
        return np.unique(np.concatenate(keys))

    def scores(self, titles: pa.Array, hosts: pa.Array, investor: pa.Array, cashtags: pa.Array, matched: pa.Array, min_score: float, most: int | None) -> pa.Array:
        """Per row the (score, ord, symbol) of all symbols that score min_score or more (and more than 0), best first.

        Rows go in steps of a bounded number of letters, and of symbols where an investor host may bring all of them.
        """
        columns = (titles, hosts, investor, cashtags, matched)
        letters = pc.fill_null(pc.binary_length(titles), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.cumsum(letters + (len(self.symbols) if most is None else 0))
        found, start = [], 0
        while start < len(titles):
            used = before[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(before, used + STEP_LETTERS, side="right")))
            found.append(self._step_scores(*[c.slice(start, end - start) for c in columns], min_score, most))
            start = end
        return pa.concat_arrays(found) if found else pa.array([], _SCORES_TYPE)

    def _step_scores(self, titles: pa.Array, hosts: pa.Array, investor: pa.Array, cashtags: pa.Array, matched: pa.Array, min_score: float, most: int | None) -> pa.Array:
        count = len(self.symbols)
        size = len(titles)
        texts = [t or "" for t in titles.to_pylist()]
        at, names = _pairs(hosts)
        company = [i for i, h in enumerate(names) if h is not None and h.endswith(".com")]
        host = self._contained(at[company], [names[i] for i in company], True)

        def known(lists: pa.Array) -> np.ndarray:
            rows, values = _pairs(lists)
            numbers = np.array([self.number.get(v, -1) for v in values], np.int64)
            return (rows * count + numbers)[numbers >= 0]

        tagged, named = np.unique(known(cashtags)), known(matched)
        everywhere = np.asarray(investor.fill_null(False))
        everyone = np.flatnonzero(everywhere)
        # Where a title alone is not enough, only symbols with other evidence are looked for in it.
        enough = _title_score(everywhere) >= min_score
        searched = np.flatnonzero(enough)
        title = self._contained(searched, [texts[i] for i in searched], False)
        others = np.unique(np.concatenate([tagged, named, host]))
        others = others[~enough[others // max(1, count)]]
        inside = [any(spelling in texts[key // count] for spelling in self.spellings[key % count]) for key in others.tolist()]
        title = np.concatenate([title, others[np.array(inside, bool)]])
        parts = [(tagged, CASHTAG_WEIGHT), (title, TITLE_WEIGHT), (named, MENTION_WEIGHT), (host, 0.0)]
        if HOST_WEIGHT >= min_score:
            # On an investor host every symbol scores; with nothing else, only the first of the dictionary get far.
            first = np.argsort(self.ords, kind="stable")[:most]
            parts.append(((everyone[:, None] * count + first).ravel(), 0.0))
        keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        total = np.bincount(which, np.concatenate([np.full(len(k), w) for k, w in parts]), len(keys)).astype(np.float64)
        rows, symbol = np.divmod(keys, max(1, count))
        total += HOST_WEIGHT * (np.isin(keys, host, assume_unique=True) | np.isin(rows, everyone))
        kept = np.flatnonzero((total >= min_score) & (total > 0))
        kept = kept[np.lexsort((self.ords[symbol[kept]], -total[kept], rows[kept]))]
        row = rows[kept]
        if most is not None:
            kept = kept[np.arange(len(row)) - np.searchsorted(row, row) < most]
            row = rows[kept]
        values = [pa.array(total[kept]), pa.array(self.ords[symbol[kept]].astype(np.int32)), pa.array([self.symbols[i] for i in symbol[kept]], pa.string())]
        offsets = np.searchsorted(row, np.arange(size + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(values, [name for name, _ in _SCORE_FIELDS]))


def _entries(tickers: DataFrame) -> DataFrame:
    return tickers.select("symbol", "ord", F.lower("symbol").alias("low"), F.coalesce(F.transform("aliases", F.lower), empty_strings()).alias("names"))


def _parts(rows: Iterable[Row], part_letters: int) -> Iterator[list[tuple[str, int, str, list[str]]]]:
    """The dictionary's rows in parts, in their order; the driver holds one part at a time."""
    held, letters = [], 0
    for r in rows:
        held.append((r["symbol"], r["ord"], r["low"], r["names"]))
        letters += len(r["low"]) + sum(len(n or "") for n in held[-1][3])
        if letters >= part_letters:
            yield held
            held, letters = [], 0
    if held:
        yield held


class SymbolIndex:
    """A large dictionary as the parts of an index, files on each executor.

    A title alone scores the same for all symbols, so of those the first in the dictionary's order count. The
    first symbols of all are looked for one by one; titles that hold fewer than `most` of them are searched by
    hashes for all others. Symbols with other evidence are looked up by themselves.
    """

    def __init__(self, parts: list[str], bits: str, lengths: list[int]):
        self.parts, self.bits, self.lengths = parts, bits, lengths

    def scores(self, titles: pa.Array, hosts: pa.Array, investor: pa.Array, cashtags: pa.Array, matched: pa.Array, min_score: float, most: int) -> pa.Array:
        """Per row the (score, ord, symbol) of at most `most` symbols that score min_score or more, which is over HOST_WEIGHT."""
        windows = Windows(np.memmap(SparkFiles.get(self.bits), np.uint8, "r"), self.lengths)
        parts = [Part(pa.memory_map(SparkFiles.get(name))) for name in self.parts]
        everywhere = np.asarray(investor.fill_null(False)).tolist()
        evidence, on_host = self._evidence(hosts, cashtags, matched, parts, windows)
        entries: dict[tuple[int, int], tuple] = {}

        def entry(key: tuple[int, int]) -> tuple:
            if key not in entries:
                entries[key] = parts[key[0]].entry(key[1])
            return entries[key]

        def spelled(key: tuple[int, int], text: str) -> bool:
            _, _, low, names = entry(key)
            return low in text or any(n in text for n in names)

        ahead = [(0, number) for number in range(min(len(parts[0].symbol), FIRST_SYMBOLS))]
        best: list[list[tuple]] = []
        for i, anywhere in enumerate(everywhere):
            enough = TITLE_WEIGHT + HOST_WEIGHT * anywhere >= min_score
            other = evidence.get(i, {})
            if not (enough or other):
                best.append([])
                continue
            text = titles[i].as_py() or ""
            alone = list(itertools.islice((key for key in ahead if spelled(key, text)), most)) if enough and text else []
            if enough and text and len(alone) < most:
                alone += self._first(text, most - len(alone), len(ahead), parts, windows, spelled)
            held, listed = set(alone), []
            for key in {**dict.fromkeys(alone), **other}:
                score = other.get(key, 0.0) + HOST_WEIGHT * (anywhere or key in on_host.get(i, ()))
                if key in held or (score + TITLE_WEIGHT >= min_score and spelled(key, text)):
                    score += TITLE_WEIGHT
                if score >= min_score:
                    listed.append((-score, entry(key)[1], key, entry(key)[0]))
            best.append(sorted(listed)[:most])
        flat = [b for row in best for b in row]
        values = [pa.array([-b[0] for b in flat], pa.float64()), pa.array([b[1] for b in flat], pa.int32()), pa.array([b[3] for b in flat], pa.string())]
        offsets = np.concatenate([[0], np.cumsum([len(row) for row in best])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(values, [name for name, _ in _SCORE_FIELDS]))

    @staticmethod
    def _evidence(hosts: pa.Array, cashtags: pa.Array, matched: pa.Array, parts: list[Part], windows: Windows) -> tuple[dict, dict]:
        """By row: what cashtags and mentions give each symbol (0 where only a host holds it), and the symbols that a host holds."""

        def pairs(lists: pa.Array) -> list[tuple[int, str]]:
            rows, values = _pairs(lists)
            return [(i, v) for i, v in zip(rows.tolist(), values) if v is not None]

        tags, mentions, companies = set(pairs(cashtags)), pairs(matched), {(i, h) for i, h in pairs(hosts) if h.endswith(".com")}
        asked = sorted({v for _, v in itertools.chain(tags, mentions)})
        sites = sorted({h for _, h in companies})
        asked_hashes = windows.hashing.whole(pa.array(asked, pa.string()))
        site, site_hashes = windows.find([h.encode("utf-8", "surrogatepass") for h in sites])
        numbers: dict[str, list] = {}
        inside: dict[str, set] = {}
        for p, part in enumerate(parts):
            for symbol, number in part.numbers(asked, asked_hashes).items():
                numbers.setdefault(symbol, []).append((p, number))
            for which, number in zip(*(x.tolist() for x in part.held(site_hashes, True))):
                if part.low[number].as_py() in sites[site[which]]:
                    inside.setdefault(sites[site[which]], set()).add((p, number))
        evidence: dict[int, dict] = {}
        on_host: dict[int, set] = {}
        for found, weight in ((tags, CASHTAG_WEIGHT), (mentions, MENTION_WEIGHT)):
            for i, v in found:
                for key in numbers.get(v, ()):
                    own = evidence.setdefault(i, {})
                    own[key] = own.get(key, 0.0) + weight
        for i, h in companies:
            on_host.setdefault(i, set()).update(inside.get(h, ()))
        for i, keys in on_host.items():
            evidence[i] = {**dict.fromkeys(keys, 0.0), **evidence.get(i, {})}
        return evidence, on_host

    @staticmethod
    def _first(text: str, need: int, ahead: int, parts: list[Part], windows: Windows, spelled) -> list[tuple[int, int]]:
        """The first symbols behind those `ahead`, so many at most, that a text contains."""
        hashes = np.unique(windows.find([text.encode("utf-8", "surrogatepass")])[1])
        out: list[tuple[int, int]] = []
        for p, part in enumerate(parts):
            for number in np.unique(part.held(hashes, False)[1]).tolist():
                if (p or number >= ahead) and spelled((p, number), text):
                    out.append((p, number))
                    if len(out) == need:
                        return out
        return out


def _indexed(entries: DataFrame, part_letters: int) -> SymbolIndex:
    """The index of a large dictionary. Executors make its parts, the driver holds those of one split at a time."""
    spark = entries.sparkSession
    made = written(entries.orderBy("ord").mapInArrow(part_builder(part_letters), PART_SCHEMA), "ticker-index")
    names, lengths = {}, set()
    bits = bit_field(made.agg(F.sum("patterns")).first()[0])
    for r in made.toLocalIterator():
        set_bits(bits, Part(pa.py_buffer(r["data"])).hash)
        lengths.update(r["lengths"])
        names[r["partition"], r["number"]] = _as_file(spark, bytes(r["data"]))
    discard(made)
    return SymbolIndex([names[place] for place in sorted(names)], _as_file(spark, bits.tobytes()), sorted(lengths))


def _merged(parts: list[pa.Array], most: int | None) -> pa.Array:
    """Score lists of the same rows from several parts as one list per row, best first."""
    size = len(parts[0])
    row = np.concatenate([np.repeat(np.arange(size), np.diff(p.offsets.to_numpy())) for p in parts])
    values = pa.concat_arrays([p.flatten() for p in parts])
    score, ord_, symbol = values.flatten()
    order = np.lexsort((ord_.to_numpy(), -score.to_numpy(), row))
    row = row[order]
    if most is not None:
        best = np.arange(len(row)) - np.searchsorted(row, row) < most
        row, order = row[best], order[best]
    offsets = np.searchsorted(row, np.arange(size + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(order)))


def _as_file(spark: SparkSession, data: bytes) -> str:
    """Name under which Spark hands the bytes to the executors as a file of its own."""
    # Spark reads the files whenever an executor joins, so they stay until Python ends.
    folder, name = tempfile.TemporaryDirectory(prefix="newsloom-tables-"), f"tickers-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    with open(os.path.join(folder.name, name), "wb") as out:
        out.write(data)
    spark.sparkContext.addFile(out.name)
    return name


def ticker_scores(articles: DataFrame, tickers: DataFrame, min_score: float = 0.0, most: int | None = None, part_letters: int = PART_LETTERS) -> Column:
    """Column of the (score, ord, symbol) that reach `min_score`, best first, at most `most`.

    Row-local for a dictionary of any size, in batches and streams: title, hosts, cashtags and
    mentions go to the worker, whose automaton holds the dictionary. Of a large one the best symbols
    are found by an index, files on each executor; where all symbols count, it is dealt into parts of which a worker holds one at a time.
    A symbol's score rests on its own part, so the parts' best lists are merged.
    """
    title, body = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))
    hosts = _hosts(F.coalesce("hints", empty_strings()))
    matched = F.col("matched") if "matched" in articles.columns else empty_strings()
    evidence = [F.lower(title), hosts, _investor_host(hosts), extract_cashtags(F.concat(title, F.lit(" "), body)), F.coalesce(matched, empty_strings())]

    entries = _entries(tickers)
    few = entries.limit(FEW_SYMBOLS + 1).collect()
    large = len(few) > FEW_SYMBOLS
    if large:
        entries = written(entries, "ticker-entries")
    rows = entries.orderBy("ord").toLocalIterator() if large else sorted(few, key=lambda r: r["ord"])
    letters = F.length("low") + F.aggregate("names", F.lit(0), lambda total, n: total + F.coalesce(F.length(n), F.lit(0)))
    size, empty = entries.agg(F.sum(letters), F.max(F.length("low") == 0)).first() if large else (sum(len(r["low"]) + sum(len(n or "") for n in r["names"]) for r in few), any(not r["low"] for r in few))
    # The index finds the best symbols; all symbols, or those that only an investor host brings, are found part by part.
    if few and size > part_letters and most and min_score > HOST_WEIGHT and not empty:
        index = _indexed(entries, part_letters)
        if large:
            discard(entries)

        @F.arrow_udf(_SCORES)
        def best_scores(titles: pa.Array, hosts: pa.Array, investor: pa.Array, cashtags: pa.Array, matched: pa.Array) -> pa.Array:
            return index.scores(titles, hosts, investor, cashtags, matched, min_score, most)

        return best_scores(*evidence)

    parts = _parts(rows, part_letters)
    start = list(itertools.islice(parts, 2))
    if not start:
        return F.array().cast(_SCORES)
    if len(start) == 1:
        shared = articles.sparkSession.sparkContext.broadcast(SymbolTable(start[0]))

        @F.arrow_udf(_SCORES)
        def scores(titles: pa.Array, hosts: pa.Array, investor: pa.Array, cashtags: pa.Array, matched: pa.Array) -> pa.Array:
            return shared.value.scores(titles, hosts, investor, cashtags, matched, min_score, most)

        return scores(*evidence)

    names = [_as_file(articles.sparkSession, cloudpickle.dumps(SymbolTable(part))) for part in itertools.chain(start, parts)]

    @F.arrow_udf(_SCORES)
    def all_scores(titles: pa.Array, hosts: pa.Array, investor: pa.Array, cashtags: pa.Array, matched: pa.Array) -> pa.Array:
        found = None
        for name in names:
            with open(SparkFiles.get(name), "rb") as file:
                table = pickle.load(file)
            scores = table.scores(titles, hosts, investor, cashtags, matched, min_score, most)
            # One table at a time, also while the next one is read.
            del table
            found = scores if found is None else _merged([found, scores], most)
        return found

    return all_scores(*evidence)


def score_tickers(articles: DataFrame, tickers: DataFrame, part_letters: int = PART_LETTERS) -> DataFrame:
    """Articles with `ticker_scores`: every symbol with a positive score, best first.

    On an investor-relations host these are all symbols; `resolve_tickers` keeps only the best.
    """
    return articles.withColumn("ticker_scores", ticker_scores(articles, tickers, part_letters=part_letters))


def resolve_tickers(
    articles: DataFrame, tickers: DataFrame, min_score: float = 2.0, max_tickers: int = 5, part_letters: int = PART_LETTERS
) -> DataFrame:
    """Articles with `tickers`: at most `max_tickers` symbols scoring `min_score` or more, best
    first, ties in dictionary order."""
    best = ticker_scores(articles, tickers, min_score, max_tickers, part_letters)
    return articles.withColumn("tickers", F.transform(best, lambda s: s["symbol"]))


def match_entities(articles: DataFrame, tickers: DataFrame, cutoff: float = 85.0) -> DataFrame:
    """Articles with `matched`: the symbol of each mention in `entities` that resembles an alias."""
    return articles.withColumn("matched", match_mentions(F.col("entities"), tickers, cutoff))


def with_tickers(
    clean: DataFrame,
    tickers: DataFrame,
    extractor: EntityExtractor | None = None,
    options: ResolveOptions = ResolveOptions(),
) -> DataFrame:
    """Clean articles with `entities` and `tickers`."""
    extractor = extractor if extractor is not None else CapitalizedRuns()
    text = entity_text(F.col("title"), F.col("body"), options.entity_chars)
    found = clean.withColumn("entities", extractor.mentions(text))
    if not isinstance(extractor, NoEntities):
        found = match_entities(found, tickers, options.fuzzy_cutoff)
    return resolve_tickers(found, tickers, options.min_score, options.max_tickers).drop("matched")
