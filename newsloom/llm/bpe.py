"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, one gadget after another, into a deterministic automaton over token arcs.
It starts as one state with a loop for every symbol. The gadget of a merge (a, b) -> c copies the
state that a leads to, without its b arc, lets a lead to the copy, and gives a c arc, to where b
led, to every state that has an a arc. Where b is no longer an arc after a, the merge can never
fire and adds nothing. Any text then has exactly one path, which spells its tokens.

Copies share what they do not change: a state is kept as the token that leads to it, the state it
was copied from, and the arcs taken away since, so 48,894 merges take as many small entries rather
than a table of states times tokens. New words of many texts go through it together, a symbol of all
of them at a time; a transition that has been followed lately is a table entry.

Defined results: null reads as empty; empty texts have no tokens; special tokens in a text are
recognised as such; very long texts and words take time in proportion; rows are independent, so
repeated rows and ties get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import string
import sys
import types
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import arrow_texts, parts_of

# The pre-tokenizer's pattern (blanks are single spaces by then) and what counts as a blank.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^ \p{L}\p{N}]+")
ODD_BLANKS = regex.compile("[\x1c-\x1f]")  # blanks to str.split, but not here
BLANKS = regex.compile("[\t-\r \x85\xa0  -     　]+")

#: Bytes of text whose words a worker takes together.
SPAN_BYTES = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class FoundIn:
    """Values of many non-negative keys at once; `missing` for others."""

    def __init__(self, entries: dict[int, int], missing: int = 0):
        keys = np.array([*entries, (1 << 63) - 1], np.int64)
        order = np.argsort(keys)
        self._keys, self._values, self._missing = keys[order], np.array([*entries.values(), missing], np.int64)[order], missing

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self._keys, keys)
        return np.where(self._keys[at] == keys, self._values[at], self._missing)


class Automaton:
    """States and arcs over token numbers; see the module's text."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        self.symbols = byte_symbols()
        labels = self.symbols + [s + suffix for s in self.symbols]
        self.labels = labels
        self.number = {label: i for i, label in enumerate(labels)}
        self._made = [0] * len(labels)  # step of the merge that made the token
        self._left = [-1] * len(labels)
        self._right = [-1] * len(labels)
        self._without: list[dict[int, int]] = [{} for _ in labels]  # arcs taken away, and when
        for step, (a, b) in enumerate(merges, 1):
            self._add_gadget(step, a, b)
        self._tabulate()

    def _tabulate(self) -> None:
        """The automaton as arrays, and a trie of the tokens read from their ends: one root for tokens within a word, one for those that end it."""
        end, byte = len(self.suffix), {symbol: i for i, symbol in enumerate(self.symbols)}
        children: dict[int, int] = {}
        token_of = [-1, -1]  # of each trie node
        for token, label in enumerate(self.labels):
            ends = label.endswith(self.suffix)
            node = int(ends)
            for symbol in reversed(label[: len(label) - end] if ends else label):
                key = node << 8 | byte[symbol]
                node = children.get(key, 0)
                if not node:
                    node = children[key] = len(token_of)
                    token_of.append(-1)
            token_of[node] = token
        self._children, self._token_of = FoundIn(children), np.array(token_of, np.int64)
        self._gone = FoundIn({state << 32 | token: when for state, taken in enumerate(self._without) for token, when in taken.items()}, 1 << 60)
        self._made_at, self._left_of, self._right_of = (np.array(x, np.int64) for x in (self._made, self._left, self._right))
        self._followed = np.full((2, 1 << 19), -1, np.int64)  # transitions followed lately and what they gave, by a hash

    def _add_gadget(self, step: int, a: str, b: str) -> None:
        left, right = self.number.get(a), self.number.get(b)
        if left is None or right is None or not self._has_arc(left, right, 2 * step):
            return
        if a + b in self.number:
            raise ValueError(f"two merges make {a + b!r}")
        self.number[a + b] = len(self.labels)
        self.labels.append(a + b)
        self._made.append(step)
        self._left.append(left)
        self._right.append(right)
        self._without.append({})
        self._without[left][right] = 2 * step + 1

    def _has_arc(self, state: int, token: int, when: int) -> bool:
        """Whether the state that `state` leads to has the token's arc, as of a half step (even: before the merge's own change)."""
        while True:
            if self._without[state].get(token, when + 1) <= when:
                return False
            if self._made[token] > self._made[state]:  # younger token: there, if its left part was there then
                when = min(when, 2 * self._made[token] + 1)
                token = self._left[token]
            elif self._made[state]:  # as the state that this one was copied from
                when = 2 * self._made[state]
                state = self._right[state]
            else:
                return True

    def _have_arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """`_has_arc` of the finished automaton for many states and tokens."""
        out, at, when = np.zeros(len(states), bool), np.arange(len(states)), np.full(len(states), 1 << 59)
        while len(at):
            there = self._gone(states << 32 | tokens) > when
            at, states, tokens, when = at[there], states[there], tokens[there], when[there]
            made, younger = self._made_at[states], self._made_at[tokens] > self._made_at[states]
            when = np.where(younger, np.minimum(when, 2 * self._made_at[tokens] + 1), 2 * made)
            tokens, states = np.where(younger, self._left_of[tokens], tokens), np.where(younger, states, self._right_of[states])
            ends = ~younger & (made == 0)
            out[at[ends]] = True
            at, states, tokens, when = at[~ends], states[~ends], tokens[~ends], when[~ends]
        return out

    def arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        keys = states << 32 | tokens
        with np.errstate(over="ignore"):
            places = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).view(np.int64)
        known, out = self._followed[0, places] == keys, self._followed[1, places] == 1
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self._have_arcs(states[new], tokens[new])
            # Of two new ones in one place either stays, but with its own result.
            self._followed[0, places[new]] = keys[new]
            new = new[self._followed[0, places[new]] == keys[new]]
            self._followed[1, places[new]] = out[new]
        return out

    def path(self, word: str) -> list[int]:
        return self.paths([word.encode("utf-8", "surrogatepass")])[0] if word else []

    def paths(self, words: list[bytes]) -> list[list[int]]:
        """Arcs that spell each word's bytes (no word is empty). Step i keeps the one token that ends the path of the first i, in whichever order tried."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        # Of every place, all tokens that end there: the trie is walked back from all of them at once.
        steps = np.arange(len(data)) - np.repeat(first, sizes)
        last_place = np.zeros(len(data), np.int64)
        last_place[first + sizes - 1] = 1
        at, nodes, depth, ends, lengths, tokens = np.arange(len(data)), last_place, 0, [], [], []
        while len(at):
            nodes = self._children(nodes << 8 | data[at - depth])
            there = nodes > 0
            at, nodes, depth = at[there], nodes[there], depth + 1
            token = self._token_of[nodes]
            found = token >= 0
            ends.append(at[found])
            tokens.append(token[found])
            lengths.append(np.full(int(found.sum()), depth))
            further = steps[at] >= depth
            at, nodes = at[further], nodes[further]
        ends, lengths, tokens = np.concatenate(ends), np.concatenate(lengths), np.concatenate(tokens)
        # By step in the word, then by place; a place's tokens one after the other, the longest last.
        order = np.lexsort((lengths, ends, steps[ends]))
        ends, lengths, tokens = ends[order], lengths[order], tokens[order]
        cuts = np.searchsorted(steps[ends], np.arange(int(sizes.max()) + 1)).tolist()
        last, begin = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
        for a, b in zip(cuts, cuts[1:]):
            end, length, token = ends[a:b], lengths[a:b], tokens[a:b]
            before = end - length
            fits = length > steps[end]  # the whole word so far
            inner = np.flatnonzero(~fits)
            inner = inner[last[before[inner]] >= 0]
            fits[inner] = self.arcs(last[before[inner]], token[inner])
            last[end[fits]], begin[end[fits]] = token[fits], before[fits]
        # Back from the ends: the arcs of all paths, the last ones first.
        word, at, spelled, owners = np.arange(len(words)), first + sizes - 1, [], []
        while len(word):
            spelled.append(last[at])
            owners.append(word)
            at = begin[at]
            further = at >= first[word]
            word, at = word[further], at[further]
        owners, spelled = np.concatenate(owners)[::-1], np.concatenate(spelled)[::-1]
        flat = spelled[np.argsort(owners, kind="stable")].tolist()
        stops = np.cumsum(np.bincount(owners, minlength=len(words))).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]


class WordBpe:
    """Encoder and decoder of a word-level BPE file (`tokenizer.json`) with lower-casing and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model = stated["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(merges, model["end_of_word_suffix"])
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in stated["added_tokens"]}
        self.label = {i: label for label, i in {**self.vocab, **self.special}.items()}
        self._split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._ids = [self.vocab[label] for label in self.automaton.labels]
        self._shown = [str(i) for i in self._ids]
        self._named = [self.label[i] for i in self._ids]
        # Of each word and each run of non-blanks seen: its ids, or ids and labels as text. Blanks end every word, so runs are
        # independent; they differ in case and marks, their words much less.
        self._coded: tuple[dict, dict] = {}, {}
        self._spelt: tuple[dict, dict] = {}, {}
        self._held = 0
        self.forget()

    @staticmethod
    def normalized(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-casing knows no final form
        return BLANKS.sub(" ", text).lower()

    def _learn(self, runs: Iterable[str], memory: tuple[dict, dict], of_path: Callable, of_words: Callable) -> None:
        (known, learnt), split, new = memory, [], set()
        for run in runs:
            low = run.lower() if run.isascii() else self.normalized(run)
            stem = low.rstrip(string.punctuation)
            if stem.isalpha():  # as the pattern splits letters and marks after them
                words = [stem, low[len(stem) :]] if len(stem) < len(low) else [low]
            else:
                words = WORDS.findall(low)
            split.append((run, words))
            new.update(words)
        # A run holds any number of symbols, so the words go in parts of a bounded number.
        part, size, parts = [], 0, []
        for word in new.difference(known):
            part.append(word)
            size += len(word)
            if size > 1 << 18:
                parts.append(part)
                part, size = [], 0
        for part in [*parts, part]:
            for word, path in zip(part, self.automaton.paths([w.encode("utf-8", "surrogatepass") for w in part]) if part else ()):
                known[word] = of_path(path)
                self._held += 400 + 8 * len(word)
        for run, words in split:
            learnt[run] = known[words[0]] if len(words) == 1 else of_words([known[w] for w in words])  # one word's is shared, not copied
            self._held += 200 + 4 * len(run)

    def _split_runs(self, text: str) -> list[str]:
        """The text's runs of non-blanks and special tokens."""
        if not self._split or "<" not in text:
            return text.split() if not ODD_BLANKS.search(text) else [r for r in BLANKS.split(text) if r]
        runs, at = [], 0
        for found in self._split.finditer(text):
            runs += [*filter(None, BLANKS.split(text[at : found.start()])), found.group()]
            at = found.end()
        return runs + [*filter(None, BLANKS.split(text[at:]))]

    def _met(self, texts: list[str], memory: tuple[dict, dict], of_path: Callable, of_words: Callable) -> Iterator[list]:
        """What is learnt of each text's runs."""
        split = [self._split_runs(text) for text in texts]
        if self._held > 256 << 20:
            self.forget()
        learnt = memory[1]
        self._learn(set().union(*split).difference(learnt), memory, of_path, of_words)
        for runs in split:
            yield [learnt[run] for run in runs]

    def forget(self) -> None:
        """Empties what was learnt, so that memory is bounded; special tokens are their own runs."""
        self._held = 0
        for shelf in (*self._coded, *self._spelt):
            shelf.clear()
        for label, i in self.special.items():
            self._coded[1][label], self._spelt[1][label] = (i,), (str(i), label)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        ids = self._ids

        def of_path(path: list[int]) -> tuple[int, ...]:
            return tuple([ids[t] for t in path])

        def of_words(words: list[tuple[int, ...]]) -> tuple[int, ...]:
            return tuple(chain.from_iterable(words))

        return [list(chain.from_iterable(met)) for met in self._met(texts, self._coded, of_path, of_words)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def spelled_all(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text, how many tokens, their ids as text, and the decoded text."""
        shown, named = self._shown, self._named

        def of_path(path: list[int]) -> tuple[str, str]:
            return " ".join([shown[t] for t in path]), " ".join([named[t] for t in path])

        def of_words(words: list[tuple[str, str]]) -> tuple[str, str]:
            return " ".join([w[0] for w in words]), " ".join([w[1] for w in words])

        for met in self._met(texts, self._spelt, of_path, of_words):
            ids = " ".join([m[0] for m in met])
            yield ids.count(" ") + 1 if ids else 0, ids, " ".join([m[1] for m in met])

    def spelled(self, text: str) -> tuple[int, str, str]:
        return next(self.spelled_all([text]))

    def decode(self, ids: Iterable[int]) -> str:
        """The arc labels along the path, with a space between them; unknown numbers emit nothing."""
        return " ".join(self.label[i] for i in ids if i in self.label)


def loaded(path: str) -> WordBpe:
    """One automaton per worker process and file; the file is the same on every machine.

    Functions travel by value, so a global of this module would start empty in every task; an
    entry of `sys.modules` stays with the process.
    """
    shelf = sys.modules.setdefault("newsloom_worker_shelf", types.ModuleType("newsloom_worker_shelf")).__dict__
    if path not in shelf:
        shelf[path] = WordBpe(path)
    return shelf[path]


def encode_with(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns to keep and the ids of every document. No shuffle."""
    typed = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in parts_of(batches, len(keep), SPAN_BYTES):
            ids = pa.array(bpe.encode_all([*arrow_texts(batch.column(len(keep)))]), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids], names=[*keep, "ids"])

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, f"{typed}, ids array<int>")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every document."""
    return encode_with(docs, path, ["doc_id"])


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of every row of `encode_documents`; null ids read as none."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = pa.array([bpe.decode(ids.as_py() or ()) for ids in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them, in one pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in parts_of(batches, 1, SPAN_BYTES):
            rows = [(count, digest(ids), digest(decoded)) for count, ids, decoded in bpe.spelled_all([*arrow_texts(batch.column(1))])]
            counts, ids, decoded = zip(*rows)
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
