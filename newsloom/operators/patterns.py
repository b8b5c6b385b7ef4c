"""Many patterns at once: a multi-pattern automaton in a few arrays, and longest names by a token trie.

The automaton holds the goto, failure and output tables of all patterns. States are numbered level by
level, so the pairs (state, letter) of all edges are sorted by the number of the state they lead to, and
goto is a binary search in one array. A batch of texts goes through letter by letter, all texts in one
step, whatever the number of patterns.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

# Longer texts are cut into overlapping pieces, so one long text does not hold up its batch.
PIECE = 512
# Letters that go through the automaton at a time.
LETTERS_AT_A_TIME = 4_000_000


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class PatternTable:
    """Finds which of the given patterns each text contains. Patterns may repeat; empty ones are in no text."""

    def __init__(self, patterns: Sequence[str]):
        lengths = np.array([len(p) for p in patterns], np.int64)
        self.longest = int(lengths.max(initial=0))
        codes = _code_points("".join(patterns))
        self.alphabet, letters = np.unique(codes, return_inverse=True)
        self.width = max(1, len(self.alphabet))
        starts = np.cumsum(lengths) - lengths
        at, levels, total = np.zeros(len(patterns), np.int64), [], 0
        for depth in range(self.longest):
            alive = np.flatnonzero(lengths > depth)
            edges, which = np.unique(at[alive] * self.width + letters[starts[alive] + depth], return_inverse=True)
            at[alive] = total + 1 + which
            levels.append((total + 1, total + 1 + len(edges)))
            total += len(edges)
            self.edges = edges if depth == 0 else np.concatenate([self.edges, edges])
        if not self.longest:
            self.edges = np.zeros(0, np.int64)
        # Patterns by the state they end in.
        ends = np.where(lengths > 0, at, -1)
        self.by_state = np.argsort(ends, kind="stable")
        self.first = np.searchsorted(ends[self.by_state], np.arange(total + 2))
        self.fail = np.zeros(total + 1, np.int32)
        # The nearest state on the way of failures, itself included, where a pattern ends.
        self.hit = np.where(np.diff(self.first) > 0, np.arange(total + 1), 0).astype(np.int32)
        for low, high in levels:
            states = np.arange(low, high)
            parents, letter = np.divmod(self.edges[low - 1 : high - 1], self.width)
            if low > 1:
                inner = parents > 0
                self.fail[states[inner]] = self._step(self.fail[parents[inner]].astype(np.int64), letter[inner])
            self.hit[states] = np.where(self.hit[states] > 0, self.hit[states], self.hit[self.fail[states]])
        self.next_hit = self.hit[self.fail]

    def _step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The states after one letter each; a letter of no pattern (-1) leads to the start."""
        out, states = np.zeros(len(states), np.int64), states.copy()
        todo = np.flatnonzero(letters >= 0)
        while len(todo) and len(self.edges):
            wanted = states[todo] * self.width + letters[todo]
            place = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
            known = self.edges[place] == wanted
            out[todo[known]] = place[known] + 1
            todo = todo[~known]
            todo = todo[states[todo] > 0]
            states[todo] = self.fail[states[todo]]
        return out

    def find(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, pattern number) of every pattern in every text, each pair once."""
        rows, pieces = [], []
        overlap = max(0, self.longest - 1)
        for i, text in enumerate(texts):
            for start in range(0, max(1, len(text) - overlap), PIECE):
                rows.append(i)
                pieces.append(text[start : start + PIECE + overlap])
        found, first, size = [], 0, 0
        for i, piece in enumerate(pieces):
            size += len(piece)
            if size >= LETTERS_AT_A_TIME or i + 1 == len(pieces):
                found.append(self._ends(np.array(rows[first : i + 1], np.int64), pieces[first : i + 1]))
                first, size = i + 1, 0
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        row, state = np.divmod(pairs, len(self.fail))
        counts = self.first[state + 1] - self.first[state]
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(row, counts), self.by_state[np.repeat(self.first[state], counts) + within]

    def _ends(self, rows: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Text number times states plus state, for every state reached where a pattern ends."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        codes = _code_points("".join(pieces))
        place = np.minimum(np.searchsorted(self.alphabet, codes), self.width - 1) if len(self.alphabet) else np.zeros(len(codes), np.int64)
        letters = np.where(self.alphabet[place] == codes, place, -1) if len(self.alphabet) else np.full(len(codes), -1)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        rows, starts, lengths = rows[order], starts[order], lengths[order]
        alive = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left")
        states, out = np.zeros(len(rows), np.int64), []
        for step, count in enumerate(alive):
            states[:count] = self._step(states[:count], letters[starts[:count] + step])
            at = self.hit[states[:count]].astype(np.int64)
            which = np.flatnonzero(at)
            while len(which):
                out.append(rows[which] * len(self.fail) + at[which])
                at[which] = self.next_hit[at[which]]
                which = which[at[which] > 0]
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


class NameTrie:
    """Longest names that stand in a text as whole words, from left to right without overlap.

    A word is a run of letters, digits and the signs &'- inside; what stands between two words of a
    name has to be the same in the text.
    """

    def __init__(self, names: Iterable[str]):
        self.root: dict = {}
        for name in names:
            node = self.root
            for token in self._tokens(name):
                node = node.setdefault(token, {})
            if node is not self.root:
                node[None] = name

    @staticmethod
    def _tokens(text: str) -> list[str]:
        out, start = [], 0
        for i in range(1, len(text) + 1):
            if i == len(text) or _is_word(text[i]) != _is_word(text[start]) or not _is_word(text[i]):
                out.append(text[start:i])
                start = i
        return out

    def find(self, text: str) -> list[str]:
        tokens, out, i = self._tokens(text), [], 0
        while i < len(tokens):
            node, best, j = self.root.get(tokens[i]), None, i
            while node is not None:
                j += 1
                if None in node and (j == len(tokens) or not (_is_word(tokens[j][0]) and _is_word(tokens[j - 1][-1]))):
                    best = (node[None], j)
                node = node.get(tokens[j]) if j < len(tokens) else None
            if best:
                out.append(best[0])
            i = best[1] if best else i + 1
        return out


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch in "&'-"
