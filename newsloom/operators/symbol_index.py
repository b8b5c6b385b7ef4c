"""A dictionary of any size as an index of hashes, searched in one pass over the texts.

Symbols and names are numbered in dictionary order and dealt into parts, files that a worker maps into
memory. A part holds the sorted hashes of its symbols and names; one bit field tells for all parts which
hashes are none of theirs. A text's windows of every length that the dictionary has are hashed by running
sums; the few that pass the bit field are looked up, and what is found is compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes whose running sums are held together, unless one word is longer.
BLOCK = 1 << 18
#: Bits of the bit field for each symbol and name.
BITS_EACH = 16


class SpanHash:
    """Hashes of spans of bytes: sums of the bytes' numbers times powers of an odd base, from running sums."""

    base = 0x9E3779B97F4A7C15

    def __init__(self):
        with np.errstate(over="ignore"):
            x = (np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93)) ^ U64(0x2545F4914F6CDD1D)
            x = (x ^ (x >> U64(32))) * U64(self.base)
            self.numbers = x ^ (x >> U64(29))
        self._powers = self._inverse = np.ones(1, U64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self._powers) < len(data) + 1:
            powers = [np.full(len(data) + 1, base, U64) for base in (self.base, pow(self.base, -1, 1 << 64))]
            for p in powers:
                p[0] = 1
            self._powers, self._inverse = (np.cumprod(p, dtype=U64) for p in powers)
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.numbers[data] * self._powers[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (sums[starts + lengths] - sums[starts]) * self._inverse[starts]
            x = (x ^ np.asarray(lengths, U64)) * U64(0xD6E8FEB86659FD93)
            return x ^ (x >> U64(32))

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Of every text of an array without nulls."""
        data, ends = letters_of(texts)
        starts, out, done = np.concatenate([[0], ends[:-1]]).astype(np.int64), np.zeros(len(ends), U64), 0
        while done < len(ends):
            low = int(starts[done])
            end = max(done + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
            sums = self.sums(data[low : int(ends[end - 1])])
            out[done:end] = self.spans(sums, starts[done:end] - low, ends[done:end] - starts[done:end])
            done = end
        return out


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (none null) one after another, and where each ends."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    letters = texts.buffers()[2]
    data = np.frombuffer(letters, np.uint8)[places[0] : places[-1]] if letters is not None else np.zeros(0, np.uint8)
    return data, places[1:] - places[0]


PART_SCHEMA = "partition int, number int, letters bigint, lengths array<int>, patterns bigint, data binary"


def part_builder(part_letters: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (symbol, ord, low, names) in dictionary order become parts of at least so many letters, PART_SCHEMA."""

    def part(rows: pa.Table, partition: int, number: int, letters: int) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        symbol, ord_, low, names = (rows.column(c).combine_chunks() for c in ("symbol", "ord", "low", "names"))
        listed = names.flatten()
        owner = np.concatenate([np.arange(len(low)), pc.list_parent_indices(names).to_numpy()]).astype(np.int32)
        patterns = pa.concat_arrays([low, listed])
        used = pc.greater(pc.fill_null(pc.binary_length(patterns), 0), 0)
        patterns, owner = patterns.filter(used), owner[used.to_numpy(zero_copy_only=False)]
        is_symbol = np.arange(len(low) + len(listed))[used.to_numpy(zero_copy_only=False)] < len(low)
        hashing = SpanHash()
        hashes, symbols = hashing.whole(patterns), hashing.whole(symbol)
        order, by_symbol = np.lexsort((owner, hashes)), np.argsort(symbols, kind="stable")
        columns = {
            "symbol": symbol, "ord": ord_, "low": low, "names": names, "hash": pa.array(hashes[order]), "owner": pa.array(owner[order]),
            "is_symbol": pa.array(is_symbol[order]), "symbol_hash": pa.array(symbols[by_symbol]), "symbol_owner": pa.array(by_symbol.astype(np.int32)),
        }
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()]
        batch = pa.RecordBatch.from_arrays(lists, names=list(columns))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, batch.schema) as writer:
            writer.write_batch(batch)
        lengths = np.unique(pc.binary_length(patterns).to_numpy(zero_copy_only=False)).astype(np.int32)
        out = [[partition], [number], [letters], [lengths.tolist()], [len(patterns)], [sink.getvalue().to_pybytes()]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=["partition", "number", "letters", "lengths", "patterns", "data"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, number, held, letters = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            names = batch.column("names")
            sizes = pc.fill_null(pc.binary_length(batch.column("low")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes += np.bincount(pc.list_parent_indices(names).to_numpy(), pc.fill_null(pc.binary_length(names.flatten()), 0).to_numpy(zero_copy_only=False), len(sizes)).astype(np.int64)
            ends, start = np.cumsum(sizes), 0
            while start < len(ends):
                before = int(ends[start - 1]) if start else 0
                stop = min(len(ends), int(np.searchsorted(ends, before + part_letters - letters)) + 1)
                held.append(batch.slice(start, stop - start))
                letters += int(ends[stop - 1]) - before
                if letters >= part_letters:
                    yield part(pa.Table.from_batches(held), partition, number, letters)
                    number, held, letters = number + 1, [], 0
                start = stop
        if held:
            yield part(pa.Table.from_batches(held), partition, number, letters)

    return run


class Part:
    """A part as it lies in its file."""

    def __init__(self, source: pa.NativeFile | pa.Buffer):
        batch = pa.ipc.open_file(source).get_batch(0)
        self.symbol, self.ord, self.low, self.names, hash_, owner, is_symbol, symbol_hash, symbol_owner = (c.flatten() for c in batch.columns)
        self.hash, self.owner, self.symbol_hash, self.symbol_owner = (c.to_numpy() for c in (hash_, owner, symbol_hash, symbol_owner))
        self.is_symbol = is_symbol

    def entry(self, i: int) -> tuple[str, int, str, list[str]]:
        """symbol, ord, low and names of a symbol."""
        return self.symbol[i].as_py(), self.ord[i].as_py(), self.low[i].as_py(), [n for n in self.names[i].as_py() or [] if n]

    def held(self, hashes: np.ndarray, symbols_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """Number of the given hash and of the symbol, for every symbol or name of that hash."""
        low, high = np.searchsorted(self.hash, hashes), np.searchsorted(self.hash, hashes, "right")
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        at = np.repeat(low[found], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        which = np.repeat(found, counts)
        if symbols_only:
            kept = np.asarray(self.is_symbol.take(pa.array(at)), bool) if len(at) else np.zeros(0, bool)
            at, which = at[kept], which[kept]
        return which, self.owner[at].astype(np.int64)

    def numbers(self, symbols: list[str], hashes: np.ndarray) -> dict[str, int]:
        """Numbers of those of the given symbols that are in this part."""
        at = np.searchsorted(self.symbol_hash, hashes, "right") - 1
        found = {}
        for i in np.flatnonzero((at >= 0) & (self.symbol_hash[np.maximum(at, 0)] == hashes) if len(self.symbol_hash) else np.zeros(len(at), bool)):
            number = int(self.symbol_owner[at[i]])
            if self.symbol[number].as_py() == symbols[i]:
                found[symbols[i]] = number
        return found


class Windows:
    """The windows of texts that may be symbols or names, by the bit field of all parts."""

    def __init__(self, bits: np.ndarray, lengths: list[int]):
        self.bits, self.lengths, self.longest = bits, np.array(sorted(lengths), np.int64), max(lengths, default=1)
        self.shift = U64(64 - (len(bits) * 8 - 1).bit_length())
        self.hashing = SpanHash()

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, hash) of windows whose bit is set."""
        at, found = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        rows, pieces, size = [], [], 0

        def search() -> None:
            data, ends = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces])
            sums = self.hashing.sums(data)
            number = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
            room = ends[number] - np.arange(len(data)) if len(data) else np.zeros(0, np.int64)
            for length in self.lengths:
                starts = np.flatnonzero(room >= length)
                hashes = self.hashing.spans(sums, starts, length)
                place = hashes >> self.shift
                set_ = (self.bits[place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & 1 > 0
                at.append(np.array(rows, np.int64)[number[starts[set_]]])
                found.append(hashes[set_])

        for i, text in enumerate(texts):
            # Longer texts are cut into pieces that overlap by all but one byte of the longest window.
            for start in range(0, max(1, len(text) - self.longest + 1), BLOCK):
                rows.append(i)
                pieces.append(text[start : start + BLOCK + self.longest - 1])
                size += len(pieces[-1])
                if size >= BLOCK:
                    search()
                    rows, pieces, size = [], [], 0
        if pieces:
            search()
        return np.concatenate(at), np.concatenate(found)


def bit_field(patterns: int) -> np.ndarray:
    return np.zeros(1 << max(0, (patterns * BITS_EACH - 1).bit_length() - 3) if patterns else 1, np.uint8)


def set_bits(bits: np.ndarray, hashes: np.ndarray) -> None:
    place = hashes >> U64(64 - (len(bits) * 8 - 1).bit_length())
    np.bitwise_or.at(bits, place >> U64(3), np.uint8(1) << (place & U64(7)).astype(np.uint8))
