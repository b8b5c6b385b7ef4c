"""Token ids in seekable zstandard files, written and read back by Spark tasks.

A file is a row of independent zstandard frames, each of little-endian unsigned 32-bit ids of whole
documents (a document longer than a frame takes several of its own). Two skippable frames follow:
the document directory (ids and token counts, as an Arrow stream) and the seek table of the public
seekable format, with each frame's compressed size, plain size and checksum (the low half of XXH64
of the plain bytes). The table is found from the end of the file, so a reader fetches by range, and
decompresses, only the frames of the documents it wants; a frame that does not match its checksum
raises. Any zstandard decoder reads the whole file as one stream of ids.

Documents are dealt over tasks by ranges of doc_id, texts before they become ids, and each task
writes files of bounded size in ascending order. Names are unique per attempt and only files of the
written manifest count, so a lost or repeated task leaves at most unread files. Where a file's ids
begin among all ids follows from the manifest's token counts.

Encoding is the tokenizers library's. For a byte-level model without a normalizer, texts are cut
where its own splitting always cuts; the library encodes a distinct piece once, and the worker
remembers a bounded number of them.

Defined results: a null or empty text has the end id alone; rows with a null doc_id come first; rows
that repeat a doc_id are documents of their own, in the order of a hash of their texts; an empty
table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import json
import os
import re
import string
import struct
import sys
import types
import uuid
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import broadcast_if_small, spans, with_base, written

# Fixed values of the seekable format: magic numbers of the skippable frames and of the footer.
DIRECTORY_MAGIC, SEEK_TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
WITH_CHECKSUMS = 0x80


@dataclass(frozen=True)
class FileOptions:
    """Sizes in plain bytes; `end_id` closes each document."""

    end_id: int = 0
    frame_bytes: int = 256 << 10
    file_bytes: int = 256 << 20
    file_documents: int = 1 << 20
    task_text_bytes: int = 16 << 20
    task_read_tokens: int = 4 << 20
    level: int = 3
    known_pieces: int = 250_000


def _system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


# --- encoding ---------------------------------------------------------------------------------

# Blanks that every reading of Unicode knows, rarer characters that some count as blanks, letters, and ASCII punctuation.
_WS, _LETTERS, _MARKS = r" \t\n\r\x0b\x0c", r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ", re.escape(string.punctuation)
_RARE = "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# What no added token may be: something with blanks, or first letters and then a mark.
_PARTED = re.compile(rf"[{_WS}{_RARE}]|\A[{_LETTERS}]+[{_MARKS}]")
# The same by byte of UTF-8: blanks, ASCII letters, ASCII punctuation.
_IS_WS, _IS_LETTER, _IS_MARK = (np.isin(np.arange(256), list(members)) for members in (b" \t\n\r\x0b\x0c", string.ascii_letters.encode(), string.punctuation.encode()))


def pieces_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, as a mask over their UTF-8 bytes; `starts`: where each text begins.

    A piece begins with every run of blanks, and where a mark follows the letters that a text or
    whatever comes after blanks begins with.
    """
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    blank, letter = _IS_WS[data], _IS_LETTER[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))  # of two bytes: U+00C0 to U+024F without the two signs
    if len(lead):
        high, low = data[lead], data[lead + 1]
        lead = lead[((high == 0xC3) & (low != 0x97) & (low != 0xB7)) | ((high > 0xC3) & (high < 0xC9)) | ((high == 0xC9) & (low <= 0x8F))]
        letter[lead] = letter[lead + 1] = True
    out = first.copy()
    out[1:-1] |= blank[1:] & ~blank[:-1]
    # Runs of letters: their begins and ends pair up in order.
    begins, ends = first[:-1] & letter, np.zeros(len(data) + 1, bool)
    begins[1:] |= letter[1:] & ~letter[:-1]
    ends[1:-1] = letter[:-1] & (~letter[1:] | first[1:-1])
    ends[-1] = letter[-1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    kept = (first[begins] | blank[begins - 1]) & (ends < len(data))
    ends = ends[kept]
    out[ends[_IS_MARK[data[ends]]]] = True
    return out[:-1]


class Encoder:
    """Ids of whole texts as bytes of little-endian unsigned 32-bit numbers.

    The library's own splitting begins anew where a run of blanks begins, and between a letter and a
    punctuation mark; so a text's ids are those of such pieces, one after the other. A text with rare
    kinds of blanks is encoded as a whole. Texts are cut, and their distinct pieces found, many texts
    at once. Of the pieces met, a bounded number is remembered: when half of it is new, those that
    were not met since the last time are forgotten.
    """

    def __init__(self, path: str, known_pieces: int, by_piece: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._most, self._young, self._old = known_pieces, {}, {}
        line_end = self._tokenizer.encode("\n", add_special_tokens=False).ids
        self._line_end = line_end[0] if line_end else 0
        self.by_piece = by_piece and len(line_end) == 1

    @staticmethod
    def splits_at_blanks(path: str) -> bool:
        """Whether texts may be cut. Found once, so that workers need not parse the whole file."""
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        split = stated.get("pre_tokenizer") or {}
        level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        added = stated.get("added_tokens") or []
        plain = not any(a.get("lstrip") or a.get("rstrip") or _PARTED.search(a["content"]) for a in added)
        return bool(level and plain and not stated.get("normalizer"))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_lines(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces without line ends, many to a call: a line end between them is a token of its own."""
        lines = [b"\n".join(pieces[i : i + 64]).decode() for i in range(0, len(pieces), 64)]
        out = []
        for encoded in self._tokenizer.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(encoded.ids, "<u4")
            raw, start = ids.tobytes(), 0
            for end in (4 * np.flatnonzero(ids == self._line_end)).tolist():
                out.append(raw[start:end])
                start = end + 4
            out.append(raw[start:])
        return out

    def _learn(self, met: list[bytes], even: list[bool]) -> dict[bytes, bytes]:
        """All pieces that are met are in the memory that comes back; even: nothing but a blank before a word."""
        if 2 * len(self._young) >= self._most:
            self._young, self._old = {}, self._young
        known, earlier = self._young, self._old
        lines, odd = [], []
        for piece, of_lines in zip(met, even):
            if piece not in known:
                if piece in earlier:
                    known[piece] = earlier[piece]
                else:
                    (lines if of_lines else odd).append(piece)
        known.update(zip(lines, self._ids_of_lines(lines)))
        known.update(zip(odd, self._ids([p.decode() for p in odd])))
        return known

    def _by_piece(self, texts: list[bytes]) -> list[bytes]:
        whole, lengths = b"".join(texts), np.array([len(t) for t in texts], np.int64)
        if not whole:
            return [b""] * len(texts)
        data, starts = np.frombuffer(whole, np.uint8), np.cumsum(lengths) - lengths
        cuts = np.flatnonzero(pieces_of(data, starts))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data))), pa.py_buffer(whole)]).dictionary_encode()
        _, offsets, held = pieces.dictionary.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(pieces.dictionary) + 1]
        distinct = held.to_pybytes()[: offsets[-1]]
        met = [distinct[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        raw = np.frombuffer(distinct, np.uint8)
        blanks = np.add.reduceat(_IS_WS[raw], offsets[:-1], dtype=np.int64)
        even = (blanks == 0) | ((blanks == 1) & (raw[offsets[:-1]] == 32) & (np.diff(offsets) > 1))
        found = list(map(self._learn(met, even.tolist()).__getitem__, met))
        # The ids of a text are those of its pieces, copied from the distinct pieces' ids.
        ids, counts = np.frombuffer(b"".join(found), "<u4"), np.array(list(map(len, found)), np.int64) // 4
        which = pieces.indices.to_numpy()
        sizes, begins = counts[which], (np.cumsum(counts) - counts)[which]
        ends = np.cumsum(sizes)
        all_ids = ids[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()
        places = np.append(0, 4 * ends)[np.searchsorted(cuts, np.append(starts, len(data)))].tolist()
        return [all_ids[a:b] for a, b in zip(places, places[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._ids(texts)
        rare = [i for i, text in enumerate(texts) if any(map(text.__contains__, _RARE[:4] if text.isascii() else _RARE))]
        cut = [text.encode() for text in texts]
        for i in rare:
            cut[i] = b""
        out = self._by_piece(cut)
        for i, ids in zip(rare, self._ids([texts[i] for i in rare])):
            out[i] = ids
        return out


def _encoder(path: str, known_pieces: int, by_piece: bool) -> Encoder:
    """One encoder per worker process: a global of this module would start empty in every task."""
    shelf = sys.modules.setdefault("newsloom_worker_shelf", types.ModuleType("newsloom_worker_shelf")).__dict__
    key = f"encoder {path}"
    if key not in shelf:
        shelf[key] = Encoder(path, known_pieces, by_piece)
    return shelf[key]


# --- files ------------------------------------------------------------------------------------


class TokenFileWriter:
    """Streams documents into one file; holds a frame of ids, and a directory entry per document."""

    def __init__(self, uri: str, options: FileOptions, id_type: pa.DataType):
        system, path = _system(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self._out, self._options, self._id_type = system.open_output_stream(path, compression=None), options, id_type
        self._zstd = zstandard.ZstdCompressor(level=options.level)
        self._held, self._held_bytes = [], 0
        self._frames: list[tuple[int, int, int]] = []
        self._ids, self._counts = [], []
        self.documents = self.tokens = self.bytes = 0

    def add(self, doc_id, ids: bytes) -> None:
        most = self._options.frame_bytes
        if self._held_bytes and self._held_bytes + len(ids) > most:
            self._flush()
        for start in range(0, len(ids), most):
            part = ids[start : start + most]
            self._held.append(part)
            self._held_bytes += len(part)
            if self._held_bytes >= most:
                self._flush()
        if len(ids) > most:
            self._flush()
        self._ids.append(doc_id)
        self._counts.append(len(ids) // 4)
        self.documents += 1
        self.tokens += len(ids) // 4
        self.bytes += len(ids)

    def _flush(self) -> None:
        if self._held:
            plain = b"".join(self._held)
            packed = self._zstd.compress(plain)
            self._out.write(packed)
            self._frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self._held, self._held_bytes = [], 0

    def full(self) -> bool:
        return self.bytes >= self._options.file_bytes or self.documents >= self._options.file_documents

    def close(self) -> None:
        self._flush()
        listed = pa.table({"doc_id": pa.array(self._ids, self._id_type), "n_tokens": pa.array(self._counts, pa.int64())})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, listed.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(listed, max_chunksize=65_536)
        directory = sink.getvalue()
        self._out.write(struct.pack("<II", DIRECTORY_MAGIC, len(directory)) + directory)
        # A skippable frame is listed with a plain size of 0.
        self._frames.append((len(directory) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *frame) for frame in self._frames)
        footer = struct.pack("<IBI", len(self._frames), WITH_CHECKSUMS, FOOTER_MAGIC)
        self._out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self._out.close()


class TokenFileReader:
    """Reads ranges of ids. `decompressed` counts the frames that were opened."""

    def __init__(self, uri: str):
        system, path = _system(uri)
        self._file = system.open_input_file(path)
        size = self._file.size()
        count, flags, magic = struct.unpack("<IBI", self._range(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & WITH_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        table = self._range(size - 9 - 12 * count - 8, 12 * count + 8)
        if struct.unpack("<II", table[:8]) != (SEEK_TABLE_MAGIC, 12 * count + 9):
            raise ValueError("the seek table is damaged")
        packed, plain, self._sums = np.frombuffer(table, "<u4", offset=8).reshape(-1, 3).astype(np.int64).T
        self._places = np.concatenate([[0], np.cumsum(packed)])
        self._starts = np.concatenate([[0], np.cumsum(plain)])
        self._zstd = zstandard.ZstdDecompressor()
        self._last: tuple[int, bytes] = (-1, b"")
        self.decompressed = 0

    def _range(self, start: int, length: int) -> bytes:
        data = self._file.read_at(length, start) if start >= 0 else b""
        if len(data) != length:
            raise ValueError("a token file is cut off")
        return data

    def directory(self) -> Iterator[pa.RecordBatch]:
        """Batches of doc_id and n_tokens in the order of the file."""
        start, end = int(self._places[-2]), int(self._places[-1])
        data = self._range(start, end - start)
        if struct.unpack("<I", data[:4])[0] != DIRECTORY_MAGIC:
            raise ValueError("the document directory is missing")
        yield from pa.ipc.open_stream(pa.py_buffer(data).slice(8))

    def _frame(self, number: int) -> bytes:
        if self._last[0] != number:
            start, end = int(self._places[number]), int(self._places[number + 1])
            plain = self._zstd.decompress(self._range(start, end - start), max_output_size=int(self._starts[number + 1] - self._starts[number]))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self._sums[number]:
                raise ValueError(f"frame {number} does not match its checksum")
            self._last = (number, plain)
            self.decompressed += 1
        return self._last[1]

    def ids(self, first: int, count: int) -> bytes:
        """`count` ids from number `first` of the file on."""
        start, end = 4 * first, 4 * (first + count)
        number, parts = int(np.searchsorted(self._starts, start, "right")) - 1, []
        while start < end:
            plain, base = self._frame(number), int(self._starts[number])
            part = plain[start - base : end - base]
            parts.append(part)
            start += len(part)
            number += 1
        return b"".join(parts)

    def close(self) -> None:
        self._file.close()


# --- Spark jobs -------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, options: FileOptions = FileOptions()) -> DataFrame:
    """Writes the files and their manifest, and returns the manifest as stored: number (its order), file, documents, tokens."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    by_piece = Encoder.splits_at_blanks(tokenizer)
    parts = 1 + (docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // options.task_text_bytes
    ordered = docs.repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer, options.known_pieces, by_piece), struct.pack("<I", options.end_id)
        writer, name, done = None, "", []
        for batch in batches:
            for start, stop in spans(batch.column(1), 3 << 20):
                for i, ids in enumerate(encode(batch.column(1).slice(start, stop - start).to_pylist()), start):
                    if writer is None:
                        name = f"{folder}/{uuid.uuid4().hex}.zst"
                        writer = TokenFileWriter(name, options, batch.schema.field(0).type)
                    writer.add(batch.column(0)[i].as_py(), ids + end)
                    if writer.full():
                        writer.close()
                        done.append((name, writer.documents, writer.tokens))
                        writer = None
        if writer is not None:
            writer.close()
            done.append((name, writer.documents, writer.tokens))
        first = TaskContext.get().partitionId() << 20
        columns = [[first + i for i in range(len(done))], *([d[j] for d in done] for j in range(3))]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["number", "file", "documents", "tokens"])

    return written(ordered.mapInArrow(run, "number bigint, file string, documents bigint, tokens bigint"), "token-manifest")


def locate_documents(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, file, place (first id in the file), start (ids of all documents before), n_tokens; from the files' directories alone."""
    files = max(1, manifest.count())
    based = with_base(manifest, "number", "tokens").select("number", "file", "base")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                reader, place = TokenFileReader(file), 0
                for listed in reader.directory():
                    counts = listed.column(1).to_numpy()
                    places = place + np.cumsum(counts) - counts
                    place += int(counts.sum())
                    out = [listed.column(0), pa.array([file] * len(counts)), pa.array(places), pa.array(base + places), listed.column(1)]
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "file", "place", "start", "n_tokens"])
                reader.close()

    # A file a task: the rows are few, and would otherwise all be joined into one.
    return based.repartition(files, "number").mapInArrow(run, f"doc_id {id_type}, file string, place bigint, start bigint, n_tokens bigint")


def read_documents(wanted: DataFrame, options: FileOptions = FileOptions()) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian bytes) of the wanted rows of `locate_documents`.

    Only frames that hold a wanted document are read. Rows are dealt by file and range of ids, as
    many tasks as the wanted ids fill, each in file order.
    """
    tasks = 1 + (wanted.agg(F.sum("n_tokens")).first()[0] or 0) // options.task_read_tokens
    dealt = wanted.withColumn("_range", F.floor(F.col("place") / options.task_read_tokens)).repartition(tasks, "file", "_range").sortWithinPartitions("file", "place").drop("_range")
    kind = wanted.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "n_tokens", "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            found, size, first = [], 0, 0
            for i, (file, place, count) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "place", "n_tokens")))):
                if file != opened:
                    if reader is not None:
                        reader.close()
                    reader, opened = TokenFileReader(file), file
                found.append(reader.ids(place, count))
                size += 4 * count
                if size >= 16 << 20 or i + 1 == batch.num_rows:
                    part = batch.slice(first, len(found))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), pa.array(found, pa.binary())], names=names)
                    found, size, first = [], 0, i + 1
        if reader is not None:
            reader.close()

    return dealt.select("doc_id", "file", "place", "start", "n_tokens").mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


def fetch(manifest: DataFrame, ids: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The documents whose doc_id is among `ids` (column doc_id), by range reads of their frames."""
    asked = ids.select("doc_id").distinct()
    return read_documents(locate_documents(manifest, id_type).join(broadcast_if_small(asked, asked.count(), 16), "doc_id", "left_semi"))
