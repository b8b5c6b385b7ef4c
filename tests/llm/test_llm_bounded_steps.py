"""Workers take many words, pieces or leaves in one step, and hold a bounded part of a batch."""

import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import ann, bpe, common, ngram_join, quality, queries, token_files

PIECE = re.compile(rf"[ \t\n\r\x0b\x0c]*+[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ]++(?![^ \t\n\r\x0b\x0c{re.escape(string.punctuation)}])|[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]++|[ \t\n\r\x0b\x0c]+")
PARTS = ["a", "Be", "hello", " ", "  ", "\n", "\t", ",", ".", "'s", "'", "1", "é", "×", "÷", "ɏ", "ɐ", "中", "😀", "Σ", "<|endoftext|>", "!!", "\x85", "\x1c"]


def odd_texts(seed, count):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(0, 14))) for _ in range(count)]


def test_new_words_of_many_texts_are_walked_together():
    ours, library, calls = bpe.WordBpe(queries.WORD_BPE), Tokenizer.from_file(queries.WORD_BPE), []
    walk = ours.automaton.paths
    ours.automaton.paths = lambda words: calls.append(len(words)) or walk(words)
    texts = [*odd_texts(1, 400), "z" * 3000, "é" * 2000 + "!" * 500]
    stated = [library.encode(text, add_special_tokens=False).ids for text in texts]
    assert ours.encode_all(texts) == stated
    assert len(calls) == 1
    assert [(n, ids) for n, ids, _ in ours.spelled_all(texts)] == [(len(s), " ".join(map(str, s))) for s in stated]
    assert len(calls) == 2  # what is spelled is remembered by itself
    assert list(ours.spelled_all(texts)) and len(calls) == 2


def test_letters_and_marks_are_split_as_the_pattern_does():
    letters = re.compile(r"\A[^\W\d_]+\Z")
    for i in range(0x110000):
        if chr(i).isalpha() and not 0xD800 <= i < 0xE000:
            assert letters.match(chr(i)) and bpe.WORDS.findall(chr(i)) == [chr(i)]


def test_pieces_are_those_of_the_pattern():
    texts = [t for t in odd_texts(3, 3000) if t]
    whole = [t.encode() for t in texts]
    sizes = np.array([len(w) for w in whole])
    data = b"".join(whole)
    cuts = [*np.flatnonzero(token_files.pieces_of(np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes)).tolist(), len(data)]
    assert [data[a:b].decode() for a, b in zip(cuts, cuts[1:])] == [p for t in texts for p in PIECE.findall(t)]


@pytest.mark.parametrize("remembered", [2, 250_000])
def test_many_texts_at_once_have_the_librarys_ids(remembered):
    ours, library = token_files.Encoder(queries.BYTE_BPE, remembered, True), Tokenizer.from_file(queries.BYTE_BPE)
    texts = odd_texts(4, 2000)
    stated = [library.encode(text, add_special_tokens=False).ids for text in texts]
    for start in range(0, len(texts), 500):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in ours(texts[start : start + 500])] == stated[start : start + 500]
    assert ours(["", ""]) == [b"", b""] and ours([]) == []


def test_queries_meet_their_leaves_together_in_bounded_slices(monkeypatch):
    rng = np.random.default_rng(1)
    vecs, ids = rng.normal(size=(900, 24)).astype(np.float32).astype(float), np.arange(900)
    vecs[500:510] = vecs[20]
    axes, largest = rng.normal(size=(25, 16)), float(np.linalg.norm(vecs, axis=1).max())
    rest = np.sqrt(np.maximum(largest**2 - (vecs * vecs).sum(1), 0))
    points = vecs @ axes[:24] + rest[:, None] * axes[24]
    asked, seen = ids[::5], []
    distances = ann.ProjectedTree.distances
    monkeypatch.setattr(ann.ProjectedTree, "distances", lambda tree, points: seen.append(len(points)) or distances(tree, points))
    monkeypatch.setattr(ann, "QUERY_SLICE", 64)
    search = ann.Search(asked, vecs[asked], vecs[asked] @ axes[:24], largest, 20, float("inf"))
    for start in (0, 450):
        search.block(ids[start : start + 450], vecs[start : start + 450], points[start : start + 450])
    assert max(seen) <= 64 and sum(seen) == 2 * len(asked)
    for q, best_ids, best_scores in zip(asked, search.best_ids, search.best_scores):
        scores = ann.exact_scores(np.broadcast_to(vecs[q], vecs.shape), vecs)
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:20]
        assert best_ids.tolist() == order and best_scores.tolist() == scores[order].tolist()


def test_parts_of_batches():
    texts = pa.array(["aaaa", None, "bb", "", "é" * 30, "c"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), texts], names=["id", "text"])
    parts = list(common.parts_of([batch, batch.slice(0, 0)], 1, 6))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2, 3], [4], [5]]
    assert [p.column(0).to_pylist() for p in common.parts_of([batch.slice(2)], 1, 6)] == [[2, 3], [4], [5]]


def test_workers_hold_the_sets_of_a_part_of_a_batch(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the words of document number {i} and more") for i in range(6)], "doc_id long, text string")
    taken, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: taken.append(run) or real(self, run, schema))
    monkeypatch.setattr(ngram_join, "SPAN_BYTES", 80)
    options = ngram_join.JoinOptions()
    sets = ngram_join.counted_sets(docs, options)
    given = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(range(6)), pa.array(["some words of a text " * 3] * 6)], names=["doc_id", "text_hash", "text"])
    assert [b.num_rows for b in taken[0](iter([given]))] == [1] * 6
    wanted = sets.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("cluster"), F.col("n_shingles").alias("n"), "f1", "f2")
    assert ngram_join.member_sets(docs, wanted, options).count() == 6
    found = next(iter(taken[0](iter([given])))).to_pylist()[0]
    rows = pa.RecordBatch.from_arrays([given.column(0), given.column(2), given.column(0), pa.array([found["n_shingles"]] * 6), pa.array([found["f1"]] * 6), pa.array([found["f2"]] * 6)], names=["doc_id", "text", "cluster", "n", "f1", "f2"])
    assert [b.num_rows for b in taken[1](iter([rows]))] == [1] * 6
    model = quality.fit([], quality.FMOptions(buckets=64))
    assert quality.keep_good(docs, model).count() == 6
