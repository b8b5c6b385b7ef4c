"""Token files, ranked lexical search and whitening against plain versions, and their defined edge cases."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from newsloom.llm import lexical, token_files, whitening
from newsloom.llm.common import with_base
from newsloom.llm.queries import BYTE_BPE, QUERIES

SMALL = token_files.FileOptions(frame_bytes=256, file_bytes=4096, file_documents=7, task_text_bytes=2000, task_read_tokens=100, known_pieces=50)
DOCS = "doc_id bigint, text string, file string, base int"


def library_ids(texts):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    return [np.array(e.ids + [0], "<u4").tobytes() for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_documents():
    draw = random.Random(5)
    texts = [None, "", " ", "  two  blanks ", "tab\tand\nline \n end", "it's we'll <|endoftext|> x", "a b  c　 d", "é ñ 漢字 \U0001f600 ok", "don 't ' s", "x" * 4000]
    texts += ["".join(draw.choice(["word", " ", "  ", "'s", "\n", "9", "é", "!", "​", "\x1c", "᠎"]) for _ in range(draw.randrange(60))) for _ in range(60)]
    return [(i, t, "clash", 1) for i, t in enumerate(texts)]


def test_token_files_match_the_library(spark, tmp_path):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    manifest = token_files.write_tokens(docs, str(tmp_path / "files"), BYTE_BPE, SMALL)
    assert manifest.count() > 5
    found = token_files.read_documents(token_files.locate_documents(manifest), SMALL).orderBy("doc_id").collect()
    plain, start = library_ids([r[1] for r in rows]), 0
    for row, ids in zip(found, plain, strict=True):
        assert (row["start"], row["n_tokens"], bytes(row["ids"])) == (start, len(ids) // 4, ids)
        start += len(ids) // 4
    # Any zstandard decoder reads a file as one stream, in order.
    files = [r["file"] for r in manifest.orderBy("number").collect()]
    streams = [zstandard.ZstdDecompressor().stream_reader(open(f, "rb"), read_across_frames=True).read() for f in files]
    assert b"".join(streams) == b"".join(plain)


def test_token_files_defined_results(spark, tmp_path):
    rows = [(None, "no id", "f", 1), (2, "b", "f", 1), (2, "b", "f", 1), (2, "other", "f", 1), (1, None, "f", 1), (None, "no id", "f", 1)]
    manifest = token_files.write_tokens(spark.createDataFrame(rows, DOCS), str(tmp_path / "a"), BYTE_BPE)
    found = token_files.read_documents(token_files.locate_documents(manifest)).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, None, 1, 2, 2, 2]
    assert [r["start"] for r in found] == list(np.cumsum([0] + [r["n_tokens"] for r in found])[:-1])
    assert bytes(found[2]["ids"]) == b"\0\0\0\0"
    empty = token_files.write_tokens(spark.createDataFrame([], DOCS), str(tmp_path / "b"), BYTE_BPE)
    assert token_files.read_documents(token_files.locate_documents(empty)).count() == 0


def test_token_files_read_only_what_is_asked_for(spark, tmp_path):
    rows = [(i, f"document {i} " * 30, "f", 1) for i in range(40)]
    options = token_files.FileOptions(frame_bytes=512)
    manifest = token_files.write_tokens(spark.createDataFrame(rows, DOCS).coalesce(1), str(tmp_path / "files"), BYTE_BPE, options)
    (name,) = [r["file"] for r in manifest.collect()]
    reader = token_files.TokenFileReader(name)
    places = {r["doc_id"]: r for r in token_files.locate_documents(manifest).collect()}
    for doc_id in (3, 21):
        assert reader.ids(places[doc_id]["place"], places[doc_id]["n_tokens"]) == library_ids([rows[doc_id][1]])[0]
    assert reader.decompressed == 2
    asked = spark.createDataFrame([(3,), (21,), (21,), (77,)], "doc_id bigint")
    assert sorted(r["doc_id"] for r in token_files.fetch(manifest, asked).collect()) == [3, 21]
    data = bytearray(open(name, "rb").read())
    first = data.find(b"\x28\xb5\x2f\xfd", 4)  # the second frame: spoil its end
    data[first - 1] ^= 0xFF
    open(name, "wb").write(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.TokenFileReader(name).ids(0, 100)
    with pytest.raises(ValueError):
        open(name, "wb").write(data[:-3])
        token_files.TokenFileReader(name)


def test_op11_equals_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    found = QUERIES["op11_token_files"](spark, sf_dir).orderBy("doc_id").collect()
    start = 0
    for doc, row, ids in zip(docs, found, library_ids([d["text"] for d in docs]), strict=True):
        assert tuple(row) == (doc["doc_id"], start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_running_base(spark):
    rows = [(n, n % 5) for n in [0, 3, 4, 1 << 20, 5 << 20, 7]]
    found = {r["number"]: r["base"] for r in with_base(spark.createDataFrame(rows, "number bigint, amount bigint"), "number", "amount", 4).collect()}
    assert found == {n: sum(a for m, a in rows if m < n) for n, _ in rows}


# --- ranked lexical search ---------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    split = [(i, plain_terms(t)) for i, t in docs]
    split = [(i, t) for i, t in split if t]
    n_docs, length = len(split), sum(len(t) for _, t in split)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, wanted in asked.items():
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in words for _, words in split) + 1))) for t in wanted}
        rows = []
        for doc_id, words in split:
            m = 50 + 50 * len(words) * n_docs // length
            score = sum(weights[t] * (1_000_000_000 * words.count(t) // (1000 * words.count(t) + 20 * m)) for t in wanted if t in words)
            if score > 0 and doc_id is not None:
                rows.append((-score, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


def made_texts():
    draw = random.Random(9)
    words = [f"w{i}" for i in range(300)] + ["É", "naïve", "漢字", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.randrange(1, 80)))) for i in range(700)]
    docs += [(700 + i, docs[i][1]) for i in range(50)] + [(800, None), (801, ""), (802, "!!! ..."), (803, "W1,w1;W1 " * 3000), (None, "w5 w6 w7"), (5, "w5 w250 w251")]
    items = [(i, " ".join(draw.choices(words, k=12)) + " w0 w1 W2") for i in range(20)]
    items += [(20, None), (21, ""), (22, "nowhere"), (None, "w1"), (3, "w7 extra"), (3, "w7 extra"), (23, "w0")]
    return docs, items


@pytest.mark.parametrize("options", [lexical.SearchOptions(), lexical.SearchOptions(k=7, short_share=0.1, block_documents=1024, block_postings=3000, window=64, item_bytes=300)])
def test_lexical_search_is_exact(spark, options):
    docs, items = made_texts()
    documents = spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, text string, score int").repartition(5)
    benchmark = spark.createDataFrame([(*i, 0) for i in items], "item_id bigint, text string, rank int")
    found = sorted(tuple(r) for r in lexical.ranked_search(documents, benchmark, options).collect())
    assert found == plain_search(docs, items, options.k)


def test_lexical_search_of_nothing(spark):
    docs, items = (spark.createDataFrame([], s) for s in ("doc_id bigint, text string", "item_id bigint, text string"))
    some_docs, some_items = (spark.createDataFrame([(1, "a b")], s) for s in ("doc_id bigint, text string", "item_id bigint, text string"))
    for d, i in ((docs, items), (docs, some_items), (some_docs, items)):
        assert lexical.ranked_search(d, i).columns == ["item_id", "rank", "doc_id", "score"]
        assert lexical.ranked_search(d, i).count() == 0


def test_lexical_search_skips_long_lists():
    """A block with two frequent terms and a rare one: far fewer postings are opened than the lists hold."""
    n, draw = 30_000, np.random.default_rng(3)
    rare = np.sort(draw.choice(n, 60, replace=False))
    counts = np.full(n, 2)
    counts[rare] += 1
    term = np.concatenate([np.append([0, 1], [2] * (c - 2)) for c in counts]).astype(np.int32)
    stats = lexical.Statistics(n, 20 * n, np.array([1, 1, 6000]))
    block = lexical.Block(np.arange(n), np.full(n, 20), counts, term, np.ones(len(term), np.int64), stats)
    ids, _ = block.search(np.array([0, 1, 2]), (np.zeros(0, np.int64), np.zeros(0, np.int64)), lexical.SearchOptions(k=50, short_share=0.01, window=1024))
    assert sorted(ids) == list(rare[:50])
    assert block.opened < 0.2 * block.postings


# --- whitening ---------------------------------------------------------------------------------


def plain_whitening(vectors, components=8):
    x = np.floor(1024 * np.asarray(vectors, np.float64)) + 100_000
    n, sums = len(x), x.astype(np.int64).sum(0)
    centred = x - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x.astype(np.int64)]
    return n, deviation, centred @ basis / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check_whitening(found, ids, vectors):
    n, deviation, white, share = plain_whitening(vectors)
    got = {(r["vec_id"], r["component"]): r for r in found}
    assert len(got) == len(found) == white.size
    for c in range(white.shape[1]):
        ours = np.array([got[i, c + 1]["whitened"] for i in ids])
        sign = np.sign(ours @ white[:, c])
        assert np.abs(ours - sign * white[:, c]).max() < 1e-6
        for i, d in zip(ids, deviation):
            row = got[i, c + 1]
            assert (row["n"], int(row["deviation"])) == (n, d)
            assert abs(row["explained"] / share[c] - 1) < 1e-9 and row["identity_error"] < 1e-9


def test_op13_equals_plain_whitening(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    check_whitening(QUERIES["op13_whitening"](spark, sf_dir).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_with_odd_rows(spark, parts):
    draw = np.random.default_rng(1)
    good = [(i, (draw.normal(size=5) * [1, 2, 3, 4, 5] + 900).tolist(), "x") for i in range(300)]
    good += [(300 + i, good[0][1], "x") for i in range(100)]
    odd = [(900, None, "x"), (901, [], "x"), (902, [1.0, None, 1.0, 1.0, 1.0], "x"), (903, [float("nan")] * 5, "x"), (904, [float("inf")] * 5, "x"), (905, [1.0, 2.0], "x")]
    frame = spark.createDataFrame(odd + good, "vec_id bigint, embedding array<double>, component string").repartition(parts)
    found = whitening.whiten(frame, whitening.WhiteningOptions(least_rows=16, block_columns=2))
    check_whitening(found.collect(), [g[0] for g in good], [g[1] for g in good])


def test_whitening_defined_results(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], schema)).count() == 0
    # One varying dimension, null and repeated ids: one component for each row.
    rows = [(None, [1.0, 2.0]), (4, [2.0, 2.0]), (4, [2.0, 2.0]), (5, [9.0, 2.0])]
    found = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in found) == [(0, 1), (4, 1), (4, 1), (5, 1)]
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [1.0])], schema)).collect()


def test_deviation_beyond_63_bits(spark):
    rows = spark.createDataFrame([(i, [((-1) ** i) * (1 << 40), i], i) for i in range(4)], "vec_id bigint, x array<bigint>, index bigint")
    n, sums, low, high = whitening.exact_sums(rows, 2)
    found = {r["vec_id"]: int(r["deviation"]) for r in whitening.deviations(rows, n, sums, low, high).collect()}
    assert found == {i: (4 * (-1) ** i * (1 << 40) - sums[0]) ** 2 + (4 * i - 6) ** 2 for i in range(4)}
