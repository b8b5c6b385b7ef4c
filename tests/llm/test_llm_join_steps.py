"""The n-gram join takes the words of many texts in one step, and few rounds however many sets a cluster has."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import components as comp
from newsloom.llm import ngram_join

PARTS = ["a", "B", "b", "é", "AB", "İ", " ", " ", " ", "\t", "\x0b", "\x1c", "\x85", " ", "\n", "\0", "x" * 30]


def plain_grams(text, n):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = min(n, len(words))
    return tuple(sorted({tuple(words[i : i + n]) for i in range(len(words) - n + 1)})) if words else ()


@pytest.mark.parametrize("n", [1, 2, 3, 5])
@pytest.mark.parametrize("block", [16, 1 << 18])
def test_sets_of_many_texts_are_those_of_each(n, block):
    rng = random.Random(2)
    texts = [None, "", " ", "a", " A", "a b", "A  b", "a b c", *("".join(rng.choices(PARTS, k=rng.randrange(60))) for _ in range(600)), None]
    shingler = ngram_join.Shingler(n)
    shingler.block = block
    members, places = shingler(pa.array(["before", *texts, "after"]).slice(1, len(texts)))
    sets = [members[a:b].tolist() for a, b in zip(places, places[1:])]
    stated = [plain_grams(text, n) for text in texts]
    assert [len(s) for s in sets] == [len(s) for s in stated]
    assert all(s == sorted(set(s)) for s in sets)
    marks = list(zip(*(f.tolist() for f in ngram_join.fingerprints(members, places))))
    # Equal sets, and only these, are alike.
    assert len(set(stated)) == len({tuple(s) for s in sets}) == len(set(zip(stated, map(tuple, sets)))) == len(set(zip(stated, marks))) == len(set(marks))
    assert all(len(part) == 0 for part in [*shingler(pa.array([None, ""]))[:1], *shingler(pa.array([], pa.string()))[:1]])


def test_a_cluster_takes_few_rounds_however_many_sets_it_has(spark, monkeypatch):
    rounds, written = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, purpose: rounds.append(purpose) or written(df, purpose))
    # Sets that share half of their members with each neighbour are one cluster without a link; two equal but for a word are linked.
    texts = [" ".join(f"w{i + j}" for j in range(8)) for i in range(0, 240, 4)]
    texts += [" ".join(f"v{j}" for j in range(60)), " ".join(f"v{j}" for j in range(1, 60))]
    options = ngram_join.JoinOptions(words=1, percent=90, counted=100, pack_sets=2, packs_per_round=1)
    monkeypatch.setattr(ngram_join.JoinOptions, "prefix", lambda self, n: n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reps = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, options).collect()}
    assert reps == {i: i for i in range(61)} | {61: 60}
    chain = [(i, 8, [i, i + 1], []) for i in range(60)]
    held = ngram_join.clusters(spark.createDataFrame(chain, "rep long, n long, low array<long>, more array<long>"), ngram_join.JoinOptions(percent=10))[1]
    held = ngram_join.written(held.select("rep", "gram", "lead"), "held")
    sets = [(i, 0, 8, np.arange(i, i + 8, dtype=np.uint64).tobytes()) for i in range(60)]
    sets = ngram_join.written(spark.createDataFrame(sets, "rep long, cluster long, n long, members binary"), "sets")
    rounds.clear()
    assert ngram_join._rounds(sets, held, options).collect() == []
    # Before, 30 rounds of one pack.
    assert 3 <= rounds.count("join-routes") <= 6


def test_few_edges_are_joined_in_the_driver(spark, monkeypatch):
    rng = random.Random(4)
    for kind in ("long", "int", "string"):
        edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(5, 5), (None, 3)]
        rows = spark.createDataFrame(edges, "a long, b long").select(F.col("a").cast(kind), F.col("b").cast(kind))
        table = ngram_join.written(rows, "edges")
        expected = sorted(comp.components(table).collect())
        assert sorted(comp.components_of_few(table).collect()) == sorted(comp.components_of_few(table, 10).collect()) == expected
        assert comp.components_of_few(table).schema["node"].dataType == rows.schema["a"].dataType
    table = ngram_join.written(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), "edges")
    with monkeypatch.context() as patch:
        patch.setattr(comp, "components", None)
        assert sorted(comp.components_of_few(table).collect()) == [(1, 1), (2, 1), (3, 1)]
        assert comp.components_of_few(ngram_join.written(table.limit(0), "edges")).collect() == []
