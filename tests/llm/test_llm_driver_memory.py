"""What the driver holds and starts stays small."""

import pyarrow as pa
from pyspark.sql import functions as F

from newsloom.llm import components as comp
from newsloom.llm import ngram_join, quality


def chain(spark, n):
    return spark.createDataFrame([(i, i + 1) for i in range(n)] + [(7, 7), (None, 3)], "a long, b long")


def test_a_round_of_components_is_one_table_and_one_check(spark, monkeypatch):
    tables, checks, freed = [], [], []
    written, release, edges = comp.written, comp.release, chain(spark, 40)
    take = type(edges).take
    monkeypatch.setattr(comp, "written", lambda df, purpose: tables.append(purpose) or written(df, purpose))
    monkeypatch.setattr(comp, "release", lambda session: freed.append(1) or release(session))
    monkeypatch.setattr(type(edges), "take", lambda self, n: checks.append(n) or take(self, n))
    found = comp.components(edges)
    monkeypatch.undo()
    assert sorted(found.collect()) == [(i, 0) for i in range(41)]
    assert len(tables) > 2 and len(checks) == len(tables)
    assert len(freed) == len(tables) - 1


def test_only_edges_that_are_not_stars_are_tangled(spark):
    def nodes(*edges):
        return sorted(r["node"] for r in comp._tangled(spark.createDataFrame(edges, "a long, b long")).collect())

    assert nodes((1, 0), (2, 0), (5, 4)) == []
    assert nodes((1, 0), (2, 1)) == [1]
    assert nodes((3, 0), (3, 1)) == [3]


def test_empty_edges_have_no_components(spark):
    assert comp.components(chain(spark, 3).limit(0)).collect() == []


def test_the_join_lets_go_in_every_round(spark, monkeypatch):
    freed, tables = [], []
    written = ngram_join.written
    monkeypatch.setattr(ngram_join, "release", lambda session: freed.append(1))
    monkeypatch.setattr(ngram_join, "written", lambda df, purpose: tables.append(purpose) or written(df, purpose))
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[i:] + [f"x{i}"]) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = ngram_join.jaccard_components(docs, ngram_join.JoinOptions(pack_sets=2, packs_per_round=1))
    assert {r["component_id"] for r in found.where(F.col("n_shingles") > 0).collect()} == {0}
    rounds = tables.count("join-routes")
    assert rounds and len(freed) == 3 + 3 * rounds


def test_training_gives_arrows_memory_back(spark, monkeypatch):
    held = []
    monkeypatch.setattr(quality, "give_back", lambda: held.append(pa.total_allocated_bytes()))
    docs = spark.createDataFrame([(i, f"good words {i} " * (1 + i % 2)) for i in range(40)], "doc_id long, text string")
    before = pa.total_allocated_bytes()
    quality.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")))
    assert len(held) == 1 and held[0] <= before
