"""The n-gram join moves no texts for a few copies, and a group of near copies makes few rows."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from newsloom.llm import common, ngram_join

PAIRS = "rep long, gram long, lead boolean"


def near_copies(count, words=120):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(words)]
    texts = []
    for i in range(count):
        text = list(base)
        text[rng.randrange(words)] = f"x{i}"
        texts.append(" ".join(text))
    return texts


def test_copies_leave_without_a_shuffle_of_texts(spark, monkeypatch, capsys):
    rows = [(1, "a b c d", "x"), (2, "A b c d", "y"), (3, "other words here", None), (3, "a b c d", "z"), (None, "a b c d", "n"), (4, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngram_join.keep_first(docs)
        capsys.readouterr()
        kept.explain()
        plan = capsys.readouterr().out
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        monkeypatch.setattr(ngram_join, "broadcast_if_small", lambda df, *_: df)
        shuffled = ngram_join.keep_first(docs)
        found = [sorted(map(str, map(tuple, df.collect()))) for df in (kept, shuffled)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found[0] == found[1] == sorted(map(str, [rows[0], rows[2], rows[4], rows[5]]))


def test_near_copies_meet_a_pack_in_few_rows(spark, monkeypatch):
    made, routes = [], []
    meetings, routed = ngram_join._meetings, ngram_join._routes
    monkeypatch.setattr(ngram_join, "_meetings", lambda *a: made.append(meetings(*a).count()) or meetings(*a))
    monkeypatch.setattr(ngram_join, "_routes", lambda *a: routes.append(a) or routed(*a))
    docs = spark.createDataFrame(list(enumerate(near_copies(40))), "doc_id long, text string")
    found = ngram_join.jaccard_components(docs, ngram_join.JoinOptions(pack_sets=8, packs_per_round=2))
    assert {r["component_id"] for r in found.collect()} == {0}
    # Before, a row for each member that a set shares with the pack, over ten times as many.
    assert routes and 0 < sum(made) <= 2 * 40 * len(routes)


def test_routes_are_those_of_all_members(spark):
    rng = random.Random(3)
    sets = [(rep, rng.randrange(20, 30), rng.randrange(4)) for rep in range(30)]  # rep, n, comp
    grams = {rep: rng.sample(range(40), rng.randrange(0, 9)) for rep, _, _ in sets}
    pack_of = {rep: rng.randrange(4) for rep, _, _ in sets if rep % 3 == 0}
    held = spark.createDataFrame([(rep, g, i == 0) for rep, own in grams.items() for i, g in enumerate(own)], PAIRS)
    waiting = spark.createDataFrame([(rep, n, 0, comp) for rep, n, comp in sets], "rep long, n long, cluster long, comp long")
    packed = waiting.join(spark.createDataFrame(list(pack_of.items()), "rep long, pack_no long"), "rep").select("rep", "n", "comp", "cluster", "pack_no")
    expected = set()
    for rep, n, comp in sets:
        for pack in range(4):
            for gram in grams[rep]:
                there = [(m, c) for r, m, c in sets if pack_of.get(r) == pack and gram in grams[r]]
                near = there and 100 * n >= 90 * min(m for m, _ in there) and 100 * max(m for m, _ in there) >= 90 * n
                if near and any(c != comp for _, c in there) and pack_of.get(rep, -1) < pack:
                    expected.add((rep, n, 0, comp, pack))
    got = ngram_join._routes(waiting, packed, held, 90).select("rep", "n", "cluster", "comp", "pack_no").collect()
    assert expected and sorted(map(tuple, got)) == sorted(expected)
    assert ngram_join._routes(waiting, packed, held.where("lead"), 90).count() < len(expected)


def test_a_set_has_one_lead_member(spark):
    reps = spark.createDataFrame([(i, 4, [1, 2, 10 + i], [3]) for i in range(3)] + [(9, 2, [2, 5], [3])], "rep long, n long, low array<long>, more array<long>")
    options = ngram_join.JoinOptions(percent=50)
    held = ngram_join.clusters(reps, options)[1]
    by_rep = held.groupBy("rep").agg(F.sum(F.col("lead").cast("int")).alias("leads")).collect()
    assert by_rep and all(r["leads"] == 1 for r in by_rep)
    most = held.groupBy("gram").count().join(held, "gram").groupBy("rep").agg(F.max("count").alias("most"), F.max(F.when(F.col("lead"), F.col("count"))).alias("led"))
    assert all(r["most"] == r["led"] for r in most.collect())


def test_workers_let_go_of_free_memory_after_a_task(monkeypatch):
    common.trim()
    freed = []
    monkeypatch.setattr(common, "trim", lambda: freed.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", "b", None])], names=["text"])
    parts = common.parts_of(iter([batch, batch]), 0, 2)
    assert [next(parts).num_rows for _ in range(4)] == [1, 2, 1, 2] and not freed
    assert list(parts) == [] and freed == [1]
    assert list(common.parts_of(iter([]), 0, 2)) == [] and freed == [1, 1]
