"""First-seen filters against a plain walk over the rows."""

import random

import pytest

from newsloom.operators import dedup
from newsloom.operators.dedup import dedup_ttl, first_per_key, new_articles

HOUR = 3_600_000


def walk(rows, ttl_ms):
    kept, last = [], {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t - last[k] >= ttl_ms:
            last[k] = t
            kept.append((k, t, i))
    return sorted(kept)


def run(spark, rows, ttl_s, **kw):
    df = spark.createDataFrame(rows, "k string, t long, i long")
    return sorted(map(tuple, dedup_ttl(df, "k", "t", ttl_s, tie=["i"], **kw).collect()))


def test_expiry_runs_from_the_kept_row(spark):
    rows = [("a", h * HOUR, i) for i, h in enumerate([0, 47, 48, 95, 96])]
    assert [t // HOUR for _, t, _ in run(spark, rows, 172_800)] == [0, 48, 96]
    assert [t // HOUR for _, t, _ in run(spark, rows, 172_800, fold_limit=2)] == [0, 48, 96]


@pytest.mark.parametrize("ttl_s,fold_limit", [(172_800, 10_000), (172_800, 20), (36_000, 50), (10**7, 5)])
def test_paths_agree(spark, ttl_s, fold_limit):
    rnd = random.Random(7)
    # One key holds half of all rows.
    rows = [(rnd.choice("hhhhabcd"), rnd.randrange(0, 15 * 24) * HOUR // 3, i) for i in range(800)]
    assert run(spark, rows, ttl_s, fold_limit=fold_limit) == walk(rows, ttl_s * 1000)


def test_kept_rows_are_a_ttl_apart(spark):
    rows = [("a", t * HOUR, t) for t in range(0, 500, 7)]
    times = [t for _, t, _ in run(spark, rows, 172_800, fold_limit=10)]
    assert times[0] == 0 and all(b - a >= 48 * HOUR for a, b in zip(times, times[1:]))


def test_short_batches_take_one_aggregate(spark, plan):
    df = spark.createDataFrame([("a", 0, 1), ("a", 5, 2)], "k string, t long, i long")
    text = plan(dedup_ttl(df, "k", "t", 172_800))
    assert "collect_list" not in text and text.count("Exchange") <= 3


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, t long")
    assert dedup_ttl(df, "k", "t", 10).count() == 0


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, t long, v string")
    assert sorted(map(tuple, first_per_key(df, ["k"], ["t"]).collect())) == [("a", 1, "y"), ("b", 3, "z")]


def test_new_articles(spark):
    history = spark.createDataFrame([("a", 0), ("a", 10 * HOUR), ("b", 0)], "id string, ts long")
    batch = spark.createDataFrame([("a", 57 * HOUR), ("a", 58 * HOUR), ("b", 47 * HOUR), ("c", 0)], "id string, ts long")
    assert sorted(map(tuple, new_articles(batch, history, 172_800).collect())) == [("a", 58 * HOUR), ("c", 0)]


def test_heavy_key_within_ttl_is_not_folded(spark, monkeypatch):
    rows = [("hot", t) for t in range(20)] + [("slow", t * 60_000) for t in range(3)]
    df = spark.createDataFrame(rows, "k string, t long")
    seen = []
    fold = dedup._fold
    monkeypatch.setattr(dedup, "_fold", lambda part, *rest: seen.append(sorted({r.k for r in part.collect()})) or fold(part, *rest))
    kept = sorted(map(tuple, dedup.dedup_ttl(df, "k", "t", 60, fold_limit=5).collect()))
    assert seen == [["slow"]] and kept == [("hot", 0), ("slow", 0), ("slow", 60_000), ("slow", 120_000)]


def test_new_articles_looks_back_only(spark):
    rnd = random.Random(5)
    history = [(rnd.choice("hhhab"), rnd.randrange(-300, 300)) for _ in range(60)]
    batch = [(rnd.choice("hhhabc"), rnd.randrange(-50, 200)) for _ in range(300)]
    stated = sorted((k, t) for k, t in batch if not any(j == k and 0 <= t - h < 20 for j, h in history))
    past, load = (spark.createDataFrame([(k, t * 1000) for k, t in rows], "id string, ts long") for rows in (history, batch))
    found = sorted((r.id, r.ts // 1000) for r in new_articles(load, past, 20).collect())
    assert found == stated and 0 < len(found) < len(batch)
    assert new_articles(load.limit(0), past, 20).count() == 0
    assert new_articles(load, past.limit(0), 20).count() == len(batch)


@pytest.mark.parametrize("cell_rows", [3, 1_000_000])
def test_pointer_walk_equals_the_walk(spark, cell_rows):
    rnd = random.Random(11)
    rows = [(rnd.choice("hhhhhab"), rnd.choice([rnd.randrange(4000), rnd.randrange(900, 1000)])) for _ in range(1500)] + [(None, t) for t in range(0, 90, 4)]
    times = spark.createDataFrame(rows, "k string, _t long").selectExpr("struct(k) AS _k", "_t").distinct()
    found = sorted((str(r._k.k), r._t) for r in dedup.kept_times(times, 10, cell_rows).collect())
    kept, last = [], {}
    for t, k in sorted((t, str(k)) for k, t in set(rows)):
        if k not in last or t - last[k] >= 10:
            last[k] = t
            kept.append((k, t))
    assert found == sorted(kept)


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    rounds = []
    write = dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, purpose: rounds.append(purpose) or write(df, purpose))
    for n, most in ((64, 8), (1024, 12)):
        rounds.clear()
        rows = spark.range(n).selectExpr("'hot' AS k", "id * 1000 AS t", "id AS i")
        assert dedup.dedup_ttl(rows, "k", "t", 1, tie=["i"], fold_limit=10).count() == n
        assert rounds.count("dedup-added") <= most


def test_null_keys_and_extra_columns_in_heavy_keys(spark):
    rows = [(None, t * 1000, t, "x") for t in range(50)] + [("a", t * 1000, t, "y") for t in range(3)]
    df = spark.createDataFrame(rows, "k string, t long, _next long, _k string")
    kept = dedup_ttl(df.withColumnRenamed("_k", "v"), "k", "t", 7, tie=["_next"], fold_limit=5).collect()
    assert sorted((str(r.k), r.t // 1000) for r in kept) == [("None", t) for t in range(0, 50, 7)] + [("a", 0)]
