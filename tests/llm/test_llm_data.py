"""Vectors, archives, conversations and rollups against plain versions."""

import itertools
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import ann, chat, rollups, topk, warc


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)], "x", 1) for i in range(400)]
    rows += [(400 + i, rows[7][1], "x", 1) for i in range(30)]
    rows += [(500, None, "x", 1), (510, [1.0] * 7 + [None], "x", 1), (520, [float("nan")] * 8, "x", 1), (530, [float("inf")] * 8, "x", 1), (540, [], "x", 1), (550, [0.0] * 8, "x", 1), (None, [1.0] * 8, "x", 1), (560, [1.0], "x", 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int").repartition(3)


def brute(vectors, every, k, scale=None, zero=True):
    held = sorted((r.vec_id, r.embedding) for r in vectors.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 8 and all(x is not None and np.isfinite(x) for x in r.embedding) and (zero or any(r.embedding)))
    ids, x = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    x = np.floor(x * scale) if scale else x
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        scores = x @ x[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:k]
        out[ids[q]] = [(ids[i], scores[i]) for i in order]
    return out


def test_exact_top_k(vectors):
    got = {}
    for r in topk.exact_top_k(vectors, F.col("id") % 10 == 0, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(vectors, 10, 10, 1024)


def test_exact_top_k_blocks(vectors, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 2000)
    assert topk.exact_top_k(vectors, F.col("id") % 10 == 0, 3).count() == 3 * len(brute(vectors, 10, 3, 1024))


def test_sorted_lists_stop_early():
    rng = np.random.default_rng(1)
    vecs = np.round(rng.normal(size=(2000, 3)) * 100)
    vecs[5] = vecs[9] = [900, 900, 900]
    found = topk.SortedLists(np.arange(2000), vecs).top(np.array([-1]), np.array([[1.0, 2.0, 3.0]]), 2, 0.01)
    assert sorted(found[0][1]) == [5, 9]


def test_few_vectors(spark, vectors):
    few = vectors.where("vec_id < 3")
    assert topk.exact_top_k(few, F.col("id") == 0).count() == 2
    assert ann.nearest(few, F.col("id") == 0).count() == 2
    assert topk.exact_top_k(vectors.limit(0), F.col("id") == 0).count() == 0
    assert ann.nearest(vectors.limit(0), F.col("id") == 0).count() == 0


@pytest.fixture(scope="module")
def copies(spark):
    """Vectors of 64 dimensions in five copies each, and odd rows whose ids come first."""
    rng = np.random.default_rng(8)
    distinct = rng.normal(size=(300, 64)) * 0.125
    rows = [(-9, [0.0] * 64), (-8, [1.0]), (-7, [1.0, 2.0]), (-20, [3.0, 4.0]), (-100, [0.5]), (-6, None)]
    rows += [(i, distinct[(i * 7) % 300].tolist()) for i in range(1500)] + [(40, distinct[3].tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_results_do_not_depend_on_the_partitioning(copies, monkeypatch):
    """Ids, order and bits over 1, 7 and 16 partitions and small blocks; equal scores stand by id; odd rows change nothing."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 200)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 200)
    plain = copies.where("vec_id >= 0")
    for search in (lambda v: ann.nearest(v, F.col("id") % 20 == 0, certainty=1 - 1e-12), lambda v: topk.exact_top_k(v, F.col("id") % 20 == 0)):
        results = [sorted(map(tuple, search(plain.repartition(n)).collect())) for n in (1, 7, 16)]
        assert results[0] == results[1] == results[2] and len(results[0]) > 700
        for (q, _, a, x), (p, _, b, y) in zip(results[0], results[0][1:]):
            assert q != p or x > y or (x == y and a <= b)
        with_odd = sorted(map(tuple, search(copies.repartition(7)).collect()))
        assert [r for r in with_odd if r[0] >= 0] == results[0]
        # Vectors of two components are searched among themselves; a zero vector or a lone one finds nothing.
        assert [r[:3] for r in with_odd if r[0] < 0] == [(-100, 1, -8), (-20, 1, -7)]


def test_scores_are_sums_in_order(copies):
    held = {r.vec_id: r.embedding for r in copies.collect() if r.embedding}
    for r in ann.nearest(copies.where("vec_id >= 0"), F.col("id") % 300 == 0).collect():
        total = 0.0
        for a, b in zip(held[r.query_id], held[r.vec_id]):
            total += a * b
        assert r.score == total


def test_stopping_test_leaves_vectors_unverified():
    """On vectors without any clusters: the share that is verified, and the recall that is left."""
    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(8000, 64))
    vecs /= np.linalg.norm(vecs, axis=1)[:, None]
    axes = rng.normal(size=(65, 16))
    largest = float(np.sqrt((vecs**2).sum(1).max()))
    projected = vecs @ axes[:64] + np.sqrt(np.maximum(largest**2 - (vecs**2).sum(1), 0))[:, None] * axes[64]
    ids, queries = np.arange(8000), np.arange(0, 8000, 80)
    search = ann.Search(queries, vecs[queries], vecs[queries] @ axes[:64], largest, 20, ann.chi_square_quantile(0.95, 16))
    search.block(ids, vecs, projected)
    truth = vecs[queries] @ vecs.T
    truth[np.arange(len(queries)), queries] = -np.inf
    hits = sum(len(set(search.best_ids[i]) & set(np.argsort(-truth[i])[:20])) for i in range(len(queries)))
    share, recall = search.verified / search.met, hits / (20 * len(queries))
    assert share < 0.7 and recall >= 0.9


def test_sorted_lists_are_not_read_to_the_end():
    """On a skewed table, where few vectors are long, most list entries stay unread."""
    rng = np.random.default_rng(4)
    vecs = np.floor(rng.normal(size=(4000, 4)) * 50)
    vecs[rng.choice(4000, 60, replace=False)] *= 40
    queries = np.floor(rng.normal(size=(30, 4)) * 100)
    lists = topk.SortedLists(np.arange(4000), vecs)
    for j, ids, scores in lists.top(np.full(30, -1), queries, 10):
        order = np.lexsort((np.arange(4000), -(vecs @ queries[j])))[:10]
        assert list(ids) == list(order) and list(scores) == list((vecs @ queries[j])[order])
    assert lists.read < 0.6 * lists.entries


def test_nearest_recall(vectors):
    stated = brute(vectors, 20, 20, zero=False)
    got = {}
    for r in ann.nearest(vectors, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert got.keys() == stated.keys() and all(len(v) == 20 and q not in v for q, v in got.items())
    assert sum(len(set(got[q]) & {i for i, _ in v}) for q, v in stated.items()) / (20 * len(stated)) >= 0.9


def test_chi_square_quantile():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-2


def pages_of(spark):
    rows = [(3, "u", "same"), (1, "u", "same"), (2, None, None), (4, "u", ""), (5, "u", "é" * 1000), (6, "a\r\nb", "x"), (6, "u", "x"), (None, "u", "same")]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("package_bytes", [1 << 30, 1])
def test_packages_round_trip(spark, package_bytes):
    manifest = warc.write_packages(pages_of(spark), warc.package_folder(spark), package_bytes)
    rows = sorted(map(tuple, warc.read_packages(manifest).drop("url").collect()), key=str)
    found = {(r[0], r[2], r[4], r[5]) for r in rows}
    assert len(rows) == 8
    assert {(1, 4, "response", None), (3, 4, "revisit", 1), (2, 0, "response", None), (4, 0, "revisit", 2), (5, 2000, "response", None), (6, 1, "response", None), (None, 4, "response", None)} == found
    assert {r[3] for r in rows if r[2] == 4} == {warc.digest(b"same")}
    assert [r[1] for r in rows if r[0] == 5] == [("é" * 1000).encode()]


def test_packages_are_plain_zip_files(spark):
    manifest = warc.write_packages(pages_of(spark), warc.package_folder(spark))
    for row in manifest.collect():
        _, path = warc.file_system(row.package)
        with zipfile.ZipFile(path) as other:
            assert other.testzip() is None and set(other.namelist()) == {warc.ARCHIVE, warc.INDEX}
            reader = warc.PackageReader(row.package)
            start, size = reader.stored(warc.ARCHIVE)
            assert reader.range(start, size) == other.read(warc.ARCHIVE)
    assert warc.read_packages(warc.write_packages(pages_of(spark).limit(0), warc.package_folder(spark))).count() == 0


def test_zip64_directory(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("one", b"first member" * 5)
        out.writestr("two", b"second member" * 5)
        out.comment = b"a comment"
    reader = warc.PackageReader(path)
    assert reader.range(*reader.stored("two")) == b"second member" * 5
    with pytest.raises(ValueError):
        warc.PackageReader(__file__)


def cheapest(roles, options):
    """By trying every sequence of roles and kinds."""
    best = None
    for path in itertools.product(range(3), range(3), repeat=len(roles)):
        state, cost = 0, 0
        for role, to, kind in zip(roles, path[::2], path[1::2]):
            ways = [w for w in chat.steps(role, options)[state] if w[1:3] == (to, kind)]
            if not ways:
                break
            cost, state = cost + ways[0][0], ways[0][3]
        else:
            total = cost + chat.end_costs(options)[state]
            best = total if best is None else min(best, total)
    return best


NAMES = ["system", "user", "assistant", None]


def test_role_repair_is_cheapest(spark):
    options = chat.RepairOptions()
    cases = [c for n in (1, 2, 3) for c in itertools.product(range(4), repeat=n)]
    rows = [(i, t, NAMES[r], f"t{t}", "clash") for i, c in enumerate(cases) for t, r in enumerate(c)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, action string")
    out = {}
    for r in chat.repaired(turns, options).orderBy("conv_id", "turn").collect():
        out.setdefault(r.conv_id, []).append(r)
    for i, case in enumerate(cases):
        cost = 0
        for role, r in zip(case, out[i]):
            kind = r.action.split("+")[0]
            relabel = options.relabel_unknown if role == 3 else options.relabel
            cost += {"open": 0, "merge": options.merge, "insert": options.insert}[kind] + relabel * ("relabel" in r.action) + options.insert * r.inserted_after
        assert cost == cheapest(case, options), case
        shown = "".join(r.rendered for r in out[i])
        heads = [part.split("\n")[0] for part in shown.split("<|im_start|>")[1:]]
        said = heads[1:] if heads[0] == "system" else heads
        assert said == ["user", "assistant"] * (len(said) // 2) and said
        assert shown.count("<|im_end|>\n") == len(heads) and all(f"t{t}" in shown for t in range(len(case)))


def test_role_repair_does_not_depend_on_cuts(spark):
    rng = np.random.default_rng(5)
    rows = [(int(c), int(t), NAMES[rng.integers(4)], f"{c}.{t}") for c, n in ((1, 300), (2, 7), (3, 90)) for t in range(n)] + [(None, None, "user", None), (None, None, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    whole, cut = ({tuple(r) for r in chat.repaired(turns, chat.RepairOptions(segment_rows=n)).collect()} for n in (4096, 7))
    assert whole == cut and chat.repaired(turns).count() == len(rows)
    assert chat.repaired(turns.limit(0)).count() == 0


def test_rollup_commits_once(spark):
    rollup = rollups.Rollup(spark, rollups_folder(spark))
    assert rollup.totals().count() == 0
    docs = spark.createDataFrame([("s", "en", 5, "x"), ("s", None, None, "x"), (None, "en", 2, "x")], "source string, lang string, n long, tokens string")
    load = rollups.changes("insert", docs, "v1", F.col("n"))
    assert rollup.apply("one", load) and not rollup.apply("one", load)
    rollup.apply("two", rollups.changes("revise", docs.where("n = 5"), "v1", F.lit(9), F.col("n")))
    rollup.compact()
    assert not rollup.apply("one", load)
    rollup.apply("three", rollups.changes("delete", docs.where("source is null"), "v1", F.col("n")))
    rollup.apply("four", load.limit(0))
    expected = {("s", "en", "v1", 1, 9), ("s", None, "v1", 1, 0)}
    assert {tuple(r) for r in rollup.totals().collect()} == expected
    spark.createDataFrame([("s", "en", "v1", 1, 1)], rollups.TOTALS).write.parquet(f"{rollup.folder}/batches/lost")
    assert {tuple(r) for r in rollup.totals().collect()} == expected
    with pytest.raises(Exception, match="unknown kind"):
        rollup.apply("five", load.withColumn("kind", F.lit("other")))
    assert not rollup.committed("five")


def rollups_folder(spark):
    from newsloom.llm.common import work_folder

    return work_folder(spark, "rollup")
