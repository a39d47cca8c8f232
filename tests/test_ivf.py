"""The inverted file against exact search."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlcurio.operators import ivf, retrieve

SCHEMA = "vec_id long, embedding array<float>"


def clustered(n, seed=1, centres=40, width=16):
    draw = random.Random(seed)
    middle = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [(i, [m + draw.gauss(0, 0.35) for m in middle[i % centres]]) for i in range(n)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    base = spark.createDataFrame(clustered(6000) + [(9000, None)], SCHEMA).repartition(4).cache()
    path = str(tmp_path_factory.mktemp("ivf"))
    ivf.build(base, path, cells=64)
    return base, path


def test_recall_and_pruned_cells(spark, index):
    base, path = index
    asked = base.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "input_id")
    found = ivf.search(asked, path, 10, n_probe=8)
    exact = retrieve.knn(asked, base, 10)
    share = ivf.recall(found, exact).first()
    assert share["n"] == 600 and share["recall"] >= 0.95
    one = ivf.search(asked.where("input_id = 0"), path, 10, n_probe=3)
    assert "dynamicpruning" in one._jdf.queryExecution().toString()
    rows = one.collect()
    assert len(rows) == 10 and rows[0]["d2"] == 0 and [r["rank"] for r in rows] == list(range(1, 11))
    read = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in read
    truth = {(r["input_id"], r["vec_id"]): r["d2"] for r in exact.collect()}
    for r in found.collect():
        if (r["input_id"], r["vec_id"]) in truth:
            assert r["d2"] == pytest.approx(truth[r["input_id"], r["vec_id"]])


def test_probes_are_tuned_to_a_recall(spark, index):
    base, path = index
    asked = base.where("vec_id % 60 = 1").withColumnRenamed("vec_id", "input_id")
    n = ivf.tuned_probes(asked, base, path, target=0.97)
    exact = retrieve.knn(asked, base, 10)
    assert 1 < n < 32 and ivf.recall(ivf.search(asked, path, 10, n), exact).first()["recall"] >= 0.95
    assert ivf.tuned_probes(asked, base, path, target=0.3) < n and ivf.tuned_probes(asked.limit(0), base, path) == 1


def test_all_cells_and_rows_are_an_exact_search(spark, index, monkeypatch):
    base, path = index
    asked = base.where("vec_id % 500 = 0").withColumnRenamed("vec_id", "input_id")
    found = ivf.search(asked, path, 5, n_probe=64, oversample=1200)
    key = lambda d: sorted((r["input_id"], r["rank"], r["vec_id"], round(r["d2"], 9)) for r in d.collect())
    assert key(found) == key(retrieve.knn(asked, base, 5))


def test_copies_fill_a_cell_that_is_dealt_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "BLOCK", 100)
    base = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(900)] + [(i, [float(i), 0.0]) for i in range(1000, 1100)], SCHEMA).repartition(3)
    ivf.build(base, str(tmp_path), cells=4)
    blocks = spark.read.parquet(f"{tmp_path}/cells")
    assert blocks.agg(F.sum("n")).first()[0] == 1000 and blocks.agg(F.max("blocks")).first()[0] >= 9
    asked = base.where("vec_id < 250").withColumnRenamed("vec_id", "input_id")
    found = ivf.search(asked, str(tmp_path), 3, n_probe=1, oversample=400)
    assert {(r["rank"], r["vec_id"], r["d2"]) for r in found.collect()} == {(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)} and found.count() == 750
    with pytest.raises(ValueError):
        ivf.build(base.limit(0), str(tmp_path / "none"))
    assert ivf.search(asked.limit(0), str(tmp_path), 3).count() == 0


def test_few_rows_and_cells(spark, tmp_path):
    ivf.build(spark.createDataFrame([(5, [1.0, 0.0])], SCHEMA), str(tmp_path))
    out = ivf.search(spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "input_id long, embedding array<float>"), str(tmp_path)).collect()
    assert [(r["input_id"], r["vec_id"], r["d2"], r["rank"]) for r in out] == [(1, 5, 1.0, 1)]


def test_only_rows_that_may_be_nearest_leave_a_block():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(3000, 16))
    x[2000:2050] = x[7]  # ties
    step = np.abs(x).max(axis=1) / ivf.STEPS
    coded, q, ids = np.rint(x / step[:, None]) * step[:, None], np.vstack([draw.normal(size=(20, 16)), x[7:8]]), draw.permutation(3000)
    may = draw.random((21, 3000)) < 0.9
    may[3] = np.arange(3000) < 4  # fewer than k
    true, d = (np.where(may, ((q[:, None] - v) ** 2).sum(2), np.inf) for v in (x, coded))
    error = step * 0.5 * 16**0.5
    for k, keep in ((5, 1000), (5, 40)):
        who, which, near, low, far = ivf._possible(q, coded, error, may, ids, k, keep)
        assert np.all(may[who, which]) and np.allclose(near, d[who, which])
        assert np.all(low <= np.sqrt(true[who, which]) + 1e-9) and np.all(np.sqrt(true[who, which]) <= far + 1e-9)
        for j in range(21):
            candidates = np.lexsort((ids, d[j]))[: min(keep, int(may[j].sum()))]
            best = candidates[np.lexsort((ids[candidates], true[j][candidates]))][:k]
            assert set(best) <= set(which[who == j]) and (who == j).sum() <= keep
        assert len(who) < 21 * 60 if keep == 1000 else True  # not all that are asked for


def test_probes_are_written_once_a_query(spark, index, monkeypatch):
    base, path = index
    kept = {}
    monkeypatch.setattr(ivf, "written", lambda df, label: kept.setdefault(label, df))
    asked = base.where("vec_id % 500 = 0").withColumnRenamed("vec_id", "input_id")
    ivf.search(asked, path, 5, ivf.MOST_CELLS)
    assert kept["ivf-probes"].count() == asked.where("embedding is not null").count()
    cells = kept["ivf-probes"].select("query", F.inline("found")).select("query", F.explode("cells").alias("cell"))
    assert {(r["n"], r["m"]) for r in cells.groupBy("query").agg(F.count("*").alias("n"), F.countDistinct("cell").alias("m")).collect()} == {(64, 64)}


def test_memory_of_nearest_cells_does_not_grow_with_cells():
    draw = np.random.default_rng(6)
    centroids, vectors = draw.normal(size=(1024, 8)), draw.normal(size=(5000, 8))
    tracemalloc.start()
    near = ivf._nearest_cells(centroids, vectors, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6  # all distances at once are 41 MB
    assert np.array_equal(near[:50, 0], ((vectors[:50, None] - centroids) ** 2).sum(2).argmin(1))
    assert np.array_equal(ivf._nearest_cells(centroids, vectors[:50], 2000), np.argsort((centroids**2).sum(1) - 2 * vectors[:50] @ centroids.T, axis=1, kind="stable"))
    assert ivf._bundles(np.array([5000, 3000, 200, 9000, 1, 8191, 1] + [8192] * 32)).tolist()[:8] == [0, 0, 1, 2, 3, 3, 4, 5]
    assert ivf._bundles(np.array([300, 212, 1, 900, 5])).tolist() == [0, 0, 1, 2, 3]
