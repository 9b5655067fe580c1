"""The exact vector index against comparing everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import clusters as C
from corpusloom.operators import search as S


def clustered(n=600, dim=8, groups=6, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    x = middle[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    x[5], x[50], x[500] = x[7], x[7], 3 * x[7]  # ties
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "chunk_id long, embedding array<double>")


def brute(x, q, k, allowed=None, but=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ (q / np.linalg.norm(q)), 12)
    ids = [i for i in range(len(x)) if (allowed is None or i in allowed) and i != but]
    return [i for i in sorted(ids, key=lambda i: (-sims[i], i))[:k]]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    x = clustered()
    folder = str(tmp_path_factory.mktemp("clusters") / "i")
    C.write(frame(spark, x), folder, clusters=12)
    return x, C.Clusters(spark, folder)


@pytest.mark.parametrize("k", [1, 10, 700])
def test_single_searches_equal_the_scan(spark, index, k):
    x, stored = index
    for q in (x[7], x[300], -x[11], np.arange(1.0, 9.0)):
        got, opened = stored.search(q.tolist(), k)
        assert [r["chunk_id"] for r in got.orderBy("r").collect()] == brute(x, q, k)
        assert len(opened) <= len(stored.ids)
    got, opened = stored.search(x[7].tolist(), 5)
    assert len(opened) < len(stored.ids) / 2  # far clusters are never opened
    files = {f.rsplit("cluster=", 1)[1].split("/")[0] for f in stored.rows(opened).inputFiles()}
    assert files == {str(c) for c in opened}


def test_many_searches_equal_the_scan(spark, index):
    x, stored = index
    asked = frame(spark, x).where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector"))
    got, share = stored.search_many(asked, 7, leave_out=True)
    by = {}
    for r in sorted(got.collect(), key=lambda r: r["r"]):
        by.setdefault(r["qid"], []).append(r["chunk_id"])
    assert by == {i: brute(x, x[i], 7, but=i) for i in range(0, len(x), 10)}
    assert share < 0.5
    want = {(r["qid"], r["chunk_id"], r["r"]) for r in S.search_many(frame(spark, x), asked, 7, leave_out=True).collect()}
    assert {(r["qid"], r["chunk_id"], r["r"]) for r in got.collect()} == want


def test_only_allowed_rows_count_for_the_bound(spark, index):
    x, stored = index
    allowed = frame(spark, x).where("chunk_id % 50 = 3").select("chunk_id")
    some = set(range(3, 600, 50))
    got, _ = stored.search(x[7].tolist(), 4, allowed)
    assert [r["chunk_id"] for r in got.orderBy("r").collect()] == brute(x, x[7], 4, some)
    asked = frame(spark, x).where("chunk_id in (0, 7, 99)").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector"))
    got, _ = stored.search_many(asked, 20, allowed)
    for q in (0, 7, 99):
        assert [r["chunk_id"] for r in got.where(F.col("qid") == q).orderBy("r").collect()] == brute(x, x[q], 20, some)


def test_without_clusters_in_the_data_everything_is_read_and_right(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(300, 32))
    C.write(frame(spark, x), str(tmp_path / "i"))
    stored = C.Clusters(spark, str(tmp_path / "i"))
    asked = frame(spark, x).where("chunk_id < 5").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector"))
    got, share = stored.search_many(asked, 3)
    assert {(r["qid"], r["r"]): r["chunk_id"] for r in got.collect()} == {(q, i + 1): c for q in range(5) for i, c in enumerate(brute(x, x[q], 3))}
    assert 0 < share <= 1


def test_odd_vectors_and_none(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [0.0, 2.0]), (6, [])]
    C.write(spark.createDataFrame(rows, "chunk_id long, embedding array<double>"), str(tmp_path / "odd"))
    got, _ = C.Clusters(spark, str(tmp_path / "odd")).search([1.0, 0.1], 9)
    assert [r["chunk_id"] for r in got.orderBy("r").collect()] == [1, 5]
    C.write(spark.createDataFrame([], "chunk_id long, embedding array<double>"), str(tmp_path / "none"))
    none = C.Clusters(spark, str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<double>")
    assert none.search([1.0, 0.0])[0].count() == 0 and none.search_many(asked, 3)[0].count() == 0


def test_what_grows_with_the_rows_is_not_broadcast(spark, index):
    """Of a search's joins only those on lists of clusters go through the driver."""
    x, stored = index
    asked = frame(spark, x).where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector"))
    allowed = frame(spark, x).where("chunk_id % 2 = 1").select("chunk_id")
    kept = stored._met(C.unit("vector", "qid", asked), 7, None)
    best = stored._best(kept, 7, allowed, True)
    best.collect()
    plan = best._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    built = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert built and all("[cluster#" in line for line in built), built
    assert plan.count("SortMergeJoin") == 2, plan
