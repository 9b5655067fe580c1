"""A vector index that stays exact: clusters of unit vectors, left out by the triangle inequality.

Each vector belongs to its nearest centre and keeps its distance to it; a cluster is a folder, sorted
by that distance. For a query at distance e of a centre, a vector at distance d of the same centre is at
least |e - d| away. So once k rows are known, of which the farthest is b away, only clusters with
rows at e - b <= d <= e + b can hold a nearer one, and of these only such rows. What the bound is worth
depends on the data; without clusters in them everything is read, and the answer is the same.

Centres are fitted on a bounded sample, drawn by hash; every row is indexed. There are at most
MOST_CLUSTERS of them, so a task may hold them all.

Defined cases: null vectors and those of length 0 or with a part that isn't finite are not indexed.
Fewer than k rows: all of them. Equal similarities, to twelve digits, stand by key. An empty table
gives an index that answers nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import POOL_PER_ARM

SAMPLE_ROWS, MOST_CLUSTERS, FIT_ROUNDS = 20_000, 4096, 8
#: Queries that meet a cluster's block of rows at once, and rows of a block.
QUERY_BLOCK, ROW_BLOCK = 256, 4096
#: Rounding of distances: what is left out is farther than this beyond the bound.
SLACK = 1e-6


def unit(column: str, key: str, rows: DataFrame) -> DataFrame:
    """key and v: vectors of length 1 as bytes of doubles; those that have no direction are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                length = np.linalg.norm(x)
                if len(x) and np.isfinite(length) and length > 0:
                    keys.append(k)
                    out.append((x / length).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], [key, "v"])

    return rows.select(F.col(key).cast("long").alias(key), column).where(F.col(column).isNotNull()).mapInArrow(run, f"{key} long, v binary")


def fitted(vectors: DataFrame, key: str, clusters: int | None = None) -> np.ndarray:
    """Centres by Lloyd's rounds on a sample of SAMPLE_ROWS rows at most; the square root of the rows, if not said."""
    n = vectors.count()
    clusters = min(MOST_CLUSTERS, clusters or int(n**0.5), n)
    drawn = F.pmod(F.xxhash64(F.lit("centres"), key), F.lit(1 << 40)) < F.lit(int(min(1.0, SAMPLE_ROWS / max(n, 1)) * (1 << 40)))
    sample = [r["v"] for r in vectors.where(drawn).orderBy(key).limit(SAMPLE_ROWS).select("v").collect()]
    if not sample:
        return np.zeros((0, 0))
    x = np.stack([np.frombuffer(v) for v in sample])
    centres = x[np.random.default_rng(0).choice(len(x), min(clusters, len(x)), replace=False)]
    for _ in range(FIT_ROUNDS):
        nearest = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        count = np.bincount(nearest, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T, 0))


def write(chunks: DataFrame, folder: str, key: str = "chunk_id", vector: str = "embedding", clusters: int | None = None) -> None:
    """Indexes all chunks in a new folder."""
    spark = chunks.sparkSession
    vectors = unit(vector, key, chunks)
    centres = fitted(vectors, key, clusters)
    shared = spark.sparkContext.broadcast(centres)  # MOST_CLUSTERS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(np.stack([np.frombuffer(v) for v in batch.column("v").to_pylist()]), shared.value)
                nearest = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest])], [key, "v", "cluster", "d"])

    rows = vectors.mapInArrow(run, f"{key} long, v binary, cluster int, d double")
    # rebalanced: a cluster that is too large for one task is split
    rows.hint("rebalance", "cluster").sortWithinPartitions("cluster", "d").write.mode("errorifexists").partitionBy("cluster").parquet(f"{folder}/rows")
    known = spark.read.schema(f"{key} long, v binary, d double, cluster int").parquet(f"{folder}/rows").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    centre = spark.createDataFrame([(i, c.tobytes()) for i, c in enumerate(centres)], "cluster int, centre binary")
    known.join(F.broadcast(centre), "cluster").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/centres")


class Clusters:
    """A stored index."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "chunk_id") -> None:
        self.spark, self.folder, self.key = spark, folder, key
        about = sorted(spark.read.parquet(f"{folder}/centres").collect(), key=lambda r: r["cluster"])  # MOST_CLUSTERS at most
        self.ids = np.array([r["cluster"] for r in about], np.int32)
        self.n, self.low, self.high = (np.array([r[c] for r in about]) for c in ("n", "low", "high"))
        self.centres = np.stack([np.frombuffer(r["centre"]) for r in about]) if about else np.zeros((0, 0))

    def rows(self, clusters: list[int] | None = None) -> DataFrame:
        """key, v, d and cluster of all, or of some clusters: only their folders are opened."""
        schema = f"{self.key} long, v binary, d double, cluster int"
        folders = [f"{self.folder}/rows/cluster={c}" for c in clusters] if clusters is not None else [f"{self.folder}/rows"]
        if not len(self.ids) or not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/rows").parquet(*folders)

    def search_many(self, queries: DataFrame, k: int = POOL_PER_ARM, allowed: DataFrame | None = None, leave_out: bool = False, scratch=None) -> tuple[DataFrame, float]:
        """The k nearest rows of each query (qid, vector) as qid, key, sim, r, and the share of all pairs that was compared.

        allowed: keys that may be found. leave_out: none is its own (qid = key). Two passes: the nearest
        clusters that hold k rows together give a bound, and then all that the bound can't leave out.
        A query whose first pass finds fewer than k has no bound and meets everything.
        """
        from ..durable import Scratch

        scratch = scratch or Scratch.of(self.spark)
        asked = scratch.keep(unit("vector", "qid", queries), n=F.count(F.lit(1)))
        wide = self._met(asked, k + 1 if leave_out else k, None)
        first = scratch.keep(wide.select("qid", "v", "cluster", F.lit(0.0).alias("from"), F.lit(9.0).alias("to")), pairs=F.count(F.lit(1)))
        found = scratch.keep(self._best(first, k, allowed, leave_out))
        bound = found.where(F.col("r") == k).select("qid", F.sqrt(F.greatest(2 - 2 * F.col("sim"), F.lit(0.0))).alias("b"))
        rest = self._met(asked.join(bound.hint("merge"), "qid", "left").select("qid", "v", F.coalesce("b", F.lit(9.0)).alias("b")), 0, "b")
        rest = scratch.keep(rest.join(first.select("qid", "cluster").hint("merge"), ["qid", "cluster"], "left_anti").select("qid", "v", "cluster", "from", "to"))
        both = found.drop("r").unionByName(self._best(rest, k, allowed, leave_out).drop("r"))
        sizes = self.spark.createDataFrame([(int(c), int(n)) for c, n in zip(self.ids, self.n)], "cluster int, n long")
        read = first.select("cluster").unionByName(rest.select("cluster")).join(F.broadcast(sizes), "cluster").agg(F.sum("n")).first()[0] or 0
        every = asked.counted["n"] * int(self.n.sum())
        return self._numbered(both, k), read / every if every else 0.0

    def _met(self, asked: DataFrame, k: int, bound: str | None) -> DataFrame:
        """qid, v, cluster, from, to: the nearest clusters that hold k rows, or all that the bound leaves."""
        shared = self.spark.sparkContext.broadcast((self.ids, self.centres, self.n, self.low, self.high))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, centres, n, low, high = shared.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                e = distances(np.stack([np.frombuffer(v) for v in batch.column("v").to_pylist()]), centres)
                if bound is None:
                    order = e.argsort(1, kind="stable")
                    before = np.cumsum(n[order], 1) - n[order]
                    at, place = np.nonzero(before < k)
                    hit = order[at, place]
                    begin, end = np.zeros(len(at)), np.full(len(at), 9.0)
                else:
                    b = batch.column(bound).to_numpy()[:, None] + SLACK
                    at, hit = np.nonzero((e - b <= high) & (e + b >= low))
                    begin, end = (e - b)[at, hit], (e + b)[at, hit]
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(at)), batch.column("v").take(pa.array(at)), pa.array(ids[hit]), pa.array(begin), pa.array(end)], ["qid", "v", "cluster", "from", "to"])

        return asked.mapInArrow(run, "qid long, v binary, cluster int, from double, to double")

    def _best(self, met: DataFrame, k: int, allowed: DataFrame | None, leave_out: bool) -> DataFrame:
        """The k nearest of each query in the clusters that it meets. Blocks of a cluster's rows meet blocks of its queries."""
        key = self.key
        rows = self.rows() if allowed is None else self.rows().join(allowed.select(key).hint("merge"), key, "left_semi")
        rows = rows.join(F.broadcast(met.select("cluster").distinct()), "cluster", "left_semi")  # MOST_CLUSTERS at most
        # blocks by a hash: about as many rows in each, whatever the cluster's size
        sizes = self.spark.createDataFrame([(int(c), int(-(-n // ROW_BLOCK))) for c, n in zip(self.ids, self.n)], "cluster int, blocks int")
        dealt = rows.join(F.broadcast(sizes), "cluster").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")))
        known = dealt.groupBy("cluster", "block").agg(F.collect_list(F.struct(F.col(key).alias("key"), "v", "d")).alias("rows"))
        many = met.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
        asked = met.join(F.broadcast(many), "cluster").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")))  # a row a cluster
        asked = asked.groupBy("cluster", "block").agg(F.collect_list(F.struct("qid", "v", "from", "to")).alias("queries"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    r, q = batch.column("rows")[i].as_py(), batch.column("queries")[i].as_py()
                    keys, qids = np.array([x["key"] for x in r], np.int64), np.array([x["qid"] for x in q], np.int64)
                    d = np.array([x["d"] for x in r])
                    sims = np.stack([np.frombuffer(x["v"]) for x in q]) @ np.stack([np.frombuffer(x["v"]) for x in r]).T
                    near = (d[None, :] >= np.array([x["from"] for x in q])[:, None]) & (d[None, :] <= np.array([x["to"] for x in q])[:, None])
                    if leave_out:
                        near &= qids[:, None] != keys[None, :]
                    sims = np.where(near, np.round(sims, 12), -np.inf)
                    best = np.lexsort((np.broadcast_to(keys, sims.shape), -sims))[:, :k]
                    row = np.repeat(np.arange(len(qids)), best.shape[1])
                    best = best.ravel()
                    keep = np.isfinite(sims[row, best])
                    yield pa.RecordBatch.from_arrays([pa.array(qids[row][keep]), pa.array(keys[best][keep]), pa.array(sims[row, best][keep])], ["qid", key, "sim"])

        # merged: blocks look small while they are packed, and Spark would send all of them through the driver
        pairs = known.select("cluster", "rows").join(asked.select("cluster", "queries").hint("merge"), "cluster").select("rows", "queries")
        return self._numbered(pairs.mapInArrow(run, T.StructType([T.StructField("qid", T.LongType()), T.StructField(key, T.LongType()), T.StructField("sim", T.DoubleType())])), k)

    def _numbered(self, rows: DataFrame, k: int) -> DataFrame:
        window = Window.partitionBy("qid").orderBy(F.col("sim").desc(), self.key)
        return rows.withColumn("r", F.row_number().over(window)).where(F.col("r") <= k)

    def search(self, vector: list[float], k: int = POOL_PER_ARM, allowed: DataFrame | None = None) -> tuple[DataFrame, list[int]]:
        """The k nearest rows to one vector as key, sim, r, and the clusters whose folders were opened."""
        q = np.asarray(vector, np.float64)
        q = q / np.linalg.norm(q)
        if not len(self.ids):
            return self._top(self.rows(), q, k, allowed), []
        e = distances(q[None, :], self.centres)[0]
        order = e.argsort(kind="stable")
        near = order[: int(np.searchsorted(np.cumsum(self.n[order]), k) + 1)]
        opened = [int(c) for c in self.ids[near]]
        best = self._top(self.rows(opened), q, k, allowed).collect()  # k rows
        b = np.sqrt(max(2 - 2 * best[-1]["sim"], 0)) + SLACK if len(best) == k else np.inf
        more = [int(i) for i in np.flatnonzero((e - b <= self.high) & (e + b >= self.low)) if i not in set(near)]
        rows = self.rows(opened + [int(self.ids[i]) for i in more])
        if np.isfinite(b):
            limits = self.spark.createDataFrame([(int(self.ids[i]), float(e[i] - b), float(e[i] + b)) for i in [*near, *more]], "cluster int, from double, to double")
            rows = rows.join(F.broadcast(limits), "cluster").where((F.col("d") >= F.col("from")) & (F.col("d") <= F.col("to")))
        return self._top(rows, q, k, allowed), opened + [int(self.ids[i]) for i in more]

    def _top(self, rows: DataFrame, q: np.ndarray, k: int, allowed: DataFrame | None) -> DataFrame:
        key = self.key

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    sims = np.round(np.stack([np.frombuffer(v) for v in batch.column("v").to_pylist()]) @ q, 12)
                    yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(sims)], [key, "sim"])

        rows = rows.select(key, "v") if allowed is None else rows.select(key, "v").join(allowed.select(key), key, "left_semi")
        top = rows.mapInArrow(run, f"{key} long, sim double").orderBy(F.col("sim").desc(), key).limit(k)
        return top.withColumn("r", F.row_number().over(Window.orderBy(F.col("sim").desc(), key)))
