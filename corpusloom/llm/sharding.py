"""Resharding by minimum-cost flow (operator 8).

Old shards supply their bytes and new shards take up to their capacity; carrying a byte to
another shard costs 1, leaving it costs 0. The flow of least cost says how many bytes go from
each old shard to each new one. The documents of an old shard stand in hash order; consecutive
stretches of that order are the blocks that realise the flow, so each new size is met to about
one document per stretch, and only shards with a transfer are rewritten.

The order is never sorted as a whole: bytes are summed by hash bucket, the buckets' sums give
each bucket its start, and a window within the bucket gives the rest.

Law of the query: bytes (sizes near equal). The old layout is by CRC-32 of the source, which is
as uneven as the sources are. Defined cases: a null text has size 1 and checksum 0; a null
source is a source; equal rows are told apart by nothing and may take each other's slots; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import dropped, table, written

SHARDS = 8
#: Hash buckets of an old shard for each shuffle partition.
BUCKETS_PER_PARTITION = 4
MOST_BUCKETS = 4096


def least_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Bytes from each old to each new shard: successive shortest paths with potentials.

    The capacities must hold the supply. All costs are 0 or more.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards can't hold the old ones")
    n, m = len(supply), len(capacity)
    flow, rest, room = [[0] * m for _ in range(n)], list(supply), list(capacity)
    height = [0] * (n + m)
    while any(rest):
        far = [0 if i < n and rest[i] else None for i in range(n + m)]
        back: list[int | None] = [None] * (n + m)
        heap = [(0, i) for i in range(n) if rest[i]]
        done: set[int] = set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            steps = [(n + j, cost[u][j]) for j in range(m)] if u < n else [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in steps:
                to = d + c + height[u] - height[v]
                if far[v] is None or to < far[v]:
                    far[v], back[v] = to, u
                    heapq.heappush(heap, (to, v))
        end = min((n + j for j in range(m) if room[j] and far[n + j] is not None), key=lambda v: (far[v] + height[v], v))
        limit = max(f for f in far if f is not None)
        height = [h + (limit if f is None else f) for h, f in zip(height, far)]
        path, v = [], end
        while back[v] is not None:
            path.append((back[v], v))
            v = back[v]
        amount = min([rest[v], room[end - n], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        rest[v] -= amount
        room[end - n] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def reshard(rows: DataFrame, key: str, shards: int = SHARDS, capacities: list[int] | None = None) -> tuple[DataFrame, list[list[int]]]:
    """rows with shard and slot, and the flow. rows: key, size, old_shard (0 to n - 1), hash (a long) and others."""
    spark = rows.sparkSession
    old = {r["old_shard"]: r["size"] for r in rows.groupBy("old_shard").agg(F.sum("size").alias("size")).collect()}
    supply = [old.get(i, 0) for i in range(max([shards, *(i + 1 for i in old)]))]
    capacities = capacities or equal_capacities(sum(supply), shards)
    flow = least_cost_flow(supply, capacities, [[int(i != j) for j in range(shards)] for i in range(len(supply))])
    # stretches of the hash order of an old shard: what stays comes first
    stretches, schema = [], T.StructType([T.StructField("_old", T.IntegerType()), T.StructField("_cuts", T.ArrayType(T.LongType())), T.StructField("_to", T.ArrayType(T.IntegerType()))])
    for i, row in enumerate(flow):
        at, cuts, to = 0, [], []
        for j in sorted((j for j in range(shards) if row[j]), key=lambda j: (j != i, j)):
            at += row[j]
            cuts.append(at)
            to.append(j)
        stretches.append((i, cuts[:-1], to))
    plan = F.broadcast(spark.createDataFrame(stretches, schema))
    buckets = min(MOST_BUCKETS, BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("_bucket", F.pmod(F.shiftright("hash", 8), F.lit(buckets)).cast("int"))
    within = Window.partitionBy("old_shard", "_bucket").orderBy("hash", key, "size")
    sums = rows.groupBy("old_shard", "_bucket").agg(F.sum("size").alias("_bytes"))
    # at most shards x MOST_BUCKETS rows
    starts = sums.select("old_shard", "_bucket", (F.sum("_bytes").over(Window.partitionBy("old_shard").orderBy("_bucket")) - F.col("_bytes")).alias("_start"))
    placed = rows.join(F.broadcast(starts), ["old_shard", "_bucket"]).join(plan, F.col("old_shard") == F.col("_old"))
    middle = F.col("_start") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    placed = placed.withColumn("_middle", middle)
    placed = placed.withColumn("shard", F.get("_to", F.array_size(F.filter("_cuts", lambda c: c <= F.col("_middle")))))
    counts = placed.groupBy("shard", "old_shard", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    # at most shards x shards x MOST_BUCKETS rows
    first = counts.select("shard", "old_shard", "_bucket", (F.sum("_rows").over(Window.partitionBy("shard").orderBy("old_shard", "_bucket")) - F.col("_rows")).alias("_first"))
    out = placed.join(F.broadcast(first), ["shard", "old_shard", "_bucket"])
    number = F.row_number().over(Window.partitionBy("shard", "old_shard", "_bucket").orderBy("hash", key, "size"))
    out = out.withColumn("slot", (F.col("_first") + number - 1).cast("long"))
    return out.drop("_bucket", "_start", "_old", "_cuts", "_to", "_middle", "_first"), flow


def rewrite(docs: DataFrame, old_folder: str, new_folder: str, key: str = "doc_id", text: str = "text", shards: int = SHARDS, capacities: list[int] | None = None) -> tuple[DataFrame, list[list[int]]]:
    """Writes the affected shards' files anew; returns the manifest (shard, path, rewritten) and the flow.

    docs: all documents, with old_shard. Each row is numbered once and keeps its number through the
    reshard, so null ids and rows that repeat one come out as often as they went in. A shard is written
    by as many tasks as it fills; the files of one in name order are its slots in order. A shard that
    neither gives nor takes bytes keeps its files.
    """
    value = F.coalesce(text, F.lit(""))
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()), "sharding-rows")
    thin = numbered.select("_row", "old_shard", (F.octet_length(value) + F.lit(1)).cast("long").alias("size"), F.xxhash64(key, F.crc32(value)).alias("hash"))
    assigned, flow = reshard(thin, "_row", shards, capacities)
    moved = {k for i, row in enumerate(flow) for j, n in enumerate(row) if n and i != j for k in (i, j) if k < shards}
    rows = assigned.where(F.col("shard").isin(sorted(moved))).select("_row", "shard", "slot")
    out = numbered.join(rows, "_row").drop("_row")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(new_folder)
    dropped(numbered)
    manifest = [(k, f"{new_folder if k in moved else old_folder}/shard={k}", k in moved) for k in range(shards)]
    return docs.sparkSession.createDataFrame(manifest, "shard int, path string, rewritten boolean"), flow


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(SHARDS)).cast("int").alias("old_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes, moving the fewest bytes from a layout by source."""
    rows = sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    rows = written(rows.withColumn("hash", F.xxhash64("doc_id", "text_crc32")), "sharding")
    out, _ = reshard(rows, "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
