"""Generations of a corpus: carry-forward, gates, comparison, flip guard, collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAILED_SHARE, SHRINK_SHARE, KEPT_GENERATIONS, STALE_HOURS, GRACE_MINUTES = 0.02, 0.15, 2, 24, 40
MATCH = ("source_id", "chunk_hash", "heading_path_text", "title")


def carried(new: DataFrame, old: DataFrame, model: str) -> DataFrame:
    """new (MATCH, ordinal) with embedding, carried_from: the vector that an old chunk of like text, place and title has.

    old: MATCH, embedding, embedding_model, generation, priority (0: active, then newest first). Of
    several one is taken: a chunk that a document repeats doesn't multiply rows.
    """
    usable = old.where((F.col("embedding_model") == model) & F.col("embedding").isNotNull())
    best = usable.groupBy(*MATCH).agg(F.min_by(F.struct("embedding", "generation"), F.struct(F.col("priority"), -F.col("generation"))).alias("_b"))
    same = None
    for c in MATCH:
        one = new[c].eqNullSafe(best[c])
        same = one if same is None else same & one
    out = new.join(best, same, "left")
    return out.select(*[new[c] for c in new.columns], F.col("_b.embedding").alias("embedding"), F.col("_b.generation").alias("carried_from"))


def health(chunks: DataFrame) -> DataFrame:
    """Chunks by embedding status, per generation."""
    count = lambda s: F.count_if(F.col("embedding_status") == s).alias(s)
    return chunks.groupBy("generation").agg(F.count(F.lit(1)).alias("total"), count("pending"), count("embedded"), count("failed"))


def ready(pending: Column, embedded: Column, failed: Column) -> Column:
    return (pending == 0) & (embedded > 0) & (failed / F.nullif(embedded + failed, F.lit(0)) <= FAILED_SHARE)


def models_consistent(chunks: DataFrame, model: str, *by: str) -> DataFrame:
    """Whether exactly the declared model made the embedded chunks."""
    return chunks.where("embedding_status = 'embedded'").groupBy(*by).agg(F.bool_and(F.col("embedding_model").eqNullSafe(F.lit(model))).alias("consistent"))


#: What makes two generations the same corpus: content and everything that shapes its chunks and its place.
FINGERPRINT = ("stable_id", "content_hash", "title", "position", "slug", "kind", "parent_id", "visibility", "doc_status", "owner", "provenance", "superseded_by", "chunk_policy", "embedding_model")


def difference(a: DataFrame, b: DataFrame, columns: tuple[str, ...] = FINGERPRINT) -> DataFrame:
    """Rows of a that b lacks and the other way, as multisets; none where the corpora are the same."""
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).withColumn("side", F.lit("only_new")).unionByName(y.exceptAll(x).withColumn("side", F.lit("only_old")))


def flip_delta(new: DataFrame, old: DataFrame, key: str = "stable_id") -> DataFrame:
    """Ids that a flip adds and removes."""
    x, y = new.select(key).distinct(), old.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("change", F.lit("added")).unionByName(y.join(x, key, "left_anti").withColumn("change", F.lit("removed")))


def shrink(new: DataFrame, old: DataFrame, most: float = SHRINK_SHARE, key: str = "stable_id") -> DataFrame:
    """Sizes, the share lost, and whether the guard refuses; a first generation never shrinks."""
    if most > 1:
        raise ValueError("the threshold is a share")
    one = new.agg(F.count_distinct(key).alias("new")).crossJoin(F.broadcast(old.agg(F.count_distinct(key).alias("old"))))  # one row each
    lost = F.when(F.col("old") > 0, F.greatest(F.col("old") - F.col("new"), F.lit(0)) / F.col("old")).otherwise(0.0)
    return one.withColumn("lost_share", lost).withColumn("refused", F.col("lost_share") > most)


def collectable(runs: DataFrame, now: Column) -> DataFrame:
    """Generations to reap. runs: tenant, generation, state, finished_at, heartbeat_at, pointed (active or rollback).

    Stale builds go; of the others, in generation order, as long as enough complete ones remain.
    """
    complete = F.col("state").isin("ready", "active", "retired")
    counted = runs.withColumn("_complete", F.count_if(complete).over(Window.partitionBy("tenant")))
    stale = (F.col("state") == "building") & (F.col("heartbeat_at") < now - F.make_interval(hours=F.lit(STALE_HOURS)))
    old = ~F.col("pointed") & F.col("state").isin("ready", "retired", "abandoned") & (F.col("finished_at") <= now - F.make_interval(mins=F.lit(GRACE_MINUTES)))
    nth = F.row_number().over(Window.partitionBy("tenant").orderBy("generation"))
    aged = counted.where(old).withColumn("_n", nth).where(F.col("_n") <= F.col("_complete") - KEPT_GENERATIONS)
    return counted.where(stale).select("tenant", "generation").unionByName(aged.select("tenant", "generation"))


def centroids(chunks: DataFrame, node: str = "node_id") -> DataFrame:
    """node, chunk_count and centroid of embedded prose: sums by coordinate, combined in each task before the shuffle."""
    for column, value in (("embedding_status", "embedded"), ("source_type", "prose")):
        chunks = chunks.where(F.col(column) == value) if column in chunks.columns else chunks
    sums = chunks.select(node, F.posexplode("embedding").alias("i", "x")).groupBy(node, "i").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("x").alias("n"))
    # one row a coordinate, as many as the vector has
    ordered = sums.groupBy(node).agg(F.max("n").alias("chunk_count"), F.array_sort(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("x")))).alias("c"))
    return ordered.select(node, "chunk_count", F.transform("c", lambda e: e["x"]).alias("centroid"))


def unsearchable(chunks: DataFrame, servable: Column) -> DataFrame:
    """Per source how many chunks can be found, and whether none can."""
    return chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(servable).alias("servable")).withColumn("invisible", F.col("servable") == 0)
