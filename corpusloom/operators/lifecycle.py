"""The life of a generation: allocated, built, flipped, rolled back, reaped.

Pointers (one row a corpus) and runs (one row a generation) are small tables. Each act takes them and
returns what they are after it; a catalog's commit makes that the state, or nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POINTERS = "tenant_id string, corpus_id string, active_generation long, rollback_generation long"
RUNS = "tenant_id string, corpus_id string, generation long, state string, source_commit string, schema_version string, finished_at timestamp, heartbeat_at timestamp"
SCHEMA_VERSION = "2.4"


class Refused(ValueError):
    """An act that would regress or empty the served corpus."""


def _is(tenant: str, corpus: str) -> Column:
    return (F.col("tenant_id") == tenant) & (F.col("corpus_id") == corpus)


def allocated(pointers: DataFrame, runs: DataFrame, tenant: str, corpus: str, commit: str | None, now: Column) -> tuple[int, DataFrame, DataFrame]:
    """The next generation's number, and pointers and runs with it in them as building."""
    spark = runs.sparkSession
    number = (runs.where(_is(tenant, corpus)).agg(F.max("generation")).first()[0] or 0) + 1
    if pointers.where(_is(tenant, corpus)).isEmpty():
        pointers = pointers.unionByName(spark.createDataFrame([(tenant, corpus, 0, None)], POINTERS))
    run = spark.createDataFrame([(tenant, corpus, number, "building", commit, SCHEMA_VERSION)], "tenant_id string, corpus_id string, generation long, state string, source_commit string, schema_version string")
    return number, pointers, runs.unionByName(run.select("*", F.lit(None).cast("timestamp").alias("finished_at"), now.alias("heartbeat_at")))


def pointer(pointers: DataFrame, tenant: str, corpus: str) -> tuple[int, int | None]:
    """The active and the rollback generation; 0 where nothing is published."""
    row = pointers.where(_is(tenant, corpus)).first()
    return (row["active_generation"], row["rollback_generation"]) if row else (0, None)


def servable(pointers: DataFrame, tenant: str, corpus: str) -> list[int]:
    return [g for g in pointer(pointers, tenant, corpus) if g]


def _activated(runs: DataFrame, mine: Column, to: int, now: Column) -> DataFrame:
    active = F.col("generation") == to
    was = mine & (F.col("state") == "active") & ~active
    finished = F.when(was, now).when(mine & active, F.coalesce("finished_at", now)).otherwise(F.col("finished_at"))
    state = F.when(was, "retired").when(mine & active, "active").otherwise(F.col("state"))
    return runs.withColumn("finished_at", finished).withColumn("state", state)


def flipped(pointers: DataFrame, runs: DataFrame, tenant: str, corpus: str, to: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """Pointers and runs with a newer generation served; the one before is what a rollback goes to. Never backwards."""
    mine = _is(tenant, corpus)
    active, _ = pointer(pointers, tenant, corpus)
    if active >= to:
        raise Refused(f"generation {active} is served already, {to} would go back")
    after = pointers.withColumn("rollback_generation", F.when(mine, F.col("active_generation")).otherwise(F.col("rollback_generation"))).withColumn("active_generation", F.when(mine, F.lit(to).cast("long")).otherwise(F.col("active_generation")))
    return after, _activated(runs, mine, to, now)


def rolled_back(pointers: DataFrame, runs: DataFrame, tenant: str, corpus: str, now: Column) -> tuple[int, DataFrame, DataFrame]:
    """The generation that is served again, pointers and runs."""
    mine = _is(tenant, corpus)
    _, back = pointer(pointers, tenant, corpus)
    if not back:
        raise Refused("no earlier generation is recorded")
    return back, pointers.withColumn("active_generation", F.when(mine, F.lit(back).cast("long")).otherwise(F.col("active_generation"))), _activated(runs, mine, back, now)


def reaped(spark, runs: DataFrame, tenant: str, generation: int, tables: list[str]) -> DataFrame:
    """Drops a generation's partitions of the tables (folders by tenant_id and generation); ledger and denylist stay. Returns the runs."""
    for path in tables:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/tenant_id={tenant}/generation={generation}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    gone = (F.col("tenant_id") == tenant) & (F.col("generation") == generation)
    return runs.withColumn("state", F.when(gone, "reaped").otherwise(F.col("state")))


def collected(spark, runs: DataFrame, pointers: DataFrame, now: Column, tables: list[str], dry: bool = False) -> tuple[list[tuple[str, int]], DataFrame]:
    """Reaps what may be collected, or only names it. A generation is a folder, so the list is as long as the runs to go."""
    from .generations import collectable

    ends = pointers.select("tenant_id", F.explode(F.array("active_generation", "rollback_generation")).alias("generation")).distinct()
    marked = runs.join(ends.withColumn("pointed", F.lit(True)), ["tenant_id", "generation"], "left").withColumn("pointed", F.coalesce("pointed", F.lit(False))).withColumnRenamed("tenant_id", "tenant")
    going = [(r["tenant"], r["generation"]) for r in collectable(marked, now).orderBy("tenant", "generation").collect()]
    for tenant, generation in [] if dry else going:
        runs = reaped(spark, runs, tenant, generation, tables)
    return going, runs


def same_commit(runs: DataFrame, tenant: str, generation: int, commit: str | None) -> bool:
    """Whether a generation was built from this commit; unknown ones are alike."""
    row = runs.where((F.col("tenant_id") == tenant) & (F.col("generation") == generation)).select("source_commit").first()
    return row is not None and (row[0] or "") == (commit or "")


def carry_sources(chunks: DataFrame, runs: DataFrame, corpus: str, building: int) -> DataFrame:
    """Generations whose vectors a build of a corpus may carry, and their priority: complete ones first, then the newest.

    Runs that are being built count, abandoned and reaped ones don't, nor those of another corpus.
    """
    complete = F.when(F.col("state").isin("ready", "active", "retired"), 0).otherwise(1)
    rows = chunks.where((F.col("embedding_status") == "embedded") & (F.col("generation") != building)).select("tenant_id", "generation").distinct()
    ranked = rows.join(runs.where((F.col("corpus_id") == corpus) & F.col("state").isin("ready", "active", "retired", "building")).select("tenant_id", "generation", complete.alias("rank")), ["tenant_id", "generation"])
    number = F.row_number().over(Window.partitionBy("tenant_id").orderBy("rank", F.col("generation").desc()))
    return ranked.select("tenant_id", "generation", (number - 1).alias("priority"))


def best_carry_source(chunks: DataFrame, runs: DataFrame, corpus: str, building: int) -> DataFrame:
    """For each tenant the newest complete generation of the corpus with vectors; tenants without one have no row."""
    rows = chunks.where((F.col("embedding_status") == "embedded") & (F.col("generation") != building)).select("tenant_id", "generation").distinct()
    complete = runs.where((F.col("corpus_id") == corpus) & F.col("state").isin("ready", "active", "retired")).select("tenant_id", "generation")
    return rows.join(complete, ["tenant_id", "generation"]).groupBy("tenant_id").agg(F.max("generation").alias("generation"))


def space_problems(chunks: DataFrame, model: str, dim: int) -> DataFrame:
    """Stored vectors of another model or length than declared: (embedding_model, dim, chunks). None: the space is one."""
    found = chunks.where("embedding is not null").groupBy("embedding_model", F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("chunks"))
    return found.where(~F.col("embedding_model").eqNullSafe(F.lit(model)) | (F.col("dim") != dim))


def other_models(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Tenants whose new chunks name another model than the stored ones: such a write is to be refused."""
    old = stored.select("tenant_id", "embedding_model").distinct()
    return new.select("tenant_id", F.col("embedding_model").alias("new_model")).distinct().join(old, "tenant_id").where("new_model <> embedding_model").select("tenant_id").distinct()


def ordered_parents_first(nodes: DataFrame) -> DataFrame:
    """Nodes with level, parents before children. An unknown parent or a cycle fails: such nodes have no level."""
    from ..durable import Scratch
    from .labels import reached

    levels = reached(nodes, Scratch.of(nodes.sparkSession)).select("node_id", F.col("depth").cast("int").alias("level"))
    unplaced = F.when(F.col("level").isNull(), F.raise_error(F.concat(F.lit("unknown parent or cycle at "), F.col("node_id"))).cast("int")).otherwise(F.col("level"))
    return nodes.join(levels, "node_id", "left").withColumn("level", unplaced)


def ordered_leaves_first(nodes: DataFrame) -> DataFrame:
    """Nodes with turn: what is deleted in one turn has no children left. A parent that isn't there holds nobody up; a cycle fails."""
    from ..durable import Scratch
    from .labels import reached

    here = nodes.select(F.col("node_id").alias("_here"))
    rooted = nodes.select("node_id", "parent_id").join(here, F.col("parent_id") == F.col("_here"), "left").select("node_id", F.col("_here").alias("parent_id"))
    heights = reached(rooted, Scratch.of(nodes.sparkSession)).select("node_id", F.col("height").cast("int").alias("turn"))
    stuck = F.when(F.col("turn").isNull(), F.raise_error(F.concat(F.lit("a cycle at "), F.col("node_id"))).cast("int")).otherwise(F.col("turn"))
    return nodes.join(heights, "node_id", "left").withColumn("turn", stuck)
