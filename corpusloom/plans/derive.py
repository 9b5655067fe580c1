"""Relations that the queries share, derived from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tier(key: Column) -> Column:
    return F.when(key % 4 == 0, "public").when(key % 4 == 1, "internal").when(key % 4 == 2, "restricted")


TIER_SQL = "CASE {0} % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'restricted' END"


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with vectors; a label is a node."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("chunk_id"),
        F.col("label").alias("node_id"),
        "embedding",
        F.when(F.col("vec_id") % 11 == 0, "draft").otherwise("published").alias("status"),
        tier(F.col("vec_id")).alias("visibility"),
    )


CHUNKS_SQL = f"""chunks AS (SELECT vec_id AS chunk_id, label AS node_id, embedding::DOUBLE[] AS embedding,
  CASE WHEN vec_id % 11 = 0 THEN 'draft' ELSE 'published' END AS status, {TIER_SQL.format("vec_id")} AS visibility FROM embeddings)"""


def slug(name: Column) -> Column:
    from ..functions.text import node_slug

    return node_slug(name)


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region > nation > customer and supplier, as sections and documents."""
    r, n, c, s = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))

    def level(df: DataFrame, mark: str, key: str, parent: Column, name: str, kind: str) -> DataFrame:
        k = F.col(key).cast("long")
        return df.select(
            F.concat(F.lit(f"{mark}:"), k.cast("string")).alias("node_id"),
            parent.alias("parent_id"),
            slug(F.col(name)).alias("slug"),
            F.col(name).alias("title"),
            F.lit(kind).alias("kind"),
            F.when(k % 3 == 1, -k / 4.0).otherwise(k.cast("double")).alias("ord"),
            F.when((k % 23 == 5) & F.lit(kind == "document"), "draft").otherwise("published").alias("status"),
            (tier(k) if kind == "document" else F.lit(None).cast("string")).alias("visibility"),
        )

    return (
        level(r, "r", "r_regionkey", F.lit(None).cast("string"), "r_name", "section")
        .unionByName(level(n, "n", "n_nationkey", F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")), "n_name", "section"))
        .unionByName(level(c, "c", "c_custkey", F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")), "c_name", "document"))
        .unionByName(level(s, "s", "s_suppkey", F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")), "s_name", "document"))
    )


def _slug_sql(name: str) -> str:
    plain = f"trim(regexp_replace(lower({name}), '[^a-z0-9]+', '-', 'g'), '-')"
    return f"coalesce(nullif({plain}, ''), 'x-' || substr(sha256({name}), 1, 8))"


def _level_sql(mark: str, key: str, parent: str, name: str, kind: str, of: str) -> str:
    k = f"{key}::BIGINT"
    status = f"CASE WHEN {k} % 23 = 5 THEN 'draft' ELSE 'published' END" if kind == "document" else "'published'"
    vis = TIER_SQL.format(k) if kind == "document" else "NULL::VARCHAR"
    return f"SELECT '{mark}:' || {k} AS node_id, {parent} AS parent_id, {_slug_sql(name)} AS slug, {name} AS title, '{kind}' AS kind, CASE WHEN {k} % 3 = 1 THEN -{k} / 4.0::DOUBLE ELSE {k}::DOUBLE END AS ord, {status} AS status, {vis} AS visibility FROM {of}"


NODES_SQL = "nodes AS (" + " UNION ALL ".join([
    _level_sql("r", "r_regionkey", "NULL::VARCHAR", "r_name", "section", "region"),
    _level_sql("n", "n_nationkey", "'r:' || n_regionkey", "n_name", "section", "nation"),
    _level_sql("c", "c_custkey", "'n:' || c_nationkey", "c_name", "document", "customer"),
    _level_sql("s", "s_suppkey", "'n:' || s_nationkey", "s_name", "document", "supplier"),
]) + ")"


def denylist(spark: SparkSession) -> DataFrame:
    """One subtree, one node, one id that nothing has."""
    return spark.createDataFrame([("n:3", "subtree", "policy"), ("c:7", "node", "request"), ("c:none", "node", "old")], "stable_id string, scope string, reason string")


DENYLIST_SQL = "denylist(stable_id, scope, reason) AS (VALUES ('n:3', 'subtree', 'policy'), ('c:7', 'node', 'request'), ('c:none', 'node', 'old'))"


def generation(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    """Sources of one of two generations: rows left out, texts edited, titles changed."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    second = number == 2
    text = F.when(i % 13 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text")) if second else F.col("text")
    title = F.concat(F.lit("Document "), i.cast("string"))
    title = F.when(i % 19 == 0, F.concat(title, F.lit(" revised"))).otherwise(title) if second else title
    kept = d.where(i % 17 != 0) if second else d.where(i % 10 != 0)
    return kept.select(
        F.lit(number).cast("long").alias("generation"),
        F.concat(F.lit("doc-"), i.cast("string")).alias("stable_id"),
        title.alias("title"),
        text.alias("content"),
        F.col("source").alias("folder"),
        i.alias("position"),
        F.when(i % 29 == 0, "failed").otherwise("embedded").alias("old_status"),
        (F.when(i % 23 == 0, "restricted").otherwise(tier(i)) if second else tier(i)).alias("visibility"),
        F.when(i % 31 == 0, "superseded").alias("doc_status"),
        (F.when(i % 37 == 0, "records") if second else F.lit(None).cast("string")).alias("owner"),
        F.when(i % 5 == 0, F.array("lang", "source")).alias("provenance"),
        F.when(i % 31 == 0, F.lit("doc-1")).alias("superseded_by"),
    )


def generation_sql(number: int) -> str:
    text = "CASE WHEN doc_id % 13 = 0 THEN text || ' v2' ELSE text END" if number == 2 else "text"
    title = "'Document ' || doc_id" + (" || CASE WHEN doc_id % 19 = 0 THEN ' revised' ELSE '' END" if number == 2 else "")
    vis = TIER_SQL.format("doc_id")
    vis = f"CASE WHEN doc_id % 23 = 0 THEN 'restricted' ELSE {vis} END" if number == 2 else vis
    owner = "CASE WHEN doc_id % 37 = 0 THEN 'records' END" if number == 2 else "NULL::VARCHAR"
    kept = "doc_id % 17 <> 0" if number == 2 else "doc_id % 10 <> 0"
    return f"""gen{number} AS (SELECT {number}::BIGINT AS generation, 'doc-' || doc_id AS stable_id, {title} AS title, {text} AS content, source AS folder, doc_id AS position,
  CASE WHEN doc_id % 29 = 0 THEN 'failed' ELSE 'embedded' END AS old_status, {vis} AS visibility, CASE WHEN doc_id % 31 = 0 THEN 'superseded' END AS doc_status, {owner} AS owner,
  CASE WHEN doc_id % 5 = 0 THEN [lang, source] END AS provenance, CASE WHEN doc_id % 31 = 0 THEN 'doc-1' END AS superseded_by FROM documents WHERE {kept})"""
