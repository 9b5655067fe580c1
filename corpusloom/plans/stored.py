"""What a build stores beside the given tables: made once a session for each folder, and read by the queries that serve from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import Scratch
from ..operators import clusters, index, labels
from ..operators.search import searchable
from .derive import table, tree_nodes, vector_chunks

_made: dict[tuple[str, str, str], object] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]) -> object:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = build()
    return _made[key]


def tree_labels(spark: SparkSession, sf_dir: str, published: bool) -> DataFrame:
    """Interval labels of the node tree, of published nodes or of all, in the order in which they are read."""

    def build() -> DataFrame:
        with Scratch(spark) as scratch:
            rows = labels.labelled(tree_nodes(spark, sf_dir), scratch, F.col("status") == "published" if published else None)
            return Scratch.of(spark).keep(rows.orderBy("pre"))

    return stored(spark, sf_dir, f"labels-{published}", build)


def documents_index(spark: SparkSession, sf_dir: str, config: str) -> index.Index:
    """Stored lexemes of all documents."""

    def build() -> index.Index:
        folder = Scratch.of(spark).folder()
        rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
        cores = spark.sparkContext.defaultParallelism
        index.write(index.postings(rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores), config), folder, config)
        return index.Index(spark, folder, config)

    return stored(spark, sf_dir, f"lexemes-{config}", build)


def vector_index(spark: SparkSession, sf_dir: str) -> clusters.Clusters:
    """The exact vector index of all chunks."""

    def build() -> clusters.Clusters:
        folder = Scratch.of(spark).folder()
        clusters.write(vector_chunks(spark, sf_dir), folder)
        return clusters.Clusters(spark, folder)

    return stored(spark, sf_dir, "clusters", build)


def saying_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with vectors whose texts say enough to be found; the texts themselves stay where they are."""

    def build() -> DataFrame:
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.lit("prose").alias("source_type"))
        return Scratch.of(spark).keep(vector_chunks(spark, sf_dir).join(searchable(docs).select("chunk_id"), "chunk_id", "left_semi"))

    return stored(spark, sf_dir, "saying-enough", build)
