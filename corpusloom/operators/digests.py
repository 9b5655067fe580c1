"""Comparing generations by a tree of digests: equal ranges are never read again.

Rows lie in leaves, ranges of the hash of their key. A leaf's digest is the number of its rows and two
sums of parts of their SHA-256, so it doesn't depend on the order of rows and does on how often each
stands; a node's digest is the sum of its children's. Two trees are compared from the root down, and
only the leaves in which they differ are opened. Like generations cost reading two small tables.

Defined cases: nulls are values of their own. Rows that repeat count each. An empty table has a tree
without nodes. Trees of other columns or another number of leaves can't be compared. Sums tell
accidents apart, not forgeries: whoever may write rows freely could make two tables agree.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import files
from .generations import FINGERPRINT, difference

#: Bits of the hash that a leaf has, and those of a level of the tree.
LEAF_BITS, LEVEL_BITS = 8, 4


def _leaf(key: str, bits: int):
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("int")


def write(rows: DataFrame, folder: str, columns: tuple[str, ...] = FINGERPRINT, key: str = "stable_id", bits: int = LEAF_BITS) -> None:
    """Stores rows by leaf and the digests of all levels in a new folder; last what they are, without which it is no tree."""
    spark = rows.sparkSession
    dealt = rows.select(*columns).withColumn("leaf", _leaf(key, bits))
    # rebalanced: a leaf that is too large for one task is split
    dealt.hint("rebalance", "leaf").write.mode("errorifexists").partitionBy("leaf").parquet(f"{folder}/rows")
    schema = rows.select(*columns).schema
    stored = spark.read.schema(StructType([*schema.fields, StructField("leaf", IntegerType())])).parquet(f"{folder}/rows")
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    leaves = stored.select("leaf", part(1).alias("a"), part(16).alias("b")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    levels = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright("leaf", bits - level).alias("at")) for level in range(0, bits + 1, LEVEL_BITS)]))
    # one row a node: 2^bits leaves at most and their parents
    leaves.select(levels.alias("node"), "n", "a", "b").groupBy("node.level", "node.at").agg(F.sum("n").alias("n"), F.sum("a").cast("string").alias("a"), F.sum("b").cast("string").alias("b")).coalesce(1).write.parquet(f"{folder}/digests")
    files.create(spark, f"{folder}/_tree.json", json.dumps({"columns": list(columns), "bits": bits, "schema": schema.json()}))


class Tree:
    """A stored tree. Digests are read by level, rows by leaf."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        about = json.loads(files.read_text(spark, f"{folder}/_tree.json"))
        self.spark, self.folder, self.columns, self.bits = spark, folder, tuple(about["columns"]), about["bits"]
        self.schema = StructType.fromJson(json.loads(about["schema"]))

    def nodes(self, level: int, under: set[int] | None) -> dict[int, tuple]:
        """Digests of a level, of those below some nodes of the level above."""
        rows = self.spark.read.parquet(f"{self.folder}/digests").where(F.col("level") == level)
        if under is not None:
            rows = rows.where(F.shiftright("at", LEVEL_BITS).isin(sorted(under)))
        return {r["at"]: (r["n"], r["a"], r["b"]) for r in rows.collect()}  # 2^bits at most

    def rows(self, leaves: list[int]) -> DataFrame:
        """Rows of some leaves; opens their folders only."""
        folders = [f for f in (f"{self.folder}/rows/leaf={x}" for x in leaves) if files.exists(self.spark, f)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)


def differing(a: Tree, b: Tree) -> list[int]:
    """Leaves in which two trees differ."""
    if a.columns != b.columns or a.bits != b.bits:
        raise ValueError("the trees are of other columns or leaves")
    under: set[int] | None = None
    for level in range(0, a.bits + 1, LEVEL_BITS):
        x, y = a.nodes(level, under), b.nodes(level, under)
        under = {at for at in x.keys() | y.keys() if x.get(at) != y.get(at)}
        if not under:
            return []
    return sorted(under or ())


def compared(a: Tree, b: Tree) -> tuple[DataFrame, list[int]]:
    """Rows of a that b lacks and the other way, with side, as multisets; and the leaves that were opened for it."""
    leaves = differing(a, b)
    return difference(a.rows(leaves), b.rows(leaves), a.columns), leaves
