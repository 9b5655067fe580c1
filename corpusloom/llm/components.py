"""Connected components by alternating large and small stars, with DataFrame operations only.

Every round links each node's larger neighbours to the least node it knows, then the same for
its smaller neighbours; after a few rounds each component is a star around its least node
(Kiveris et al., 2014). A node's neighbours are never gathered: their least is an aggregate,
combined before the shuffle, and joined back. A hub's rows in that join can be split, as the
other side has one row. Each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. One round of stars; again u > v, distinct."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        out = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
        out = out.where(F.col("u") != F.col("v")).select("u", "v").unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """node and component, the least node of its component, for each node with a link to another.

    Null ends and links of a node to itself say nothing. No edges: an empty result.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(pairs, name)
    mark = None
    while True:
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign == mark or not sign["n"]:
            break
        mark = sign
        then = written(_stars(_stars(now, True), False), name)
        dropped(now)
        now = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
