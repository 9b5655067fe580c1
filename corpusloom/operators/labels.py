"""Interval labels of a forest, by pointer doubling.

In round k every node knows its ancestor 2^k steps up, so a forest of any depth is done in about
log2(depth) rounds, each a join and an aggregate of one row a node. A round also knows, of each
node's descendants at less than 2^k steps, how many they are and how far the farthest is:
those at 2^k to 2^(k+1) - 1 steps are counted by the nodes that stand exactly 2^k steps below.

With sizes known a node's number in reading order is its parent's plus one plus the sizes of its
earlier siblings, a sum along its ancestors, doubled up in the same way. What lies below a node is
then the range pre < x <= last, and what is above it those whose range holds its pre.

Defined cases: a parent that isn't there, or is left out, ends a path: such nodes aren't reached.
Nodes of a cycle, and those below one, never come to an end; a forest of n nodes is at most n deep,
so after log2(n) rounds what still has an ancestor is of that kind. It is not reached either.
Rows that repeat a node_id raise an error, as they would multiply with every round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..durable import Scratch

#: Ranges that are written into a filter, where they prune files; more are joined.
MOST_RANGES = 200
#: Bits of a number in reading order.
PLACE_BITS = 40


def order_part(ord_: Column, name: Column) -> Column:
    """Sorts as (order, name), the order as a number and the name by code points."""
    return F.struct(ord_.cast("double").alias("ord"), name.alias("name"))


def looked_up(rows: DataFrame, key: str, other: DataFrame, name: str) -> DataFrame:
    """rows with the columns of other where rows.key is other.name, or null.

    Merged, as packed columns look small and Spark would send them through the driver; rows without
    a key stay apart, where they would meet in one task.
    """
    found = rows.where(F.col(key).isNotNull()).join(other.hint("merge"), F.col(key) == F.col(name), "left")
    return found.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def _rounds(rows: DataFrame, scratch: Scratch, above, below: list[tuple[str, object]] = ()) -> DataFrame:
    """Doubles until no node has an ancestor left.

    rows: node_id, up (the parent, null at a root or outside) and columns that rounds combine.
    above(own, up): the columns of a node from its own and its ancestor's (the prefix u_).
    below: (column, f(step, aggregate's input) -> aggregate, combine(own, found)) of nodes below.
    """
    climbing = F.count_if(F.col("up").isNotNull())
    now = scratch.keep(rows, rows=F.count(F.lit(1)), climbing=climbing)
    most, step = max(now.counted["rows"], 1), 1
    while step <= 2 * most and now.counted["climbing"]:
        ancestors = now.select(*[F.col(c).alias(f"u_{c}") for c in now.columns])
        out = looked_up(now, "up", ancestors, "u_node_id")
        columns = above(now.columns, step)
        out = out.select("node_id", F.col("u_up").alias("_up"), *[c.alias(n) for n, c in columns.items()])
        if below:
            sums = now.where("up is not null").groupBy(F.col("up").alias("b_id")).agg(*[f(step).alias(f"b_{name}") for name, f, _ in below])
            out = out.join(sums.hint("merge"), F.col("node_id") == F.col("b_id"), "left")
            out = out.select("node_id", "_up", *[n for n in columns if n not in {b[0] for b in below}], *[combine(F.col(name), F.col(f"b_{name}")).alias(name) for name, _, combine in below])
        now, before = scratch.keep(out.withColumnRenamed("_up", "up"), climbing=climbing), now
        scratch.drop(before)
        step *= 2
    return now


def _parents(rows: DataFrame) -> DataFrame:
    """rows with up: the parent where it is among the rows, and whole: whether the node is a root or may have one."""
    known = rows.groupBy(F.col("node_id").alias("_known")).agg(F.count(F.lit(1)).alias("_n"))
    known = known.select("_known", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("node_id stands more than once: "), F.col("_known").cast("string"))).cast("boolean")).otherwise(True).alias("_once"))
    out = looked_up(rows, "parent_id", known, "_known")
    return out.withColumn("up", F.when(F.col("_once"), F.col("_known"))).withColumn("whole", F.col("parent_id").isNull() | F.col("_known").isNotNull()).drop("_known", "_once")


def reached(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """node_id, depth, size (of the subtree, itself included) and height of nodes that a root reaches through the given nodes."""
    rows = _parents(nodes.select("node_id", "parent_id")).select("node_id", "up", "whole", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("height"))

    def above(columns: list[str], step: int) -> dict[str, Column]:
        # an ancestor that isn't a root's descendant takes all below it along
        up = F.col("u_node_id").isNotNull()
        return {"whole": F.when(up, F.col("whole") & F.col("u_whole")).otherwise(F.col("whole")), "depth": F.col("depth") + F.coalesce("u_depth", F.lit(0)), "size": F.col("size"), "height": F.col("height")}

    below = [
        ("size", lambda step: F.sum("size"), lambda own, found: own + F.coalesce(found, F.lit(0))),
        ("height", lambda step: F.max(F.col("height") + step), lambda own, found: F.greatest(own, F.coalesce(found, F.lit(0)))),
    ]
    return _rounds(rows, scratch, above, below).where("up is null and whole").select("node_id", "depth", "size", "height")


def labelled(nodes: DataFrame, scratch: Scratch, only: Column | None = None) -> DataFrame:
    """Nodes that roots reach through nodes that pass, with depth, size, height, pre and last.

    nodes: node_id, parent_id, ord, slug and more. pre numbers them in reading order from 1, last is
    the greatest pre of the subtree. Siblings stand by order and name, then by node_id.
    """
    rows = nodes if only is None else nodes.where(only)
    rows = scratch.keep(rows)
    sized = scratch.keep(rows.join(reached(rows, scratch).hint("merge"), "node_id"))
    siblings = Window.partitionBy("parent_id").orderBy(order_part(F.col("ord"), F.col("slug")), "node_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.select("node_id", "parent_id", (1 + F.coalesce(F.sum("size").over(siblings), F.lit(0))).alias("pre"))
    rows = _parents(offsets).select("node_id", "up", "pre")
    numbers = _rounds(rows, scratch, lambda columns, step: {"pre": F.col("pre") + F.coalesce("u_pre", F.lit(0))})
    out = sized.join(numbers.select("node_id", "pre").hint("merge"), "node_id")
    return out.withColumn("last", F.col("pre") + F.col("size") - 1)


def paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """node_id and path, from a root or from the node whose parent is not given. nodes: node_id, parent_id, slug.

    A path is as long as its node is deep, so give the nodes whose paths are wanted and those above them.
    """
    rows = _parents(nodes.select("node_id", "parent_id", "slug")).select("node_id", "up", F.col("slug").alias("path"))
    done = _rounds(rows, scratch, lambda columns, step: {"path": F.when(F.col("u_path").isNotNull(), F.concat("u_path", F.lit("/"), "path")).otherwise(F.col("path"))})
    return done.where("up is null").select("node_id", "path")


def within(labels: DataFrame, ranges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of labels whose pre lies in one of the ranges (first, last).

    Few ranges are a filter, which prunes files that are sorted by pre. Many are cut into dyadic blocks,
    at most two a power of two, and joined by equality on them; a row has one block of each power that occurs.
    """
    ranges = scratch.keep(ranges.select("first", "last").distinct())
    some = ranges.limit(MOST_RANGES + 1).collect()  # bounded
    if len(some) <= MOST_RANGES:
        inside = F.lit(False)
        for r in some:
            inside = inside | F.col("pre").between(r["first"], r["last"])
        return labels.where(inside)
    cut = []
    for p in range(PLACE_BITS):
        # of blocks of 2^p: the first that begins in the range, and the one that begins at or holds its end
        low, high = F.shiftright(F.col("first") + ((1 << p) - 1), p), F.shiftright(F.col("last") + 1, p)
        cut += [F.when((low < high) & (at % 2 == 1), F.struct(F.lit(p).alias("power"), (at - less).alias("at"))) for at, less in ((low, 0), (high, 1))]
    blocks = scratch.keep(ranges.select(F.explode(F.array_compact(F.array(*cut))).alias("b")).select("b.*").distinct())
    used = [r["power"] for r in blocks.select("power").distinct().collect()]  # PLACE_BITS at most
    keys = F.array(*[F.struct(F.lit(p).alias("power"), F.shiftright("pre", p).alias("at")) for p in used])
    hit = labels.select("pre", F.explode(keys).alias("b")).select("pre", "b.*").join(blocks.hint("merge"), ["power", "at"], "left_semi").select("pre").distinct()
    return labels.join(hit.hint("merge"), "pre", "left_semi")
