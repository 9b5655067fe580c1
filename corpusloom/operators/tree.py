"""The node tree: paths, ancestors, address resolution, outlines, denials.

What goes along ancestors doubles its reach every round, so depth costs rounds by its logarithm. Outlines
and denials are conditions on interval labels, which a build stores with its generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..durable import Scratch
from . import labels as L
from .labels import order_part

PUBLISHED = "status = 'published'"
#: Levels of an outline that are joined in one plan; deeper ones double.
JOINED_LEVELS = 6


def walk_down(nodes: DataFrame, only: Column | None = None) -> DataFrame:
    """Nodes that roots reach through nodes that pass: with path, depth and sort_key (one entry a level)."""
    scratch = Scratch.of(nodes.sparkSession)
    rows = nodes if only is None else nodes.where(only)
    part = F.array(order_part(F.col("ord"), F.col("slug")))
    first = L._parents(rows.select("node_id", "parent_id", F.col("slug").alias("path"), part.alias("sort_key"))).select("node_id", "up", "whole", "path", "sort_key")

    def above(columns: list[str], step: int) -> dict[str, Column]:
        up = F.col("u_node_id").isNotNull()
        return {
            "whole": F.when(up, F.col("whole") & F.col("u_whole")).otherwise(F.col("whole")),
            "path": F.when(up, F.concat("u_path", F.lit("/"), "path")).otherwise(F.col("path")),
            "sort_key": F.when(up, F.concat("u_sort_key", "sort_key")).otherwise(F.col("sort_key")),
        }

    done = L._rounds(first, scratch, above).where("up is null and whole")
    return rows.join(done.select("node_id", "path", (F.size("sort_key") - 1).alias("depth"), "sort_key").hint("merge"), "node_id").select(*rows.columns, "path", "depth", "sort_key")


def ancestors(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """node_id, ancestor_id and climbed (steps, 1 for the parent) of the nodes, or of those in `of`. A cycle of parents fails.

    After k rounds every row within 2^k steps is there: those found so far climb 2^k steps at once.
    """
    scratch = Scratch.of(nodes.sparkSession)
    jump = scratch.keep(nodes.where("parent_id is not null").select("node_id", F.col("parent_id").alias("to")).distinct())
    begin = nodes if of is None else nodes.join(of.select("node_id"), "node_id", "left_semi")
    found = scratch.keep(begin.where("parent_id is not null").select("node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("climbed")).distinct())
    most, step, count = jump.count(), 1, F.count(F.lit(1))
    while True:
        up = jump.select(F.col("node_id").alias("_node"), F.col("to").alias("_to"))
        more = found.join(up, F.col("ancestor_id") == F.col("_node")).select("node_id", F.col("_to").alias("ancestor_id"), (F.col("climbed") + step).alias("climbed"))
        more = scratch.keep(more, n=count)
        if not more.counted["n"]:
            scratch.drop(more)
            return found
        if step > most:
            raise ValueError("a node is its own ancestor")
        joined = scratch.keep(found.unionByName(more))
        scratch.drop(found)
        scratch.drop(more)
        found = joined
        far, near = jump.select(F.col("to").alias("_at"), "node_id"), jump.select(F.col("node_id").alias("_at"), "to")
        jump, before = scratch.keep(far.join(near, "_at").select("node_id", "to")), jump
        scratch.drop(before)
        step *= 2


def denied(nodes: DataFrame, denylist: DataFrame) -> DataFrame:
    """Distinct node_id (and stable_id) of listed nodes, and of all below those listed as subtree.

    In a cycle of parents all are below each other. Nodes without a stable_id are listed by node_id.
    Labelled nodes (pre and last) are asked by range, in one pass.
    """
    named = nodes if "stable_id" in nodes.columns else nodes.withColumn("stable_id", F.col("node_id"))
    listed = denylist.groupBy("stable_id").agg(F.bool_or(F.col("scope") == "subtree").alias("cascade"))
    scratch = Scratch.of(nodes.sparkSession)
    if "pre" in nodes.columns:
        seeds = named.join(listed.hint("merge"), "stable_id")
        ranges = seeds.select(F.col("pre").alias("first"), F.when(F.col("cascade"), F.col("last")).otherwise(F.col("pre")).alias("last"))
        return L.within(named, ranges, scratch).select("node_id", "stable_id")
    marked = named.select("node_id", "parent_id", "stable_id").join(listed.hint("merge"), "stable_id", "left")
    marked = scratch.keep(marked.select("node_id", "parent_id", "stable_id", F.col("cascade").isNotNull().alias("seed"), F.coalesce("cascade", F.lit(False)).alias("below")))
    if marked.where("below").isEmpty():
        return marked.where("seed").select("node_id", "stable_id").distinct()
    rows = L._parents(marked).select("node_id", "up", "stable_id", "seed", "below")
    done = L._rounds(rows, scratch, lambda columns, step: {"stable_id": F.col("stable_id"), "seed": F.col("seed"), "below": F.col("below") | F.coalesce("u_below", F.lit(False))})
    return done.where("seed or below").select("node_id", "stable_id")


def visible(tiers: list[str] | None, default: str, column: str = "visibility") -> Column:
    """Whether a row may be read: undeclared (null or empty) counts as the default; no tiers, nothing."""
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(default)).isin(tiers) if tiers else F.lit(False)


def outline(nodes: DataFrame, denied_ids: DataFrame, tiers: list[str], default: str = "public", anchor: str | None = None, depth: int = 2, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows of the outline in reading order, with position among visible siblings and visible children.

    nodes: labelled ones, published only; others are labelled first. Descends through published nodes
    whatever their tier, and judges each row on its own. An anchor isn't among its rows; an unknown one has none.
    """
    scratch = Scratch.of(nodes.sparkSession)
    rows = nodes if "pre" in nodes.columns else scratch.keep(L.labelled(nodes, scratch, F.expr(PUBLISHED)))
    top, prefix = 0, ""
    if anchor is not None:
        base = rows.where(F.col("node_id") == anchor).select("pre", "last", "depth").first()
        if base is None:
            rows = rows.where(F.lit(False))
        else:
            # one row a level
            above = rows.where((F.col("pre") <= base["pre"]) & (F.col("last") >= base["pre"])).orderBy("pre").select("slug").collect()
            top, prefix = base["depth"] + 1, "".join(r["slug"] + "/" for r in above)
            rows = rows.where((F.col("pre") > base["pre"]) & (F.col("pre") <= base["last"]))
    near = rows.where(F.col("depth") <= top + depth)  # one level beyond what is shown counts as children
    seen = near.where(visible(tiers, default)).join(denied_ids.select("node_id").hint("merge"), "node_id", "left_anti")
    counts = seen.groupBy("parent_id").agg(F.count(F.lit(1)).alias("child_count")).withColumnRenamed("parent_id", "_p")
    number = F.row_number().over(Window.partitionBy("parent_id").orderBy("pre"))
    out = seen.withColumn("position", number.cast("long")).where(F.col("depth") < top + depth)
    out = out.join(counts.hint("merge"), F.col("node_id") == F.col("_p"), "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)).cast("long")).drop("_p")
    out = out.join(_paths_from(near.where(F.col("depth") < top + depth), top, depth, scratch).hint("merge"), "node_id").withColumn("path", F.concat(F.lit(prefix), "path")).withColumn("sort_key", F.col("pre"))
    if limit is not None:
        out = out.orderBy("sort_key").offset(offset).limit(limit)
    return out


def _paths_from(rows: DataFrame, top: int, levels: int, scratch: Scratch) -> DataFrame:
    """node_id and path from the level `top` on, of that many levels."""
    if levels > JOINED_LEVELS:
        return L.paths(rows, scratch)
    level = rows.where(F.col("depth") == top).select("node_id", F.col("slug").alias("path"))
    out = level
    for i in range(1, levels):
        up = level.select(F.col("node_id").alias("_up"), F.col("path").alias("_path"))
        level = rows.where(F.col("depth") == top + i).join(up.hint("merge"), F.col("parent_id") == F.col("_up")).select("node_id", F.concat("_path", F.lit("/"), "slug").alias("path"))
        out = out.unionByName(level)
    return out


def climbed(nodes: DataFrame, ids: list[str]) -> dict[str, str]:
    """The paths of a few nodes: step by step, each a filter on the ids of the step. Nodes that reach no root have none.

    nodes: those that a path may go through. Reads as many rows as the paths have segments.
    """
    paths, at = {}, {i: (i, ()) for i in ids}
    seen: dict[str, set] = {i: set() for i in ids}
    while at:
        rows = {r["node_id"]: r for r in nodes.where(F.col("node_id").isin(sorted({node for node, _ in at.values()}))).select("node_id", "parent_id", "slug").collect()}
        after = {}
        for i, (node, below) in at.items():
            row = rows.get(node)
            if row is None or node in seen[i]:
                continue
            seen[i].add(node)
            if row["parent_id"] is None:
                paths[i] = "/".join((row["slug"], *below))
            else:
                after[i] = (row["parent_id"], (row["slug"], *below))
        at = after
    return paths


def resolve(addresses: DataFrame, paths: DataFrame) -> DataFrame:
    """For each address (a path or the end of one) the number of nodes it fits and, if that is 1, the node.

    An equi-join on the last segment; the rest of the address decides.
    """
    last = F.element_at(F.split("address", "/"), -1)
    asked = addresses.select("address", last.alias("_slug"))
    fits = (F.col("path") == F.col("address")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("address")))
    hits = asked.join(paths.select("node_id", "path", F.col("slug").alias("_slug")), "_slug").where(fits)
    found = hits.groupBy("address").agg(F.count(F.lit(1)).alias("candidates"), F.min("node_id").alias("_one"))
    return addresses.join(found, "address", "left").select("address", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), F.when(F.col("candidates") == 1, F.col("_one")).alias("node_id"))


def shortest_unique(paths: DataFrame, least: int = 2) -> DataFrame:
    """node_id and its shortest address of at least two segments that fits no other node; the whole path at worst."""
    parts = F.split("path", "/")
    n = F.size(parts)
    ends = F.transform(F.sequence(F.least(F.lit(least), n), n), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, n - k + 1, k), "/").alias("address")))
    rows = paths.select("node_id", "path", F.explode(ends).alias("e")).select("node_id", "path", "e.*")
    alone = rows.groupBy("address").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("node_id"), F.min("k").alias("k")).where("n = 1")
    best = alone.groupBy("node_id").agg(F.min(F.struct("k", "address")).alias("best"))
    return paths.select("node_id", "path").join(best, "node_id", "left").select("node_id", F.coalesce("best.address", "path").alias("address"))


def flattened(addresses: DataFrame, aliases: DataFrame) -> DataFrame:
    """address with its last segment replaced where it is an alias (alias, canonical)."""
    last = F.element_at(F.split("address", "/"), -1)
    rows = addresses.withColumn("_last", last).join(aliases, F.col("_last") == F.col("alias"), "left")
    head = F.substring(F.col("address"), F.lit(1), F.length("address") - F.length("_last"))
    return rows.select("address", F.when(F.col("canonical").isNotNull(), F.concat(head, F.col("canonical"))).otherwise(F.col("address")).alias("canonical_address"))


def shallowest(dirs: DataFrame) -> DataFrame:
    """Directories (dir) without those that lie under another of them: joined on every prefix."""
    d = dirs.select("dir").distinct()
    parts = F.split("dir", "/")
    above = d.select("dir", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/")))).alias("up"))
    under = above.join(d.select(F.col("dir").alias("up")), "up", "left_semi").select("dir")
    return d.join(under, "dir", "left_anti")


def rebased(rows: DataFrame, path: str, base: int) -> DataFrame:
    """Outline rows that begin at an anchor (its own slug, depth 0), as seen from the root; the anchor itself goes.

    path and base: the anchor's own path and depth.
    """
    head = path[: path.rfind("/") + 1]
    return rows.where("depth <> 0").withColumn("path", F.concat(F.lit(head), "path")).withColumn("depth", F.col("depth") + F.lit(base))


def unit_tree(chunks: DataFrame, key: str, path: str = "heading_path_text", ordinal: str = "ordinal") -> DataFrame:
    """A document's headings by their first place; text before any heading is none."""
    return chunks.where(F.coalesce(path, F.lit("")) != "").groupBy(key, path).agg(F.min(ordinal).alias("first"))


def assembled(chunks: DataFrame, key: str, order: list[str], content: str, between: str = "") -> DataFrame:
    """key, text and n: the chunks of each document in order as one text. A document is one value, so it meets in one task."""
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, content))).alias("_c"))
    return rows.select(key, F.array_join(F.transform("_c", lambda x: F.coalesce(x[content], F.lit(""))), between).alias("text"), F.size("_c").cast("long").alias("n"))
