"""Who may see what: the tenant wall, tiers, takedowns and the checks before a generation is served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The schema version since which a generation's nodes carry their visibility.
GOVERNED_SINCE = "2.2"


def walled(rows: DataFrame, tenant: str | None) -> DataFrame:
    """A tenant's rows; without a tenant none."""
    return rows.where(F.lit(False)) if tenant is None else rows.where(F.col("tenant_id") == tenant)


def decided(visibility: Column, audiences: tuple[str, ...], default: str, viewer: str) -> Column:
    """Whether a viewer's rank reaches a row's tier; undeclared counts as the default, an unknown tier as hidden."""
    tiers = F.array(*map(F.lit, audiences))
    rank = F.array_position(tiers, F.coalesce(F.nullif(visibility, F.lit("")), F.lit(default)))
    return (rank > 0) & (rank <= F.array_position(tiers, F.lit(viewer)))


def version(text: Column) -> Column:
    """A version as numbers, which compare part by part."""
    return F.transform(F.split(text, r"\."), lambda p: p.try_cast("int"))


def ungoverned(runs: DataFrame) -> DataFrame:
    """Generations built before nodes had a visibility: not to be served where an audience model is declared."""
    return runs.where(F.col("schema_version").isNull() | (version(F.col("schema_version")) < version(F.lit(GOVERNED_SINCE))))


def restricted_without_model(nodes: DataFrame) -> DataFrame:
    """How many nodes declare a visibility, which nothing would heed where no audience model is declared."""
    return nodes.agg(F.count("visibility").alias("restricted"))


def orphaned(denylist: DataFrame, nodes: DataFrame) -> DataFrame:
    """Denied ids that no node has, in order."""
    return denylist.join(nodes.select("stable_id"), "stable_id", "left_anti").select("stable_id").orderBy("stable_id")


def all_denied(denied: DataFrame, denylist: DataFrame) -> DataFrame:
    """Ids of denied nodes and all listed ids, even those that nothing has."""
    return denied.select("stable_id").unionByName(denylist.select("stable_id")).distinct()


def live_rows(pinned: DataFrame, live: DataFrame, allowed: Column) -> DataFrame:
    """Rows of a pinned generation that the live generation still has and lets be read, judged by the live row."""
    return pinned.join(live.where(allowed).select("stable_id").distinct(), "stable_id")


def taken_down(denylist: DataFrame, entries: DataFrame, nodes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The denylist with entries (stable_id, scope, reason) upserted, and per entry whether it changed anything and whether a node has its id.

    An entry that says what is listed already changes nothing; one that says otherwise keeps its date.
    """
    old = denylist.select("stable_id", F.col("scope").alias("_scope"), F.col("reason").alias("_reason"), F.col("created_at").alias("_at"))
    both = entries.join(old, "stable_id", "full")
    same = F.col("_scope").eqNullSafe(F.col("scope")) & F.col("_reason").eqNullSafe(F.col("reason"))
    asked, listed = F.col("scope").isNotNull(), F.col("_at").isNotNull()
    after = both.select("stable_id", F.when(asked, F.col("scope")).otherwise(F.col("_scope")).alias("scope"), F.when(asked, F.col("reason")).otherwise(F.col("_reason")).alias("reason"), F.coalesce("_at", now).alias("created_at"))
    known = nodes.select("stable_id", F.lit(True).alias("_known")).distinct()
    outcome = both.where(asked).join(known, "stable_id", "left").select("stable_id", "scope", F.when(listed & same, "unchanged").otherwise("applied").alias("change"), F.coalesce("_known", F.lit(False)).alias("resolves"))
    return after, outcome


def revoked(denylist: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The denylist without some ids, and per id whether it was listed."""
    listed = denylist.select("stable_id", F.lit(True).alias("_listed"))
    outcome = ids.join(listed, "stable_id", "left").select("stable_id", F.when(F.col("_listed"), "revoked").otherwise("not-denied").alias("change"))
    return denylist.join(ids, "stable_id", "left_anti"), outcome


def takedowns(denylist: DataFrame) -> DataFrame:
    """What is taken down, oldest first."""
    return denylist.orderBy("created_at", "stable_id")


def granted(rows: DataFrame, grants: DataFrame, role: str) -> DataFrame:
    """Rows of tenants that the role may write."""
    return rows.join(grants.where(F.col("role") == role).select("tenant_id").distinct(), "tenant_id", "left_semi")


def folder_of(path: Column) -> Column:
    """The folder of a path, with a / at its end; / for a path without a folder."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "[^/]*$", "")).otherwise(F.lit("/"))


def prefixes(folder: Column) -> Column:
    """A folder and all above it, each with a / at its end, and / itself."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    ups = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    return F.concat(F.array(F.lit("/")), F.coalesce(ups, F.array().cast("array<string>")))


def denied_folders(nodes: DataFrame, sources: DataFrame, denylist: DataFrame) -> DataFrame:
    """Folders that subtree denials take down, without those that lie in another of them.

    Files of all below a listed node count; its own file only if it has children, as else its folder
    holds its siblings. A listed section without an index file (its id ends in #section) counts as if
    it had one. Joined on every prefix, never folder by folder.
    """
    from .tree import denied

    seeds = nodes.join(denylist.where("scope = 'subtree'").select("stable_id"), "stable_id", "left_semi").select("node_id", "stable_id")
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()
    containers = seeds.join(parents, "node_id", "left_semi")
    walked = denied(nodes, denylist.where("scope = 'subtree'")).join(seeds.join(parents, "node_id", "left_anti"), "node_id", "left_anti")
    files = sources.join(walked, "node_id", "left_semi").select(folder_of(F.col("origin_path")).alias("dir"))
    made = containers.where(F.col("stable_id").endswith("#section")).select(F.concat(F.regexp_replace("stable_id", "#section$", ""), F.lit("/")).alias("dir"))
    dirs = files.unionByName(made).distinct()
    above = dirs.select("dir", F.explode(prefixes(F.col("dir"))).alias("up")).where("up <> dir")
    return dirs.join(above.join(dirs.select(F.col("dir").alias("up")), "up", "left_semi").select("dir"), "dir", "left_anti").orderBy("dir")


def undenied(docs: DataFrame, ids: DataFrame, folders: DataFrame, path: str = "path") -> DataFrame:
    """Documents (stable_id, path) that are neither listed nor in a denied folder or below one."""
    up = docs.select("stable_id", path, F.explode(prefixes(folder_of(F.col(path)))).alias("dir"))
    inside = up.join(folders.select(F.when(F.col("dir").endswith("/"), F.col("dir")).otherwise(F.concat("dir", F.lit("/"))).alias("dir")), "dir", "left_semi").select("stable_id", path).distinct()
    return docs.join(ids.select("stable_id"), "stable_id", "left_anti").join(inside, ["stable_id", path], "left_anti")
