"""Checks of a corpus as queries: each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import Scratch
from ..functions import text as X

#: The keys that a document of each profile has, the states that it may be in, and keys that would be a second identity.
PROFILES = {"knowledge": ("title", "status", "owner", "provenance"), "docs": ("title", "status")}
STATES = ("draft", "review", "approved", "superseded")
FORBIDDEN = ("id", "name")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Values that stand more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unknown(rows: DataFrame, reference: str, key: str, known: DataFrame | None = None) -> DataFrame:
    """Rows whose reference isn't null and names nothing."""
    names = (rows if known is None else known).select(F.col(key).alias("_known"))
    return rows.where(F.col(reference).isNotNull()).join(names, F.col(reference) == F.col("_known"), "left_anti")


def collisions(nodes: DataFrame) -> DataFrame:
    """Slugs that siblings share; roots, whose parent is null, are siblings."""
    return duplicates(nodes, "parent_id", "slug")


def dead(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links (target, ...) to what isn't known."""
    return links.join(known, "target", "left_anti")


def outside(path: Column, root: str) -> Column:
    """Whether a path leaves the root."""
    return ~path.startswith(root.rstrip("/") + "/") | path.contains("/../") | path.endswith("/..")


def missing_keys(frontmatter: Column, required: list[str]) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), F.map_keys(frontmatter))


def profile_problems(docs: DataFrame, profile: str = "knowledge") -> DataFrame:
    """docs (path, meta: a map of texts, null without front matter) that break their profile: path, problem and what it is about.

    no_frontmatter; missing (a key); forbidden (an authored id or name); no_state (a status without a value); unknown_state.
    """
    one = lambda problem, about: F.struct(F.lit(problem).alias("problem"), about.cast("string").alias("about"))
    meta = F.col("meta")
    keys, state = F.map_keys(meta), F.coalesce(F.try_element_at(meta, F.lit("status")), F.lit(""))
    missing = F.transform(missing_keys(meta, list(PROFILES[profile])), lambda k: one("missing", k))
    forbidden = F.transform(F.array_intersect(F.array(*map(F.lit, FORBIDDEN)), keys), lambda k: one("forbidden", k))
    wrong = F.when(state == "", F.array(one("no_state", F.lit(None)))).when(~state.isin(*STATES), F.array(one("unknown_state", state))).otherwise(F.array().cast("array<struct<problem:string,about:string>>"))
    wrong = F.when(F.array_contains(keys, "status"), wrong).otherwise(F.array().cast("array<struct<problem:string,about:string>>"))
    all_ = F.when(meta.isNull(), F.array(one("no_frontmatter", F.lit(None)))).otherwise(F.concat(missing, forbidden, wrong))
    return docs.select("path", F.explode(all_).alias("p")).select("path", "p.*")


def dead_relative(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Links in the text of docs (path, body) that lead to no file or folder of the tree: path and target.

    files: path of everything in the tree, whatever its kind. What stands in code is no link; links to the
    web, to mail and within the page aren't looked for. Nothing is known outside the tree, so a link that
    climbs out of it, or begins at a root, is dead.
    """
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    there = files.select(F.explode(ups).alias("_at")).distinct()
    links = docs.select("path", F.explode(X.inline_links(X.code_free(F.coalesce("body", F.lit(""))))).alias("target"))
    links = links.where((F.col("target") != "") & ~F.col("target").rlike("^(?:https?:|mailto:|#)"))
    place = F.regexp_replace("target", "#.*$", "")
    known = ~F.col("target").startswith("/") & X.stays_inside(F.col("path"), place)
    links = links.withColumn("_at", F.when(known, X.resolved_from(F.col("path"), place)))
    return links.join(there, "_at", "left_anti").select("path", "target")


def rings(links: DataFrame, key: str, to: str) -> DataFrame:
    """key and ring, the least key of its cycle, of rows that following `to` leads back to. A key has one link.

    Pointer jumping: after as many steps as there are links, and those take a logarithm of rounds, every
    walk is over or in a cycle, and a cycle's members are what such walks arrive at. Then the least key
    seen doubles its reach in the same way.
    """
    scratch = Scratch.of(links.sparkSession)
    one = links.where(F.col(to).isNotNull()).groupBy(F.col(key).alias("node")).agg(F.min(to).alias("to"))
    first = now = scratch.keep(one)
    n, step = first.count(), 1
    while step < n and not now.isEmpty():
        now, before = scratch.keep(now.select("node", F.col("to").alias("at")).join(now.select(F.col("node").alias("at"), "to"), "at").select("node", "to")), now
        if before is not first:
            scratch.drop(before)
        step *= 2
    members = now.select(F.col("to").alias("node")).distinct()
    ring = scratch.keep(first.join(members, "node").select("node", "to", F.least("node", "to").alias("least")))
    step = 1
    while step < ring.count():
        ahead = ring.select(F.col("node").alias("at"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        ring, before = scratch.keep(ring.join(ahead, F.col("to") == F.col("at")).select("node", F.col("_to").alias("to"), F.least("least", "_least").alias("least"))), ring
        scratch.drop(before)
        step *= 2
    return ring.select(F.col("node").alias(key), F.col("least").alias("ring"))


def supersession_problems(docs: DataFrame) -> DataFrame:
    """doc_id and problem: cycle, chain (the successor is itself replaced) or less_visible (it is for fewer readers).

    docs: doc_id, superseded_by, rank (0: everyone). Cycles of any length are found in rounds by the logarithm of the links.
    """
    links = docs.where("superseded_by is not null")
    to = docs.select(F.col("doc_id").alias("_to"), F.col("superseded_by").alias("_next"), F.col("rank").alias("_rank"))
    first = links.join(to, F.col("superseded_by") == F.col("_to"))
    chain = first.where("_next is not null").select("doc_id", F.lit("chain").alias("problem"))
    hidden = first.where("_rank > rank").select("doc_id", F.lit("less_visible").alias("problem"))
    return chain.unionByName(hidden).unionByName(rings(links, "doc_id", "superseded_by").select("doc_id", F.lit("cycle").alias("problem")))
