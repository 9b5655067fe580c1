"""What a corpus is published as: reading order, index, full texts, successors, staging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..durable import Scratch
from . import labels
from .labels import order_part
from .tree import visible

#: Fixed value: the status that a document has unless it says otherwise.
ASSUMED_STATUS = "approved"


def in_order(pages: DataFrame, folders: DataFrame) -> DataFrame:
    """pages (path, order, ...) with sort_key: by the declared order and the name of every folder on the way, then of the file.

    folders: folder and order, as its index file declares it. A folder stands among the files beside it,
    an index file before all of its folder.
    """
    index = F.element_at(F.split("path", "/"), -1).rlike(r"^(?:index\.mdx?|README\.md)$")
    folder = F.regexp_replace("path", "/?[^/]+$", "")
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    n = F.size(parts)
    ups = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, 1, k), "/").alias("folder"), F.element_at(parts, k).alias("name"))))
    rows = pages.withColumn("_index", index)
    walked = rows.select("path", F.explode(ups).alias("u")).select("path", "u.*").join(folders.select("folder", F.col("order").alias("_order")), "folder", "left")
    # as many parts as a path has folders
    way = walked.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", order_part(F.coalesce("_order", F.expr("double('Infinity')")), F.col("name")).alias("part")))).alias("_way"))
    own = F.when(F.col("_index"), F.array().cast("array<struct<ord:double,name:string>>")).otherwise(F.array(order_part(F.col("order"), X.tie_key(F.element_at(F.split("path", "/"), -1)))))
    steps = F.coalesce(F.transform("_way", lambda s: s["part"]), F.array().cast("array<struct<ord:double,name:string>>"))
    return rows.join(way, "path", "left").withColumn("sort_key", F.concat(steps, own)).drop("_way", "_index")


_PART = "array<struct<ord:double,url:string,folder:string>>"


def in_url_order(pages: DataFrame) -> DataFrame:
    """pages (path, url, order, ...) with sort_key, as the second shell shows them: by declared order and then by url at every level.

    An index.md speaks for its folder, and stands before what is in it; that of the root is a page like
    others. A folder without one has no order, and stands where the first page in it would stand. So
    folders are judged from the deepest level up, a round for each level.
    """
    index = F.col("path").endswith("/index.md")
    folder = F.regexp_replace("path", "/?[^/]+$", "")
    no_order = F.expr("double('Infinity')")
    rows = pages.withColumn("_index", index).withColumn("_folder", folder)
    own = F.struct((F.coalesce("order", no_order) + 0.0).alias("ord"), F.col("url").alias("url"), F.lit("").alias("folder"))
    items = rows.select(F.col("_folder").alias("folder"), "_index", own.alias("item"))
    spoken = items.where("_index").select("folder", F.col("item").alias("spoken"))
    files = items.where("not _index").select("folder", "item")
    parts = F.filter(F.split("folder", "/"), lambda p: p != "")
    scratch = Scratch.of(pages.sparkSession)
    folders = scratch.keep(items.select("folder").distinct().withColumn("_parts", parts).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("_parts")), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice("_parts", F.lit(1), k), "/").alias("folder")))).alias("f")).select("f.*").distinct())
    deepest = folders.agg(F.max("depth")).first()[0] or 0
    places, below = [], None
    for depth in range(deepest, 0, -1):
        inside = files if below is None else files.unionByName(below)
        first = inside.join(folders.where(F.col("depth") == depth).select("folder"), "folder").groupBy("folder").agg(F.min("item").alias("first"))
        level = folders.where(F.col("depth") == depth).join(first, "folder", "left").join(spoken, "folder", "left")
        place = F.struct(F.coalesce("spoken.ord", no_order).alias("ord"), F.coalesce("spoken.url", "first.url").alias("url"), F.element_at(F.split("folder", "/"), -1).alias("folder"))
        places.append(scratch.keep(level.select("folder", place.alias("place"))))
        below = places[-1].select(F.regexp_replace("folder", "/?[^/]+$", "").alias("folder"), F.col("place").alias("item"))
    if not places:
        return rows.withColumn("sort_key", F.array(own)).drop("_index", "_folder")
    known = places[0]
    for more in places[1:]:
        known = known.unionByName(more)
    # as many parts as a folder's path has
    ups = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("_parts", F.lit(1), k), "/").alias("up")))
    walked = folders.where("depth > 0").select("folder", parts.alias("_parts")).select(F.col("folder").alias("_folder"), F.explode(ups).alias("u")).select("_folder", "u.*")
    way = walked.join(known.select(F.col("folder").alias("up"), "place"), "up").groupBy("_folder").agg(F.array_sort(F.collect_list(F.struct("k", "place"))).alias("_way"))
    steps = F.coalesce(F.transform("_way", lambda s: s["place"]), F.array().cast(_PART))
    tail = F.when(F.col("_index"), F.array().cast(_PART)).otherwise(F.array(own))
    return rows.join(way, "_folder", "left").withColumn("sort_key", F.concat(steps, tail)).drop("_index", "_folder", "_way")


def plain_lines(pages: DataFrame, base: str = "") -> DataFrame:
    """pages (title, url, description) with line, as the second shell's index has it: a link, and what it says if it says anything."""
    link = F.concat(F.lit("- ["), "title", F.lit(f"]({base}"), "url", F.lit(")"))
    return pages.withColumn("line", F.concat(link, F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise("")))


def plain_full(pages: DataFrame, base: str = "") -> DataFrame:
    """pages with full, as the second shell has it: title and address, a blank line, the body without white space around it."""
    return pages.withColumn("full", F.concat(F.lit("# "), "title", F.lit(f" ({base}"), "url", F.lit(")\n\n"), X.stripped(F.coalesce("body", F.lit("")))))


def caveat(status: Column) -> Column:
    """The status if it is one to warn of, else null."""
    return F.when(status.isNotNull() & (status != ASSUMED_STATUS), status)


def with_successor(pages: DataFrame) -> DataFrame:
    """pages (path, url, superseded_by) with successor_url: where the document is that replaces it, by its place in the tree."""
    pointer = F.split("superseded_by", "#", 2)
    relative = (F.instr("superseded_by", "://") == 0) & ~F.col("superseded_by").startswith("/") & F.get(pointer, F.lit(0)).endswith(".md")
    target = F.when(relative, X.resolved_from(F.col("path"), F.get(pointer, F.lit(0))))
    at = pages.select(F.col("path").alias("_path"), F.col("url").alias("_url"))
    rows = pages.withColumn("_target", target).withColumn("_anchor", F.when(F.size(pointer) > 1, F.concat(F.lit("#"), F.get(pointer, F.lit(1)))).otherwise(""))
    return rows.join(at, F.col("_target") == F.col("_path"), "left").withColumn("successor_url", F.concat("_url", "_anchor")).drop("_target", "_path", "_url", "_anchor")


def index_suffix(status: Column, successor: Column) -> Column:
    """What an index line says of a document that isn't approved."""
    replaced = F.when((status == "superseded") & successor.isNotNull(), F.concat(F.lit(", replaced by "), successor)).otherwise("")
    return F.when(caveat(status).isNull(), "").otherwise(F.concat(F.lit(" — "), F.upper(status), replaced))


def index_lines(pages: DataFrame) -> DataFrame:
    """pages (title, url, description, status, successor_url) with line."""
    link = F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(")"))
    said = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise("")
    return pages.withColumn("line", F.concat(link, said, index_suffix(F.col("status"), F.col("successor_url"))))


def joined(lines: DataFrame, group: str, order: str = "sort_key", line: str = "line", between: str = "\n") -> DataFrame:
    """One text of a group's lines in order: an index, which is as long as its group has pages."""
    return lines.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), between).alias("text"))


def governance_front(status: Column, owner: Column, effective: Column, superseded_by: Column, successor: Column, provenance: Column) -> Column:
    """A document's governance as front matter; nothing where it declares nothing."""
    line = lambda key, value: F.when(value.isNotNull(), F.concat(F.lit(f"{key}: "), X.yaml_scalar(value)))
    replaced = F.when(status == "superseded", F.coalesce(F.when(superseded_by.isNotNull(), successor), superseded_by))
    sources = F.when(F.size(provenance) > 0, F.concat(F.lit("provenance:\n"), F.array_join(F.transform(provenance, lambda p: F.concat(F.lit("  - "), X.yaml_scalar(p))), "\n")))
    lines = F.concat_ws("\n", line("status", status), line("owner", owner), line("effective", effective), line("superseded_by", replaced), sources)
    return F.when(lines == "", "").otherwise(F.concat(F.lit("---\n"), lines, F.lit("\n---")))


def full_text(pages: DataFrame) -> DataFrame:
    """pages with full: title and address, governance, body, a blank line between."""
    front = governance_front(*[F.col(c) for c in ("status", "owner", "effective", "superseded_by", "successor_url", "provenance")])
    head = F.concat(F.lit("# "), "title", F.lit(" ("), "url", F.lit(")"))
    body = F.regexp_replace("body", r"(?U)^\s+", "")
    return pages.withColumn("full", F.concat_ws("\n\n", head, F.nullif(front, F.lit("")), F.nullif(body, F.lit(""))))


def checked_governance(pages: DataFrame) -> DataFrame:
    """pages as they are; one that is superseded without a successor fails."""
    broken = (F.col("status") == "superseded") & F.col("superseded_by").isNull()
    return pages.withColumn("status", F.when(broken, F.raise_error(F.concat("path", F.lit(" is superseded and doesn't say by what")))).otherwise(F.col("status")))


def caveats(pages: DataFrame) -> DataFrame:
    """url and status of the documents that aren't approved."""
    return pages.select("url", caveat(F.nullif(X.stripped(F.col("status")), F.lit(""))).alias("status")).where("status is not null")


def documents_below(nodes: DataFrame) -> DataFrame:
    """node_id and the number of documents below it: sums that double their reach, of one row a node."""
    rows = labels._parents(nodes.select("node_id", "parent_id", (F.col("kind") == "document").cast("long").alias("documents"))).select("node_id", "up", "documents")
    add = ("documents", lambda step: F.sum("documents"), lambda own, found: own + F.coalesce(found, F.lit(0)))
    done = labels._rounds(rows, Scratch.of(nodes.sparkSession), lambda columns, step: {"documents": F.col("documents")}, [add])
    own = nodes.select("node_id", (F.col("kind") == "document").cast("long").alias("_own"))
    return done.join(own, "node_id").select("node_id", (F.col("documents") - F.col("_own")).alias("documents"))


def entries(nodes: DataFrame, parent: str | None = None) -> DataFrame:
    """Children of a node (or the roots) in order, sections with the number of documents below them."""
    below = documents_below(nodes)
    of = F.col("parent_id").isNull() if parent is None else F.col("parent_id") == parent
    number = F.row_number().over(Window.partitionBy("parent_id").orderBy(order_part(F.col("ord"), F.col("slug"))))
    rows = nodes.where(of).withColumn("position", number).join(below, "node_id", "left")
    return rows.select("node_id", "title", "kind", "position", F.when(F.col("kind") == "section", F.coalesce("documents", F.lit(0))).alias("documents"))


def predecessors(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Which documents each one replaces; a document that names itself replaces nothing."""
    named = docs.where(F.col("superseded_by").isNotNull() & (F.col("superseded_by") != F.col(key))).select(F.col("superseded_by").alias("_target"), F.col(key).alias("predecessor"))
    return named.join(docs.select(F.col(key).alias("_target")), "_target").withColumnRenamed("_target", key)


def staged(docs: DataFrame, ids: DataFrame, folders: DataFrame, tiers: list[str], default: str = "public") -> DataFrame:
    """Documents (stable_id, path, visibility) that a build for these tiers ships: visible and not denied."""
    from .governance import undenied

    return undenied(docs.where(visible(tiers, default)), ids, folders)


def staged_assets(shipped: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets (path) that shipped documents (path, body) refer to, seen from where they stand.

    What stands in code is no link. Links to headings, to the web, out of the tree and to other documents
    (.md and .mdx, which come by their own tier or not at all) are no assets.
    """
    targets = shipped.select("path", F.explode(X.link_targets(X.code_free(F.col("body")))).alias("target"))
    links = targets.where((F.col("target") != "") & ~F.col("target").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|/|#)"))
    links = links.withColumn("target", F.regexp_replace("target", "#.*$", "")).where(X.stays_inside(F.col("path"), F.col("target")))
    place = X.resolved_from(F.col("path"), F.col("target"))
    links = links.select(place.alias("path")).where(~F.col("path").rlike(r"(?i)\.mdx?$"))
    return assets.join(links.distinct(), "path", "left_semi")
