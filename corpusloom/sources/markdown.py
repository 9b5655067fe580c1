"""A tree of Markdown files as nodes and documents, and the JSON manifest that says the same."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.frontmatter import governance_of, meta_of
from ..operators import quality
from ..operators.labels import order_part

INDEX_NAMES = ("index.md", "index.mdx", "README.md")
#: Keys by which other generators order pages. They are reported, not read.
FOREIGN_ORDERS = ("sidebar_position", "position", "weight", "nav_order")
_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
_list = lambda name: T.StructField(name, T.ArrayType(T.StringType()))
GOVERNANCE = T.StructType([*_text("visibility", "doc_status", "owner"), _list("provenance"), *_text("superseded_by")])
NODE = T.StructType([*_text("stable_id", "slug", "title", "kind", "parent"), T.StructField("position", T.IntegerType()), *_text("summary"), _list("keywords"), *_text("permalink"), T.StructField("governance", GOVERNANCE)])
FILE = T.StructType(_text("path", "node", "title"))
MANIFEST = T.StructType([T.StructField("format", T.IntegerType()), *_text("corpus_id", "source_commit"), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("files", T.ArrayType(FILE))])


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files under the root, at any depth: path (from the root), content, and link, the symbolic link on the way to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,mdx}").load(root)
    inside = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + _quoted(root) + "/*", "")
    local = F.col("path").startswith("file:")
    link = F.when(local, _first_link(F.regexp_replace("path", "^file:/*", "/"), inside))
    name = F.element_at(F.split(inside, "/"), -1)
    return files.select(inside.alias("path"), "content", link.alias("link")).where(X.is_document(name))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (from the root) and text of every Markdown file under the root, at any depth. Symbolic links of a local tree aren't followed."""
    return _listed(spark, root).where("link is null").select("path", F.decode("content", "UTF-8").alias("text"))


def links(spark: SparkSession, root: str) -> DataFrame:
    """path of every symbolic link of a local tree on whose account read_tree leaves Markdown out. Of hidden files Spark's reader says nothing."""
    return _listed(spark, root).where("link is not null").select(F.col("link").alias("path")).distinct()


@F.pandas_udf(T.StringType())
def _first_link(path: pd.Series, inside: pd.Series) -> pd.Series:
    """The first part of the way below the root that is a link, seen from the root; null without one."""

    def first(whole: str, below: str) -> str | None:
        root, at = whole[: len(whole) - len(below)], ""
        for part in below.split("/"):
            at = f"{at}/{part}" if at else part
            if os.path.islink(root + at):
                return at
        return None

    return pd.Series([first(p, i) for p, i in zip(path, inside)], dtype=object)


def _quoted(root: str) -> str:
    import re

    plain = re.sub("^[a-z]+:/*", "/", root).rstrip("/")
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", plain)


def hidden(path: Column) -> Column:
    """Whether any part of the path begins with . or _."""
    return path.rlike("(?:^|/)[._]")


def documents(files: DataFrame) -> DataFrame:
    """Files as nodes with frontmatter: path, folder, is_index, stable_id, title, order, body, content_hash, governance.

    Hidden files are left out; hidden() tells which. An index file is its folder's own content.
    """
    rows = files.where(~hidden(F.col("path"))).withColumn("meta", meta_of("text")).withColumn("governance", governance_of("text"))
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", "/?[^/]+$", "")
    stem = X.tie_key(name)
    index = name.isin(*INDEX_NAMES)
    own = F.when(index, F.element_at(F.split(folder, "/"), -1)).otherwise(stem)
    return rows.select(
        "path",
        folder.alias("folder"),
        index.alias("is_index"),
        X.node_slug(own).alias("slug"),
        X.stable_id(F.col("path"), F.col("meta")["sor_id"]).alias("stable_id"),
        X.title_of(F.col("meta")["title"], own).alias("title"),
        X.order_value(F.coalesce(F.when(F.col("meta")["order"]["kind"] != "bool", F.col("meta")["order"]["value"]), F.lit(""))).alias("order"),
        X.tie_key(name).alias("tie"),
        X.body(F.col("text")).alias("body"),
        X.content_hash(X.body(F.col("text"))).alias("content_hash"),
        X.source_id(F.col("path")).alias("source_id"),
        "governance",
    )


def nodes(docs: DataFrame) -> DataFrame:
    """Sections (one for each folder) and documents as a tree: stable_id, parent_id, slug, title, kind, ord, name."""
    parts = F.split("folder", "/")
    ups = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    folders = docs.select(F.explode(ups).alias("f")).distinct()
    index = docs.where("is_index").select(F.col("folder").alias("f"), F.struct("stable_id", "title", "order").alias("i"))
    named = folders.join(index, "f", "left")
    sid = F.coalesce("i.stable_id", F.concat("f", F.lit("#section")))
    last = F.element_at(F.split("f", "/"), -1)
    sections = named.select("f", sid.alias("stable_id"), F.regexp_replace("f", "/?[^/]+$", "").alias("up"), X.node_slug(last).alias("slug"), F.coalesce("i.title", X.humanized(last)).alias("title"), F.coalesce("i.order", F.expr("double('Infinity')")).alias("ord"), last.alias("name"))
    parent = sections.select(F.col("f").alias("_f"), F.col("stable_id").alias("parent_id"))
    s = sections.join(parent, F.col("up") == F.col("_f"), "left").select("stable_id", "parent_id", "slug", "title", F.lit("section").alias("kind"), "ord", "name")
    d = docs.where("not is_index").join(parent, F.col("folder") == F.col("_f"), "left").select("stable_id", "parent_id", "slug", "title", F.lit("document").alias("kind"), F.col("order").alias("ord"), F.col("tie").alias("name"))
    return s.unionByName(d)


def index_conflicts(docs: DataFrame) -> DataFrame:
    """Folders with more than one index file."""
    return docs.where("is_index").groupBy("folder").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def foreign_orders(files: DataFrame) -> DataFrame:
    """Keys of other generators that documents declare instead of an order: key, documents, and the first three of them.

    Such documents stand by their names, which their authors didn't mean.
    """
    meta = files.where(~hidden(F.col("path"))).select("path", meta_of("text").alias("meta"))
    has = lambda key: F.coalesce(F.try_element_at("meta", F.lit(key))["kind"] != "null", F.lit(False))
    keys = F.filter(F.array(*[F.when(has(k), F.lit(k)) for k in FOREIGN_ORDERS]), lambda k: k.isNotNull())
    rows = meta.where(~has("order")).select("path", F.explode(keys).alias("key"))
    number = F.row_number().over(Window.partitionBy("key").orderBy("path"))
    shown = rows.withColumn("_n", number).where("_n <= 3").groupBy("key").agg(F.array_sort(F.collect_list("path")).alias("examples"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("documents")).join(shown, "key")


def _said(value: Column, what: str) -> Column:
    """Why a text that must be there isn't."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(f"{what} must be a text that isn't empty"))


def manifest_problem(m: Column) -> Column:
    """The first thing that a manifest's own values break, else null; what they name is for manifest_conflicts."""
    nodes, files = F.coalesce(m["nodes"], F.array().cast(MANIFEST["nodes"].dataType)), F.coalesce(m["files"], F.array().cast(MANIFEST["files"].dataType))
    of = lambda rows, check: F.get(F.filter(F.transform(rows, check), lambda p: p.isNotNull()), F.lit(0))
    empty = lambda g, key: F.when(g[key] == "", F.lit(f"governance.{key} must be a text that isn't empty"))
    return F.coalesce(
        F.when(F.coalesce(m["format"] != 1, F.lit(True)), F.lit("only format 1 is read")),
        _said(m["corpus_id"], "corpus_id"),
        _said(m["source_commit"], "source_commit"),
        of(nodes, lambda n: F.coalesce(*[_said(n[k], k) for k in ("stable_id", "slug", "title", "kind")], *[empty(n["governance"], k) for k in ("visibility", "doc_status", "owner", "superseded_by")])),
        of(files, lambda f: F.coalesce(*[_said(f[k], k) for k in ("path", "node")])),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest file of format 1: corpus_id, source_commit, nodes with their governance, files. Anything else fails.

    A value of the wrong type fails too: read as none, a governance would show a document to everybody.
    """
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", MANIFEST, {"mode": "FAILFAST"}).alias("m"))
    problem = manifest_problem(F.col("m"))
    checked = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("manifest: "), problem)).cast("int")).otherwise(F.col("m.format"))
    return raw.select(checked.alias("format"), "m.corpus_id", "m.source_commit", "m.nodes", "m.files")


def manifest_conflicts(manifest: DataFrame) -> DataFrame:
    """problem and about: ids and paths that stand twice, parents and nodes that aren't there, siblings of one slug."""
    nodes = manifest.select(F.explode("nodes").alias("n")).select("n.*")
    files = manifest.select(F.explode("files").alias("f")).select("f.*")
    rows = [
        quality.duplicates(nodes, "stable_id").select(F.lit("duplicate stable_id").alias("problem"), F.col("stable_id").alias("about")),
        quality.unknown(nodes, "parent", "stable_id").select(F.lit("unknown parent").alias("problem"), F.col("parent").alias("about")),
        quality.unknown(files, "node", "stable_id", nodes).select(F.lit("unknown node").alias("problem"), F.col("node").alias("about")),
        quality.duplicates(files, "path").select(F.lit("duplicate path").alias("problem"), F.col("path").alias("about")),
        quality.duplicates(nodes, "parent", "slug").select(F.lit("siblings of one slug").alias("problem"), F.col("slug").alias("about")),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def manifest_lines(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """part (nodes or files) and json: the entries of a corpus's manifest, one a row, nodes with position and governance.

    What is null, empty or no list is left out, but for the position, so that a governance that isn't
    declared changes no digest, and one that is does.
    """
    number = F.row_number().over(Window.partitionBy("parent_id").orderBy(order_part(F.col("ord"), F.col("name"))))
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    own = docs.select("stable_id", "governance")
    rows = nodes.withColumn("position", number.cast("int")).join(own, "stable_id", "left")
    g = lambda key: F.nullif(F.col(f"governance.{key}"), F.lit("")).alias(key)
    governance = F.struct(g("visibility"), g("doc_status"), g("owner"), F.when(F.size("governance.provenance") > 0, F.col("governance.provenance")).alias("provenance"), g("superseded_by"))
    governance = F.when(F.to_json(governance) != "{}", governance)
    entry = F.struct(*[text(c).alias(c) for c in ("stable_id", "slug", "title", "kind")], text("parent_id").alias("parent"), "position", governance.alias("governance"))
    files = docs.select(F.lit("files").alias("part"), F.to_json(F.struct("path", F.col("stable_id").alias("node"))).alias("json"))
    return rows.select(F.lit("nodes").alias("part"), F.to_json(entry, {"ignoreNullFields": "true"}).alias("json")).unionByName(files)


def manifest_json(rows: DataFrame) -> DataFrame:
    """Each row as canonical JSON: columns by name, without nulls and empty text; position always."""
    columns = [F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" and c != "position" else F.col(c) for c, t in sorted(rows.dtypes)]
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "true"}).alias("json"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a text file, one a line; blank lines and those that begin with # don't count. A file without any is refused."""
    rows = spark.read.text(path).select(X.normalized_query(F.col("value")).alias("q")).where((F.col("q") != "") & ~F.col("q").startswith("#")).dropDuplicates(["q"])
    if rows.isEmpty():
        raise ValueError(f"{path} holds no question: one a line, blank lines and those that begin with # don't count")
    return rows


def denylist_manifest(denylist: DataFrame, corpus: str) -> DataFrame:
    """The denylist as one JSON document. A denylist is written by hand and short."""
    ids = lambda scope: F.array_sort(F.collect_set(F.when(F.col("scope") == scope, F.col("stable_id"))))
    return denylist.agg(ids("node").alias("denied"), ids("subtree").alias("denied_subtrees")).select(F.to_json(F.struct(F.lit(1).alias("format"), F.lit(corpus).alias("corpus_id"), "denied", "denied_subtrees")).alias("json"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks by tenant and generation, so that a generation is a folder: written, served and dropped as one; written again, replaced."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id", "generation").parquet(path)
