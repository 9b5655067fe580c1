"""Tree and governance queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EngineConfig
from ..functions.text import order_value, tie_key
from ..operators import governance as G
from ..operators import tree as H
from .derive import DENYLIST_SQL, NODES_SQL, denylist, table, tree_nodes
from .stored import tree_labels

VISIBLE = "coalesce(nullif(visibility, ''), 'public') IN ('public', 'internal')"
TIERS = ["public", "internal"]

WALK_SQL = f"""{NODES_SQL}, walk AS (
  SELECT *, slug AS path, 0 AS depth, [{{'ord': ord, 'name': slug}}] AS sort_key FROM nodes WHERE parent_id IS NULL AND status = 'published'
  UNION ALL SELECT n.*, w.path || '/' || n.slug, w.depth + 1, list_append(w.sort_key, {{'ord': n.ord, 'name': n.slug}}) FROM walk w JOIN nodes n ON n.parent_id = w.node_id WHERE n.status = 'published')"""
DENIED_SQL = f"""{DENYLIST_SQL}, deny AS (
  SELECT n.node_id, d.scope = 'subtree' AS cascade FROM nodes n JOIN denylist d ON d.stable_id = n.node_id
  UNION SELECT n.node_id, true FROM deny x JOIN nodes n ON n.parent_id = x.node_id WHERE x.cascade)"""


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.walk_down(tree_nodes(spark, sf_dir), F.col("status") == "published").select("node_id", "path", "depth")


TREE_PATHS = f"WITH RECURSIVE {WALK_SQL} SELECT node_id, path, depth FROM walk"


def tree_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.ancestors(tree_nodes(spark, sf_dir))


TREE_ANCESTORS = f"""WITH RECURSIVE {NODES_SQL}, up AS (SELECT node_id, parent_id AS ancestor_id, 1 AS climbed FROM nodes WHERE parent_id IS NOT NULL
  UNION ALL SELECT u.node_id, n.parent_id, u.climbed + 1 FROM up u JOIN nodes n ON n.node_id = u.ancestor_id WHERE n.parent_id IS NOT NULL) SELECT * FROM up"""


def _crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under their nations by segment, so that many share a slug."""
    c = table(spark, sf_dir, "customer")
    slug = F.concat(F.lower("c_mktsegment"), F.lit("-"), (F.col("c_custkey") % 50).cast("string"))
    path = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/k"), (F.col("c_custkey") % 7).cast("string"), F.lit("/"), slug)
    return c.select(F.col("c_custkey").alias("node_id"), slug.alias("slug"), path.alias("path")).groupBy("path", "slug").agg(F.min("node_id").alias("node_id"))


CROWDED_SQL = """paths AS (SELECT path, slug, min(c_custkey) AS node_id FROM (SELECT c_custkey, lower(c_mktsegment) || '-' || (c_custkey % 50) AS slug,
  'n' || c_nationkey || '/k' || (c_custkey % 7) || '/' || lower(c_mktsegment) || '-' || (c_custkey % 50) AS path FROM customer) GROUP BY ALL)"""


def resolve_by_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf slug and every two-segment end as an address."""
    paths = _crowded(spark, sf_dir)
    parts = F.split("path", "/")
    ends = paths.select(F.explode(F.array(F.col("slug"), F.concat(F.element_at(parts, -2), F.lit("/"), F.col("slug")), F.lit("no/such"))).alias("address")).distinct()
    return H.resolve(ends, paths)


RESOLVE = f"""WITH {CROWDED_SQL}, asked AS (SELECT DISTINCT unnest([slug, split_part(path, '/', 2) || '/' || slug, 'no/such']) AS address FROM paths),
hits AS (SELECT a.address, p.node_id FROM asked a JOIN paths p ON p.path = a.address OR ends_with(p.path, '/' || a.address))
SELECT address, count(node_id) AS candidates, CASE WHEN count(node_id) = 1 THEN min(node_id) END AS node_id FROM asked LEFT JOIN hits USING (address) GROUP BY address"""


def resolve_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.shortest_unique(_crowded(spark, sf_dir))


AMBIGUOUS = f"""WITH {CROWDED_SQL}, ends AS (SELECT node_id, path, 2 AS k, split_part(path, '/', 2) || '/' || slug AS address FROM paths UNION ALL SELECT node_id, path, 3, path FROM paths),
alone AS (SELECT address, min(node_id) AS node_id, min(k) AS k FROM ends GROUP BY address HAVING count(*) = 1)
SELECT p.node_id, coalesce(arg_min(a.address, a.k), p.path) AS address FROM paths p LEFT JOIN alone a USING (node_id) GROUP BY p.node_id, p.path"""


def alias_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old names of customers: every fifth has one."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    aliases = c.where(key % 5 == 0).select(F.concat(F.lit("old-"), key.cast("string")).alias("alias"), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("canonical"))
    addresses = c.select(F.concat(F.lit("docs/old-"), key.cast("string")).alias("address"))
    return H.flattened(addresses, aliases)


ALIAS = """WITH a AS (SELECT 'old-' || c_custkey AS alias, lower(replace(c_name, '#', '-')) AS canonical FROM customer WHERE c_custkey % 5 = 0), q AS (SELECT 'docs/old-' || c_custkey AS address, 'old-' || c_custkey AS last FROM customer)
SELECT address, CASE WHEN canonical IS NULL THEN address ELSE 'docs/' || canonical END AS canonical_address FROM q LEFT JOIN a ON a.alias = q.last"""


def _outline(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    nodes = tree_labels(spark, sf_dir, True)
    rows = H.outline(nodes, H.denied(nodes, denylist(spark)), TIERS, **kw)
    return rows.select("node_id", "path", "depth", "position", "child_count")


_SEEN = f"""{WALK_SQL}, {DENIED_SQL}, seen AS (SELECT * FROM walk WHERE {VISIBLE} AND node_id NOT IN (SELECT node_id FROM deny)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY sort_key) AS position FROM seen),
kids AS (SELECT parent_id, count(*) AS n FROM seen GROUP BY parent_id),
rows_ AS (SELECT r.node_id, r.path, r.depth, r.position, coalesce(k.n, 0) AS child_count, r.sort_key FROM ranked r LEFT JOIN kids k ON k.parent_id = r.node_id)"""


def outline_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outline(spark, sf_dir, depth=2)


OUTLINE = f"WITH RECURSIVE {_SEEN} SELECT node_id, path, depth, position, child_count FROM rows_ WHERE depth < 2"


def outline_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outline(spark, sf_dir, anchor="r:1", depth=2)


DRILLDOWN = f"WITH RECURSIVE {_SEEN} SELECT node_id, path, depth, position, child_count FROM rows_ WHERE starts_with(path, (SELECT path FROM walk WHERE node_id = 'r:1') || '/') AND depth <= 2"


def outline_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 21 to 40 and one more, which says that there are more."""
    return _outline(spark, sf_dir, depth=3, limit=21, offset=20)


PAGE = f"WITH RECURSIVE {_SEEN} SELECT node_id, path, depth, position, child_count FROM rows_ WHERE depth < 3 ORDER BY sort_key LIMIT 21 OFFSET 20"


def visible_sibling_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outline(spark, sf_dir, depth=5).select("node_id", "position")


SIBLINGS = f"WITH RECURSIVE {_SEEN} SELECT node_id, position FROM rows_"


def denied_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are denied by themselves."""
    return H.denied(tree_nodes(spark, sf_dir), denylist(spark).where("scope = 'node'")).select("node_id")


DENIED_NODE = f"WITH {NODES_SQL}, {DENYLIST_SQL} SELECT node_id FROM nodes JOIN denylist ON stable_id = node_id WHERE scope = 'node'"


def denied_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.denied(tree_labels(spark, sf_dir, False), denylist(spark)).select("node_id")


DENIED_SUBTREE = f"WITH RECURSIVE {NODES_SQL}, {DENIED_SQL} SELECT DISTINCT node_id FROM deny"


def denied_ids_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Denied nodes and all listed ids, even those that nothing has."""
    return G.all_denied(H.denied(tree_nodes(spark, sf_dir), denylist(spark)), denylist(spark))


DENIED_IDS = f"WITH RECURSIVE {NODES_SQL}, {DENIED_SQL} SELECT node_id AS stable_id FROM deny UNION SELECT stable_id FROM denylist"


def orphaned_denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.orphaned(denylist(spark), tree_nodes(spark, sf_dir).withColumn("stable_id", F.col("node_id")))


ORPHANS = f"WITH {NODES_SQL}, {DENYLIST_SQL} SELECT stable_id FROM denylist WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE node_id = stable_id)"


def audience_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes each viewer may read."""
    config, nodes = EngineConfig(), tree_nodes(spark, sf_dir)
    counts = [F.count_if(H.visible(config.visible_tiers(v), config.default_visibility)).alias(v) for v in config.audiences]
    one = nodes.agg(*counts, F.count_if(H.visible(None, "public")).alias("nobody"))
    return one.unpivot([], [*config.audiences, "nobody"], "viewer", "readable")


_V = "coalesce(nullif(visibility, ''), 'public')"
AUDIENCE = f"""WITH {NODES_SQL} SELECT 'public' AS viewer, count(*) FILTER ({_V} = 'public') AS readable FROM nodes UNION ALL SELECT 'internal', count(*) FILTER ({_V} IN ('public', 'internal')) FROM nodes
UNION ALL SELECT 'restricted', count(*) FILTER ({_V} IN ('public', 'internal', 'restricted')) FROM nodes UNION ALL SELECT 'nobody', 0 FROM (SELECT 1)"""


def pinned_read_live_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an old generation that may be read as the live one's rows say: stable ids in both, live tier visible."""
    from .derive import generation, tier

    old = generation(spark, sf_dir, 1).select("stable_id", F.col("title").alias("pinned_title"))
    live = generation(spark, sf_dir, 2).select("stable_id", tier(F.col("position")).alias("visibility"))
    return G.live_rows(old, live, H.visible(TIERS, "public")).select("stable_id", "pinned_title")


def _pinned_sql() -> str:
    from .derive import TIER_SQL, generation_sql

    return f"WITH {generation_sql(1)}, {generation_sql(2)}, live AS (SELECT stable_id, {TIER_SQL.format('position')} AS visibility FROM gen2) SELECT g.stable_id, g.title AS pinned_title FROM gen1 g JOIN live USING (stable_id) WHERE {VISIBLE.replace('visibility', 'live.visibility')}"


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each nation in reading order: declared order first (numbers or their text, else last), then file name."""
    s = table(spark, sf_dir, "supplier")
    raw = F.when(F.col("s_suppkey") % 3 == 0, (F.col("s_suppkey") % 10).cast("string")).when(F.col("s_suppkey") % 3 == 1, F.lit("soon"))
    rows = s.select("s_nationkey", "s_suppkey", order_value(F.coalesce(raw, F.lit(""))).alias("o"), tie_key(F.concat("s_name", F.lit(".md"))).alias("name"))
    number = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("o", "name"))
    return rows.select("s_nationkey", "s_suppkey", number.cast("long").alias("position"))


READING_ORDER = "SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 10)::DOUBLE ELSE 'Infinity'::DOUBLE END, s_name) AS position FROM supplier"


QUERIES = {f.__name__: f for f in (tree_paths, tree_ancestors, resolve_by_leaf, resolve_ambiguous, alias_flatten, outline_browse, outline_drilldown, outline_page, visible_sibling_rank, denied_node, denied_subtree, denied_ids_export, orphaned_denials, audience_matrix, pinned_read_live_governance, reading_order)}
ORACLE_SQL = {
    "tree_paths": TREE_PATHS,
    "tree_ancestors": TREE_ANCESTORS,
    "resolve_by_leaf": RESOLVE,
    "resolve_ambiguous": AMBIGUOUS,
    "alias_flatten": ALIAS,
    "outline_browse": OUTLINE,
    "outline_drilldown": DRILLDOWN,
    "outline_page": PAGE,
    "visible_sibling_rank": SIBLINGS,
    "denied_node": DENIED_NODE,
    "denied_subtree": DENIED_SUBTREE,
    "denied_ids_export": DENIED_IDS,
    "orphaned_denials": ORPHANS,
    "audience_matrix": AUDIENCE,
    "pinned_read_live_governance": _pinned_sql(),
    "reading_order": READING_ORDER,
}
