"""Interval labels, denials, outlines and rings against walking step by step, on deep and odd graphs."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.durable import Scratch
from corpusloom.operators import labels as L
from corpusloom.operators import lifecycle, projections
from corpusloom.operators import quality as Q
from corpusloom.operators import tree as H

SCHEMA = "node_id string, parent_id string, slug string, ord double, status string, visibility string, kind string"


def forest(n, seed, deep=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parent = None if i == 0 or rng.random() < 0.05 else f"n{rng.randrange(max(0, i - 3) if deep else 0, i)}"
        rows.append((f"n{i}", parent, f"s{rng.randrange(5)}-{i}", float(rng.randrange(3)), "draft" if rng.random() < 0.1 else "published", None, "document" if rng.random() < 0.5 else "section"))
    return rows


def walked(rows, only=lambda r: True):
    """pre, last, depth and path of reached nodes, by recursion without recursion."""
    kids = {}
    for r in rows:
        if only(r):
            kids.setdefault(r[1], []).append(r)
    out, n = {}, 0
    stack = [(r, 0, r[2]) for r in sorted(kids.get(None, []), key=lambda r: (r[3], r[2], r[0]), reverse=True)]
    order = []
    while stack:
        r, depth, path = stack.pop()
        n += 1
        order.append(r[0])
        out[r[0]] = [n, n, depth, path]
        stack += [(k, depth + 1, f"{path}/{k[2]}") for k in sorted(kids.get(r[0], []), key=lambda r: (r[3], r[2], r[0]), reverse=True)]
    parent = {r[0]: r[1] for r in rows}
    for node in reversed(order):
        if parent[node] in out:
            out[parent[node]][1] = max(out[parent[node]][1], out[node][1])
    return out


@pytest.mark.parametrize("seed, deep", [(1, False), (2, True)])
def test_labels_are_a_walk_in_reading_order(spark, seed, deep):
    rows = forest(200, seed, deep) + [("lost", "nobody", "x", 0.0, "published", None, "document"), ("c1", "c2", "x", 0.0, "published", None, "section"), ("c2", "c1", "y", 0.0, "published", None, "section"), ("c3", "c2", "z", 0.0, "published", None, "document")]
    nodes = spark.createDataFrame(rows, SCHEMA)
    with Scratch(spark) as scratch:
        for only, keep in ((None, lambda r: True), (F.col("status") == "published", lambda r: r[4] == "published")):
            got = {r["node_id"]: (r["pre"], r["last"], r["depth"]) for r in L.labelled(nodes, scratch, only).collect()}
            assert got == {k: tuple(v[:3]) for k, v in walked(rows, keep).items()}
    want = walked(rows, lambda r: r[4] == "published")
    assert {r["node_id"]: r["path"] for r in H.walk_down(nodes, F.col("status") == "published").collect()} == {k: v[3] for k, v in want.items()}
    below = {r["node_id"]: r["documents"] for r in projections.documents_below(nodes.where("not node_id like 'c%'")).collect()}
    whole = walked(rows)
    docs = [whole[r[0]][0] for r in rows if r[6] == "document" and r[0] in whole]
    assert all(below[k] == sum(v[0] < d <= v[1] for d in docs) for k, v in whole.items())


def test_a_chain_of_ten_thousand(spark):
    n = 10_000
    rows = spark.range(n).select(F.concat(F.lit("n"), "id").alias("node_id"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("parent_id"), F.lit("s").alias("slug"), F.lit(0.0).alias("ord"))
    with Scratch(spark) as scratch:
        got = L.labelled(rows, scratch).select(F.count_if((F.col("depth") == F.col("pre") - 1) & (F.col("last") == n) & (F.col("height") == n - F.col("pre"))).alias("right"), F.count(F.lit(1)).alias("n")).first()
    assert tuple(got) == (n, n)
    # a legal tree of more than 100 levels walks, denies and lists too
    some = rows.where(F.substring("node_id", 2, 9).cast("int") < 130).withColumn("status", F.lit("published")).withColumn("visibility", F.lit(None).cast("string"))
    deny = spark.createDataFrame([("n120", "subtree")], "stable_id string, scope string")
    assert H.denied(some, deny).count() == 10
    assert H.walk_down(some).agg(F.max("depth")).first()[0] == 129
    assert H.ancestors(some, some.where("node_id = 'n129'")).agg(F.max("climbed"), F.count(F.lit(1))).first() == (129, 129)
    shown = H.outline(some, H.denied(some, deny), ["public"], anchor="n100", depth=50).orderBy("sort_key").collect()
    assert [r["node_id"] for r in shown] == [f"n{i}" for i in range(101, 120)] and shown[-1]["path"].count("/") == 119 and shown[-1]["child_count"] == 0
    assert H.climbed(some, ["n129", "nobody"]) == {"n129": "/".join(["s"] * 130)}


def test_denials_by_label_are_those_by_walking(spark, monkeypatch):
    rows = forest(150, 7)
    nodes = spark.createDataFrame(rows, SCHEMA)
    deny = spark.createDataFrame([(f"n{i}", "subtree" if i % 2 else "node") for i in range(3, 150, 13)] + [("zz", "subtree")], "stable_id string, scope string")
    want = {r["node_id"] for r in H.denied(nodes, deny).collect()}
    with Scratch(spark) as scratch:
        labelled = scratch.keep(L.labelled(nodes, scratch))
        assert {r["node_id"] for r in H.denied(labelled, deny).collect()} == want
        monkeypatch.setattr(L, "MOST_RANGES", 2)
        assert {r["node_id"] for r in H.denied(labelled, deny).collect()} == want


def test_many_ranges_as_dyadic_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_RANGES", 0)
    rng = random.Random(3)
    ranges = [(a, a + rng.choice([0, 1, 2, 7, 31, 100])) for a in (rng.randrange(1, 900) for _ in range(15))] + [(1, 1), (1000, 1000)]
    rows = spark.range(1, 1001).select(F.col("id").alias("pre"))
    with Scratch(spark) as scratch:
        got = {r["pre"] for r in L.within(rows, spark.createDataFrame(ranges, "first long, last long"), scratch).collect()}
        assert got == {x for a, b in ranges for x in range(a, min(b, 1000) + 1)}
        none = spark.createDataFrame([], "first long, last long")
        assert L.within(rows, none, scratch).count() == 0


def test_repeated_nodes_and_cycles_are_refused(spark):
    twice = spark.createDataFrame([("a", None, "a"), ("b", "a", "b"), ("a", None, "a")], "node_id string, parent_id string, slug string")
    with Scratch(spark) as scratch, pytest.raises(Exception, match="more than once"):
        L.reached(twice, scratch).collect()
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "node_id string, parent_id string")
    with pytest.raises(ValueError, match="its own ancestor"):
        H.ancestors(ring)
    for f in (lifecycle.ordered_leaves_first, lifecycle.ordered_parents_first):
        with pytest.raises(Exception, match="cycle at"):
            f(ring).collect()


def test_scratch_tables_go(spark):
    import os

    with Scratch(spark) as scratch:
        path = scratch.keep(spark.range(3))._scratch_path.removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.exists(path)


@pytest.mark.parametrize("n", [1, 2, 60, 5000])
def test_rings_of_any_length_are_named(spark, n):
    """A ring, a tail that leads into it, and a chain that ends."""
    links = [(i, (i + 1) % n) for i in range(n)] + [(10_000 + i, 10_001 + i) for i in range(70)] + [(20_000, 20_001), (20_001, 0)]
    df = spark.createDataFrame(links, "doc_id long, superseded_by long")
    got = {r["doc_id"]: r["ring"] for r in Q.rings(df, "doc_id", "superseded_by").collect()}
    assert got == {i: 0 for i in range(n)}


def test_two_rings_and_none(spark):
    df = spark.createDataFrame([(5, 7), (7, 6), (6, 5), (3, 3), (1, 5), (2, None)], "doc_id long, superseded_by long")
    assert {r["doc_id"]: r["ring"] for r in Q.rings(df, "doc_id", "superseded_by").collect()} == {5: 5, 6: 5, 7: 5, 3: 3}
    assert Q.rings(df.where("doc_id < 3 and superseded_by is null"), "doc_id", "superseded_by").count() == 0


def test_rebased_rows_are_children_seen_from_the_root(spark):
    rows = spark.createDataFrame([("b", 0), ("b/x", 1), ("b/x/y", 2)], "path string, depth int")
    assert [tuple(r) for r in H.rebased(rows, "a/b", 1).collect()] == [("a/b/x", 2), ("a/b/x/y", 3)]


def test_nodes_are_not_sent_through_the_driver(spark, monkeypatch):
    """No join of labels, denials or outlines is a broadcast, which grows with the nodes and takes them along the driver."""
    plans, keep = [], Scratch.keep

    def noted(self, df, **counted):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, **counted)

    monkeypatch.setattr(Scratch, "keep", noted)
    nodes = spark.createDataFrame(forest(200, 4), SCHEMA)
    deny = spark.createDataFrame([("n9", "subtree"), ("n11", "node")], "stable_id string, scope string")
    with Scratch(spark) as scratch:
        labelled = scratch.keep(L.labelled(nodes, scratch, F.col("status") == "published"))
        for shown in (H.outline(labelled, H.denied(labelled, deny), ["public"], anchor="n1", depth=2), H.outline(labelled, H.denied(nodes, deny), ["public"], depth=9)):
            plans.append(shown._jdf.queryExecution().executedPlan().toString())
            assert shown.count()
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]
