import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.config import EngineConfig
from corpusloom.functions.text import tokens
from corpusloom.operators import calibration as E
from corpusloom.operators import generations as V
from corpusloom.operators import quality as Q
from corpusloom.operators import search as S
from corpusloom.operators import tree as H


def test_config():
    c = EngineConfig(audiences=("public", "staff"))
    assert c.visible_tiers(None) == ["public"] and c.visible_tiers("staff") == ["public", "staff"]
    with pytest.raises(ValueError):
        c.visible_tiers("other")
    with pytest.raises(ValueError):
        EngineConfig(audiences=("staff",))


def test_cover_density(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", "x", "b", "y", "a"],), (["a"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(S.cover_density(F.col("w"), ["a", "b"])).collect()]
    assert got == pytest.approx([0.1, 0.1, 0.0, 0.0])


def test_websearch(spark):
    assert S.parse_websearch('big "red dog" -cat or fish') == [["big", '"red dog"', "-cat"], ["fish"]]
    df = spark.createDataFrame([(1, "a big red dog"), (2, "big dog red cat"), (3, "Fish!"), (4, ""), (5, None)], "id int, t string")
    assert [r[0] for r in df.where(S.matches(tokens(F.col("t")), 'big "red dog" -cat or fish')).orderBy("id").collect()] == [1, 3]


def test_two_forms_of_cosine(spark, small):
    from corpusloom.plans.derive import vector_chunks

    chunks = vector_chunks(spark, small)
    q = [float(x) for x in chunks.where("chunk_id = 3").first()["embedding"]]
    a = [(r["chunk_id"], round(r["sim"], 9)) for r in S.vector_arm(chunks, q, 7).orderBy("r").collect()]
    b = [(r["chunk_id"], round(r["sim"], 9)) for r in S.search_many(chunks, spark.createDataFrame([(0, q)], "qid long, vector array<double>"), 7).orderBy("r").collect()]
    assert a == b


def test_packing_skips_but_ships_the_first(spark):
    hits = spark.createDataFrame([("q", 1, 90, "a"), ("q", 2, 60, "b"), ("q", 3, 10, "c"), ("p", 1, 500, "d"), ("p", 2, 1, "e")], "qid string, r int, chars int, x string")
    assert sorted(r["x"] for r in S.packed(hits, 100).collect()) == ["a", "c", "d"]


def test_abstention(spark):
    df = spark.createDataFrame([(0.5,), (0.49,), (None,)], "s double")
    assert [r[0] for r in df.select(S.abstains(F.col("s"), 0.5)).collect()] == [False, True, True]
    with pytest.raises(ValueError):
        S.abstains(F.col("s"), "uncalibrated")


NODES = "node_id string, parent_id string, slug string, ord long, status string, visibility string"


def tree(spark):
    return spark.createDataFrame(
        [("a", None, "a", 1, "published", None), ("b", "a", "b", 2, "published", "internal"), ("c", "a", "c", 1, "published", ""), ("d", "b", "d", 1, "published", "public"), ("e", "a", "e", 3, "draft", None), ("f", "e", "f", 1, "published", None)], NODES
    )


def test_walks(spark):
    t = tree(spark)
    got = {r["node_id"]: r["path"] for r in H.walk_down(t, F.col("status") == "published").collect()}
    assert got == {"a": "a", "b": "a/b", "c": "a/c", "d": "a/b/d"}
    up = {(r["node_id"], r["ancestor_id"]): r["climbed"] for r in H.ancestors(t, t.where("node_id = 'd'")).collect()}
    assert up == {("d", "b"): 1, ("d", "a"): 2}


def test_denials_cascade(spark):
    t = tree(spark)
    deny = lambda *x: spark.createDataFrame(list(x), "stable_id string, scope string")
    assert {r[0] for r in H.denied(t, deny(("b", "subtree"))).collect()} == {"b", "d"}
    assert {r[0] for r in H.denied(t, deny(("b", "node"), ("zz", "subtree"))).collect()} == {"b"}
    assert H.denied(t, deny(("zz", "node"))).count() == 0


def test_outline_pages_make_the_whole(spark):
    t = tree(spark)
    none = spark.createDataFrame([], "node_id string")
    whole = [r["node_id"] for r in H.outline(t, none, ["public"], depth=9).orderBy("sort_key").collect()]
    assert whole == ["a", "c", "d"]  # d is judged on its own row, not its hidden parent's
    pages = [r["node_id"] for o in (0, 2) for r in H.outline(t, none, ["public"], depth=9, limit=2, offset=o).collect()]
    assert pages == whole
    assert H.outline(t, none, []).count() == 0


def test_shallowest(spark):
    df = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("c/d",), ("c/d/e",)], "dir string")
    assert {r[0] for r in H.shallowest(df).collect()} == {"a", "ab", "c/d"}


def test_carry_takes_one_and_is_null_safe(spark):
    cols = "source_id string, chunk_hash string, heading_path_text string, title string"
    new = spark.createDataFrame([("s", "h", None, "t"), ("s", "h", None, "t"), ("s", "x", "", "t")], cols)
    old = spark.createDataFrame([("s", "h", None, "t", [1.0], "m", 1, 0), ("s", "h", None, "t", [2.0], "m", 2, 1), ("s", "x", "", "t", [3.0], "other", 2, 0)], cols + ", embedding array<double>, embedding_model string, generation long, priority int")
    got = sorted((r["chunk_hash"], r["embedding"], r["carried_from"]) for r in V.carried(new, old, "m").collect())
    assert got == [("h", [1.0], 1), ("h", [1.0], 1), ("x", None, None)]


def test_collection_keeps_two_complete(spark):
    old, now = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    runs = [("t", g, s, old, old, p) for g, s, p in [(1, "retired", False), (2, "retired", False), (3, "abandoned", False), (4, "active", True), (5, "building", False)]] + [("t", 6, "building", now, now, False)]
    df = spark.createDataFrame(runs, "tenant string, generation long, state string, finished_at timestamp, heartbeat_at timestamp, pointed boolean")
    assert {r["generation"] for r in V.collectable(df, F.lit(now)).collect()} == {1, 5}


def test_paste_value():
    assert E.paste_value(0.6, 0.4) == (0.5, True)
    assert E.paste_value(0.5, 0.5) == (0.5, False)
    assert E.paste_value(0.5001, 0.5) == (0.5001, True)  # the rounded middle would not be above the gap's end
    assert E.paste_value(0.5, None) == (0.5, False)


def test_curve_against_counting(spark):
    pts = [(i % 7 / 10, i % 3 != 0) for i in range(50)]
    df = spark.createDataFrame(pts, "score double, in_corpus boolean")
    for r in E.curve(df, 4).collect():
        served = [p for p in pts if p[0] >= r["floor"]]
        good = sum(p[1] for p in served)
        assert r["served"] == len(served) and r["precision"] == pytest.approx(good / len(served)) and r["coverage"] == pytest.approx(len(served) / 50)
        assert r["false_abstention"] == pytest.approx(1 - good / sum(p[1] for p in pts))


def test_supersession(spark):
    df = spark.createDataFrame([("a", "b", 0), ("b", "a", 0), ("c", "d", 0), ("d", None, 1), ("e", "c", 0), ("s", "s", 0)], "doc_id string, superseded_by string, rank int")
    got = {(r["doc_id"], r["problem"]) for r in Q.supersession_problems(df).collect()}
    assert {("a", "cycle"), ("b", "cycle"), ("s", "cycle"), ("c", "less_visible"), ("e", "chain")} <= got
    assert ("d", "cycle") not in got and ("e", "cycle") not in got


def test_gates(spark):
    df = spark.createDataFrame([(0, 99, 1), (1, 99, 0), (0, 0, 0), (0, 50, 50)], "p long, e long, f long")
    assert [r[0] for r in df.select(F.coalesce(V.ready(F.col("p"), F.col("e"), F.col("f")), F.lit(False))).collect()] == [True, False, False, False]
    a = spark.createDataFrame([("x",)], "stable_id string")
    none = spark.createDataFrame([], "stable_id string")
    assert V.shrink(a, none).first()["refused"] is False and V.shrink(none, a).first()["refused"] is True


def test_centroids(spark):
    df = spark.createDataFrame([(1, 10, [1.0, 2.0]), (2, 10, [3.0, 4.0]), (3, 11, [5.0, 6.0])], "chunk_id long, node_id long, embedding array<double>")
    assert {r["node_id"]: (r["chunk_count"], r["centroid"]) for r in V.centroids(df).collect()} == {10: (2, [2.0, 3.0]), 11: (1, [5.0, 6.0])}
