import pytest
from pyspark.sql import functions as F

from corpusloom.config import EngineConfig
from corpusloom.durable import durable
from corpusloom.engine import Engine, Tables, Unknown, vocabulary
from corpusloom.functions import embedding as M
from corpusloom.operators import lifecycle as L

DIM = 16
TEXTS = {
    "guide": ("published", None, ["The zebra compensation rules are written down here for everybody.", "Paste this prompt into your agent and see what the zebra says about it."]),
    "pay": ("published", "internal", ["Zebra pay is decided by the internal board of the zebra house."]),
    "draft": ("draft", None, ["A draft on zebra compensation that nobody should find."]),
    "gone": ("published", None, ["A withdrawn page on zebra compensation rules."]),
    "short": ("published", None, ["zebra"]),
}


@pytest.fixture(scope="module")
def embed(spark):
    udf = M.fake_embedder(dim=DIM)
    return lambda text: spark.range(1).select(udf(F.lit(text)).alias("v")).select(M.normalized(F.col("v")).alias("v")).first()["v"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    nodes, sources, chunks = [("t", "c", 1, "root", None, "root", "root", "Root", "section", 0.0, "published", None, None)], [], []
    for k, (name, (status, tier, texts)) in enumerate(TEXTS.items()):
        nodes.append(("t", "c", 1, name, "root", f"id-{name}", name, name.title(), "document", float(k), status, tier, None))
        sources.append(("t", 1, f"{name}:prose", name, "prose", f"{name}.md"))
        chunks += [("t", 1, f"{name}-{i}", f"{name}:prose", i, text, f"part-{i}/deep", "prose", "embedded") for i, text in enumerate(texts)]
    n = spark.createDataFrame(nodes, "tenant_id string, corpus_id string, generation long, node_id string, parent_id string, stable_id string, slug string, title string, kind string, ord double, status string, visibility string, permalink string")
    s = spark.createDataFrame(sources, "tenant_id string, generation long, source_id string, node_id string, modality string, origin_path string")
    c = spark.createDataFrame(chunks, "tenant_id string, generation long, chunk_id string, source_id string, ordinal int, content string, heading_path_text string, source_type string, embedding_status string")
    c = c.withColumn("raw", M.fake_embedder(dim=DIM)("content")).withColumn("embedding", M.normalized(F.col("raw"))).drop("raw")
    deny = spark.createDataFrame([("t", "c", "id-gone", "node", "request")], "tenant_id string, corpus_id string, stable_id string, scope string, reason string")
    alias = spark.createDataFrame([("t", 1, "handbook", "guide")], "tenant_id string, generation long, alias_slug string, canonical_slug string")
    return Tables(spark.createDataFrame([("t", "c", 1, None)], L.POINTERS), n, s, c, deny, alias, str(tmp_path_factory.mktemp("ledger") / "log"))


def engine(spark, tables, embed, viewer=None, **kw):
    return Engine(spark, tables, EngineConfig(tenant=kw.pop("tenant", "t"), embedding_dim=DIM, **kw), embed, "c", viewer)


def test_search_returns_only_what_may_be_read(spark, tables, embed):
    one = engine(spark, tables, embed).search("zebra compensation")
    assert one.ok and {h["stable_id"] for h in one.hits} == {"id-guide"} and one.generation == 1
    assert any("instructions" in n for n in one.notes)
    assert one.hits == sorted(one.hits, key=lambda h: (-h["score"], h["chunk_id"]))
    inside = engine(spark, tables, embed, "internal").search("zebra compensation", k=99)
    assert {h["stable_id"] for h in inside.hits} == {"id-guide", "id-pay"} and any("50" in n for n in inside.notes)
    assert engine(spark, tables, embed).search("zebra", kinds=["section"]).reason == "abstained"


def test_outcomes(spark, tables, embed):
    def broken(_):
        raise OSError("no provider")

    assert engine(spark, tables, embed, vector_floor=0.99).search("quantum blockchain").reason == "abstained"
    assert engine(spark, tables, broken, vector_floor=0.1).search("zebra").reason == "unavailable"
    words = engine(spark, tables, broken).search("zebra compensation")
    assert words.ok and words.top_cosine is None
    assert engine(spark, tables, broken).search("nothing like it").reason == "unavailable"
    assert engine(spark, tables, embed, tenant="other").search("zebra").reason == "unpublished"
    for bad in (" ", "x" * 2001):
        with pytest.raises(ValueError):
            engine(spark, tables, embed).search(bad)
    with pytest.raises(ValueError):
        engine(spark, tables, embed, vector_floor="uncalibrated").read("guide")


def test_budget_leaves_out_what_does_not_fit(spark, tables, embed):
    answer = engine(spark, tables, embed, response_characters=70).search("zebra compensation")
    assert len(answer.hits) == 1 and answer.dropped == 1


def test_read(spark, tables, embed):
    e = engine(spark, tables, embed)
    whole = e.read("guide")
    assert whole.text == "".join(TEXTS["guide"][2]) and whole.next is None and whole.pin == "unpinned" and whole.advisory
    assert e.read("id-guide").text == e.read("root/guide").text == e.read("handbook").text == whole.text
    first = e.read("guide", tokens=17)
    assert first.text == TEXTS["guide"][2][0] and first.next == "part-1/deep" and first.remaining == ["part-1"]
    assert e.read("guide", cursor=first.next, tokens=17).text == TEXTS["guide"][2][1]
    assert e.read("guide", heading="part-1").text == TEXTS["guide"][2][1]
    assert e.read("guide", pinned=7).pin == "refreshed (withdrawn)" and e.read("guide", pinned=1).pin == "pinned"
    for name in ("gone", "draft", "pay", "nothing"):
        with pytest.raises(Unknown):
            e.read(name)
    with pytest.raises(Unknown, match="deep"):
        e.read("guide", heading="deep")
    assert engine(spark, tables, embed, "internal").read("pay").text
    assert vocabulary([f"s{i:02}" for i in range(25)]).endswith("and 5 more")


def test_outline_and_ledger(spark, tables, embed):
    e = engine(spark, tables, embed)
    rows, after = e.outline(depth=3, limit=2)
    assert [r["node_id"] for r in rows.orderBy("sort_key").collect()] == ["root", "guide"] and after == 2
    rest, end = e.outline(depth=3, limit=2, offset=2)
    assert [(r["node_id"], r["has_content"]) for r in rest.collect()] == [("short", True)] and end is None
    seen = {r["action"] for r in spark.read.parquet(tables.ledger).select("action").distinct().collect()}
    assert {"outline"} <= seen <= {"outline", "search", "read", "abstain"}


def test_life_of_a_generation(spark, tmp_path):
    now = F.lit("2024-05-01").cast("timestamp")
    pointers, runs = spark.createDataFrame([], L.POINTERS), spark.createDataFrame([], L.RUNS)
    for k in (1, 2):
        number, pointers, runs = L.allocated(pointers, runs, "t", "c", f"commit-{k}", now)
        assert number == k and L.same_commit(runs, "t", k, f"commit-{k}")
        pointers, runs = L.flipped(pointers, runs, "t", "c", k, now)
    assert L.pointer(pointers, "t", "c") == (2, 1) and L.servable(pointers, "t", "c") == [2, 1]
    assert {r["generation"]: r["state"] for r in runs.collect()} == {1: "retired", 2: "active"}
    with pytest.raises(L.Refused):
        L.flipped(pointers, runs, "t", "c", 2, now)
    back, pointers, runs = L.rolled_back(pointers, runs, "t", "c", now)
    assert back == 1 and {r["generation"]: r["state"] for r in runs.collect()} == {1: "active", 2: "retired"}
    spark.createDataFrame([("t", 1, 1), ("t", 2, 2)], "tenant_id string, generation long, x int").write.partitionBy("tenant_id", "generation").parquet(str(tmp_path / "chunks"))
    runs = L.reaped(spark, runs, "t", 2, [str(tmp_path / "chunks")])
    assert [r["x"] for r in spark.read.parquet(str(tmp_path / "chunks")).collect()] == [1]
    assert {r["generation"]: r["state"] for r in runs.collect()} == {1: "active", 2: "reaped"}
    going, _ = L.collected(spark, runs, pointers, now, [], dry=True)
    assert going == []


def test_cycles_and_unknown_parents_fail(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "node_id string, parent_id string, slug string, ord double")
    good = L.ordered_parents_first(rows(("b", "a", "b", 0.0), ("a", None, "a", 0.0)))
    assert {r["node_id"]: r["level"] for r in good.collect()} == {"a": 0, "b": 1}
    for bad in (rows(("a", "b", "a", 0.0), ("b", "a", "b", 0.0)), rows(("a", "zz", "a", 0.0))):
        with pytest.raises(Exception, match="unknown parent or cycle"):
            L.ordered_parents_first(bad).collect()


def test_one_bad_chunk_fails_alone(spark):
    good = M.fake_embedder(dim=4)
    rows = spark.createDataFrame([(1, "fine"), (2, "poison"), (3, "fine too")], "id int, input string")
    embed = lambda c: F.when(F.col("input") == "poison", F.array(*[F.lit(0.0)] * 4)).otherwise(good(c))
    got = {r["id"]: (r["embedding_status"], r["embedding"] is None) for r in M.drained(rows, embed, 4).collect()}
    assert got == {1: ("embedded", False), 2: ("failed", True), 3: ("embedded", False)}
    with pytest.raises(Exception, match="dimensions"):
        rows.withColumn("v", good(F.col("input"))).select(M.contracted(F.col("v"), 5)).collect()
    assert spark.range(1).select(M.literal(F.array(F.lit(0.5), F.lit(-1.0)))).first()[0] == "[0.50000000,-1.00000000]"


def test_denied_subtree_of_a_cycle_ends(spark):
    from corpusloom.operators import tree as H

    nodes = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("d", None)], "node_id string, parent_id string")
    deny = spark.createDataFrame([("a", "subtree")], "stable_id string, scope string")
    assert {r["node_id"] for r in H.denied(nodes, deny).collect()} == {"a", "b", "c"}


def test_calibration_run(spark):
    from corpusloom.operators import calibration as E

    udf = M.fake_embedder(dim=64)
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(("zebra compensation rules", "lion pay table", "quiet hours at night"))], "chunk_id long, content string").withColumn("embedding", udf("content"))
    chunks = durable(chunks)
    inside = spark.createDataFrame([("zebra compensation",), ("lion pay",), ("quiet hours",)], "q string")
    r = E.calibrated(chunks, inside, udf)
    assert r["inside"] == 3 and r["outside"] == 20 and len(r["weakest"]) == 3
    text = E.rendered(r)
    assert "weakest questions:" in text and ("uncalibrated" in text) is not r["separable"]
    base = spark.createDataFrame([("at1", 0.9, True), ("leaks", 0.0, False)], "metric string, value double, higher_is_better boolean")
    now = spark.createDataFrame([("at1", 0.8), ("leaks", 0.0)], "metric string, value double")
    assert {x["metric"]: x["worse"] for x in E.against_baseline(now, base).collect()} == {"at1": True, "leaks": False}
