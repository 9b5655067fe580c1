"""The commit log and generations built, served and dropped through it."""

import os
import sys
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusloom import files
from corpusloom.config import EngineConfig
from corpusloom.engine import Engine
from corpusloom.functions import embedding as M
from corpusloom.operators import build as B
from corpusloom.operators import index as I
from corpusloom.operators import lifecycle as L
from corpusloom.operators.catalog import Catalog, Change, Conflict
from corpusloom.operators.vectors import VectorStore
from corpusloom.sources import markdown

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks don't see the tests

DIM = 16
CONFIG = EngineConfig(tenant="t", embedding_dim=DIM, text_search_config="english")
TREE = {
    "index.md": "---\ntitle: Handbook\n---\nWelcome to the handbook of the zebra house, where all is written.\n",
    "pay/index.md": "---\ntitle: Pay\norder: 2\n---\nWhat is paid and when it is paid to everybody.\n",
    "pay/bonus.md": "---\ntitle: Bonus\nvisibility: internal\n---\n# Bonus\n\nA bonus is decided by the board in the first week of the year.\n\n## Zebras\n\nZebras are paid in grass, which grows on the meadow behind the house.\n",
    "leave.md": "---\ntitle: Leave\norder: 1\n---\n# Leave\n\nEverybody may leave the house for thirty days, walking or running.\n",
    "_hidden.md": "not a page",
}


def tree(spark, folder, pages):
    for path, text in pages.items():
        os.makedirs(os.path.dirname(f"{folder}/{path}") or folder, exist_ok=True)
        with open(f"{folder}/{path}", "w") as f:
            f.write(text)
    return markdown.read_tree(spark, folder)


def counted_embedder(spark, counter):
    udf = M.fake_embedder(dim=DIM)

    def embed(column):
        return F.when(counter(column).isNotNull(), udf(column))

    return embed


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    catalog = Catalog(spark, str(tmp_path_factory.mktemp("catalog")))
    number = B.allocate(catalog, "t", "c", "commit-1")
    files_ = tree(spark, str(tmp_path_factory.mktemp("tree")), TREE)
    B.build(catalog, files_, CONFIG, "c", number, M.fake_embedder(dim=DIM))
    B.flip(catalog, "t", "c", number)
    return catalog


def engine(spark, catalog, viewer=None, config=CONFIG):
    udf = M.fake_embedder(dim=DIM)
    embed = lambda text: spark.range(1).select(udf(F.lit(text)).alias("v")).select(M.normalized(F.col("v")).alias("v")).first()["v"]
    return Engine(spark, B.serving(catalog.snapshot(), config.tenant, "c"), config, embed, "c", viewer)


def test_a_tree_of_files_is_served(spark, served):
    one = engine(spark, served, "internal").search("a zebra runs")
    assert one.ok and {h["slug"] for h in one.hits} >= {"leave", "bonus"} and one.generation == 1
    assert "bonus" not in {h["slug"] for h in engine(spark, served).search("zebra bonus").hits}
    rows, more = engine(spark, served, "internal").outline(depth=3)
    assert [r["path"] for r in rows.collect()] == ["leave", "pay", "pay/bonus"] and more is None
    text = engine(spark, served).read("leave").text
    assert "thirty days" in text
    with pytest.raises(I.Mismatch):
        engine(spark, served, config=EngineConfig(tenant="t", embedding_dim=DIM)).search("zebra")


def test_every_act_has_its_row(spark, served):
    assert [r["action"] for r in served.history().collect()][:3] == ["allocate", "build", "flip"]
    assert '"generation":1' in served.history().where("action = 'build'").first()["detail"].replace(" ", "")


def test_an_emptied_denylist_is_empty(spark, served):
    deny = spark.createDataFrame([("leave", "node", "request")], "stable_id string, scope string, reason string")
    ids = {r["slug"]: r["stable_id"] for r in served.snapshot().table("nodes").collect()}
    deny = deny.withColumn("stable_id", F.lit(ids["leave"]))
    now = B.take_down(served, "t", "c", deny, "officer")
    assert now.table("denylist").count() == 1
    assert "leave" not in {r["slug"] for r in engine(spark, served).outline(depth=3)[0].collect()}
    now = B.revoke(served, "t", "c", deny.select("stable_id"), "officer")
    assert now.table("denylist").count() == 0 and served.snapshot().table("denylist").count() == 0
    assert "leave" in {r["slug"] for r in engine(spark, served).outline(depth=3)[0].collect()}
    assert [r["actor"] for r in served.history().where("action in ('takedown', 'revoke')").collect()] == ["officer", "officer"]


def test_second_generation_carries_vectors_and_embeds_the_rest(spark, served, tmp_path):
    number = B.allocate(served, "t", "c", "commit-2")
    assert number == 2
    pages = TREE | {"leave.md": TREE["leave.md"].replace("thirty", "forty")}
    asked = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def count(_):
        asked.add(1)
        return True

    before = served.snapshot()
    after = B.build(served, tree(spark, str(tmp_path), pages), CONFIG, "c", number, counted_embedder(spark, count))
    key = B.part("t", "c", 2)
    chunks = after.table("chunks", key)
    assert chunks.where("carried_from = 1").count() == chunks.count() - 1 and asked.value == 1
    # a reader of the version before sees nothing of it, one of this version all four tables
    assert key not in before.parts("nodes") and all(key in after.parts(t) for t in B.OF_GENERATION)
    assert after.table("runs").where("generation = 2").first()["state"] == "ready"
    assert engine(spark, served).search("thirty days").generation == 1
    B.flip(served, "t", "c", 2)
    assert engine(spark, served).search("forty days").generation == 2
    with pytest.raises(L.Refused):
        B.flip(served, "t", "c", 2)
    with pytest.raises(L.Refused):
        B.reap(served, "t", "c", 1)
    assert B.roll_back(served, "t", "c") == 1


class Counted:
    """Counts the texts that it embeds; one of them can't be."""

    def __init__(self, seen):
        self.seen = seen

    def embed(self, texts):
        if any("poison" in t for t in texts):
            raise ValueError("unreadable")
        self.seen.add(len(texts))
        return [[float(len(t))] + [1.0] * (DIM - 1) for t in texts]

    def retryable(self, error):
        return False


def test_a_store_finds_texts_that_moved(spark, tmp_path):
    catalog, seen = Catalog(spark, str(tmp_path / "catalog")), spark.sparkContext.accumulator(0)
    store = VectorStore(spark, str(tmp_path / "store"), "t", "c", CONFIG.embedding_model, DIM)
    pages = TREE | {"bad.md": "a poison that no provider takes, whoever asks for it\n"}
    make = lambda name, pages, **more: B.build(catalog, tree(spark, str(tmp_path / name), pages), CONFIG, "c", B.allocate(catalog, "t", "c"), Counted(seen), **more)
    chunks = lambda now, g: now.table("chunks", B.part("t", "c", g))
    now = make("one", pages, store=store)
    total = chunks(now, 1).count()
    assert seen.value == total - 1 and {r["embed_error"] for r in chunks(now, 1).where("embedding_status = 'failed'").collect()} == {"unreadable"}
    # under another path nothing is carried, as a document's place is part of that key; the store has the texts
    moved = {k.replace("pay/", "money/"): v for k, v in TREE.items()}
    now = make("two", moved, store=store)
    assert seen.value == total - 1 and chunks(now, 2).where("carried_from = 1").count() == chunks(now, 2).count() == total - 1
    # what only abandoned runs made is embedded again
    states = now.table("runs").withColumn("state", F.lit("abandoned"))
    catalog.commit("abandon", lambda now: Change.of(runs=states))
    now = make("three", TREE, store=store)
    assert seen.value == 2 * (total - 1) and chunks(now, 3).where("carried_from is not null").count() == 0
    with pytest.raises(L.Refused, match="declares"):
        make("four", TREE, store=VectorStore(spark, str(tmp_path / "store"), "t", "c", "other", DIM))


def test_what_may_not_be_built(spark, served, tmp_path):
    number = B.allocate(served, "t", "d")
    version = served.latest()
    for name, pages, why in (
        ("empty", {"readme.txt": "x"}, "no document"),
        ("two", {"a/index.md": "one", "a/README.md": "two", "b.md": "x"}, "more than one index"),
        ("ids", {"a.md": "---\nsor_id: same\n---\nx", "b.md": "---\nsor_id: same\n---\ny"}, "more than once"),
        ("tier", {"a.md": "---\nvisibility: [x\n---\nx", "b.md": "y"}, "governance"),
    ):
        with pytest.raises(L.Refused, match=why):
            B.build(served, tree(spark, str(tmp_path / name), pages), CONFIG, "d", number)
    with pytest.raises(L.Refused, match="never allocated"):
        B.build(served, tree(spark, str(tmp_path / "fine"), {"a.md": "some words that are enough"}), CONFIG, "d", 99)
    assert served.latest() == version
    now = B.build(served, tree(spark, str(tmp_path / "pending"), {"a.md": "some words that are enough to be found"}), CONFIG, "d", number)
    assert now.table("runs").where("corpus_id = 'd'").first()["state"] == "building"
    with pytest.raises(L.Refused, match="not ready"):
        B.flip(served, "t", "d", number)


def test_two_flips_at_once(spark, tmp_path):
    """Both judge the same snapshot; one commits, the other is judged anew and refused."""
    catalog = Catalog(spark, str(tmp_path / "c"))
    one = catalog.commit("start", lambda now: Change.of(pointers=spark.createDataFrame([(0,)], "active long")))
    gate, results = threading.Barrier(2), []

    def act(first):
        def judge(now):
            active = now.table("pointers").first()["active"]
            if first:
                first.pop()
                gate.wait(60)  # the other has read the same
            if active >= 1:
                raise L.Refused("served already")
            return Change.of(pointers=spark.createDataFrame([(1,)], "active long"))

        try:
            results.append(catalog.commit("flip", judge).version)
        except L.Refused as e:
            results.append(str(e))

    threads = [threading.Thread(target=act, args=([True],)) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, results)) == [str(one.version + 1), "served already"]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.commit("start", lambda now: Change.of(rows=spark.createDataFrame([], "x long")))

    def add(x):
        catalog.commit("add", lambda now: Change.of(rows=now.table("rows").unionByName(spark.createDataFrame([(x,)], "x long"))))

    threads = [threading.Thread(target=add, args=(x,)) for x in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r["x"] for r in catalog.snapshot().table("rows").collect()) == [0, 1, 2, 3]
    assert catalog.latest() == 5


def test_a_failed_act_changes_nothing(spark, tmp_path, monkeypatch):
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.commit("start", lambda now: Change.of(a=spark.range(2), b=spark.range(3)))
    bad = spark.range(5).withColumn("id", F.raise_error(F.lit("boom")).cast("long"))
    with pytest.raises(Exception, match="boom"):
        catalog.commit("half", lambda now: Change.of(a=spark.range(9), b=bad))
    assert catalog.latest() == 1 and catalog.snapshot().table("a").count() == 2
    with pytest.raises(ValueError, match="other columns"):
        catalog.commit("x", lambda now: Change({("a", "p"): spark.createDataFrame([("s",)], "id string")}))
    assert len(catalog.swept(dry=True)) >= 1
    catalog.swept()
    assert catalog.swept(dry=True) == [] and catalog.snapshot().table("b").count() == 3
    monkeypatch.setattr(files, "create", lambda *a: False)
    with pytest.raises(Conflict):
        catalog.commit("late", lambda now: Change.of(a=spark.range(1)))


def test_create_is_once(spark, tmp_path):
    path = f"{tmp_path}/log/1.json"
    assert files.create(spark, path, "one") and not files.create(spark, path, "two")
    assert files.read_text(spark, path) == "one" and files.names(spark, f"{tmp_path}/log") == ["1.json"]
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(files.create(spark, f"{tmp_path}/log/2.json", f"writer {k}"))) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(won) == 1 and files.read_text(spark, f"{tmp_path}/log/2.json").startswith("writer")
