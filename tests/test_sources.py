import datetime as dt
import json

import pytest

from corpusloom.sources import ledger as L
from corpusloom.sources import markdown as M
from corpusloom.streaming import ledger as stream


def test_tree(spark, tmp_path):
    files = {"guide/index.md": "---\ntitle: Guide\norder: 2\n---\nhello\n", "guide/b.md": "---\nsor_id: B1\n---\nb\n", "guide/deep/a.mdx": "a\n", "_hidden/x.md": "x\n", "notes.txt": "no", "top.md": "t\n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    docs = M.documents(M.read_tree(spark, str(tmp_path)))
    got = {r["path"]: r for r in docs.collect()}
    assert set(got) == {"guide/index.md", "guide/b.md", "guide/deep/a.mdx", "top.md"}
    assert got["guide/b.md"]["stable_id"] == "B1" and got["guide/b.md"]["source_id"] == "guide/b:prose"
    assert got["guide/index.md"]["title"] == "Guide" and got["guide/index.md"]["body"] == "hello\n"
    nodes = {r["stable_id"]: r for r in M.nodes(docs).collect()}
    assert nodes["guide/index"]["kind"] == "section" and nodes["B1"]["parent_id"] == "guide/index"
    assert nodes["guide/deep#section"]["parent_id"] == "guide/index" and nodes["guide/deep/a"]["parent_id"] == "guide/deep#section"
    assert nodes["top"]["parent_id"] is None
    assert M.index_conflicts(docs).count() == 0


def test_manifest(spark, tmp_path):
    good = {"format": 1, "corpus_id": "c", "source_commit": "abc", "nodes": [{"stable_id": "a", "slug": "a", "title": "A", "kind": "section", "position": 0}], "files": [{"path": "a.md", "node": "a"}]}
    (tmp_path / "m.json").write_text(json.dumps(good))
    m = M.read_manifest(spark, str(tmp_path / "m.json")).first()
    assert m["nodes"][0]["stable_id"] == "a"
    (tmp_path / "n.json").write_text(json.dumps(good | {"format": 2}))
    with pytest.raises(Exception):
        M.read_manifest(spark, str(tmp_path / "n.json")).collect()
    row = spark.createDataFrame([("a", "", None, 0)], "stable_id string, title string, parent string, position int")
    assert json.loads(M.manifest_json(row).first()["json"]) == {"stable_id": "a", "position": 0}


def test_manifests_that_are_refused(spark, tmp_path):
    node = {"stable_id": "a", "slug": "a", "title": "A", "kind": "section", "position": 0}
    good = {"format": 1, "corpus_id": "c", "source_commit": "abc", "nodes": [node], "files": [{"path": "a.md", "node": "a"}]}
    bad = [{"corpus_id": ""}, {"source_commit": None}, {"nodes": [node | {"title": ""}]}, {"nodes": [node | {"governance": {"visibility": ""}}]}, {"nodes": [node | {"governance": ["internal"]}]}, {"nodes": [node | {"position": "first"}]}, {"files": [{"path": "a.md"}]}, {"nodes": {}}]
    for i, change in enumerate(bad):
        (tmp_path / f"{i}.json").write_text(json.dumps(good | change))
        with pytest.raises(Exception):
            M.read_manifest(spark, str(tmp_path / f"{i}.json")).collect()
    other = good | {"nodes": [node, node, node | {"stable_id": "b", "parent": "z"}, node | {"stable_id": "c", "governance": {"visibility": "internal"}}], "files": [{"path": "a.md", "node": "y"}, {"path": "a.md", "node": "a"}]}
    (tmp_path / "m.json").write_text(json.dumps(other))
    m = M.read_manifest(spark, str(tmp_path / "m.json"))
    assert m.first()["nodes"][3]["governance"]["visibility"] == "internal"
    assert {tuple(r) for r in M.manifest_conflicts(m).collect()} == {("duplicate stable_id", "a"), ("unknown parent", "z"), ("unknown node", "y"), ("duplicate path", "a.md"), ("siblings of one slug", "a")}


def test_manifest_lines_and_what_is_left_out(spark, tmp_path):
    pages = {"a/index.md": "---\ntitle: A\nsidebar_position: 1\n---\nx\n", "a/b.md": "---\nvisibility: internal\nprovenance:\n  - p\nweight: 2\norder: 1\n---\nx\n", "c.md": "---\nweight: 3\n---\nx\n", "_h/x.md": "x\n"}
    for name, text in pages.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
    (tmp_path / "away").mkdir()
    (tmp_path / "away/secret.md").write_text("secret\n")
    (tmp_path / "t/linked").symlink_to(tmp_path / "away")
    (tmp_path / "t/one.md").symlink_to(tmp_path / "away/secret.md")
    root = str(tmp_path / "t")
    assert {r["path"] for r in M.links(spark, root).collect()} == {"linked", "one.md"}
    files = M.read_tree(spark, root)
    assert {r["path"] for r in files.collect()} == set(pages) - {"_h/x.md"}
    assert {(r["key"], r["documents"], *r["examples"]) for r in M.foreign_orders(files).collect()} == {("sidebar_position", 1, "a/index.md"), ("weight", 1, "c.md")}
    docs = M.documents(files)
    lines = [json.loads(r["json"]) for r in M.manifest_lines(docs, M.nodes(docs)).where("part = 'nodes'").collect()]
    assert {"stable_id": "a/b", "slug": "b", "title": "B", "kind": "document", "parent": "a/index", "position": 1, "governance": {"visibility": "internal", "provenance": ["p"]}} in lines
    assert {"stable_id": "c", "slug": "c", "title": "C", "kind": "document", "position": 2} in lines and len(lines) == 3
    whole = {"format": 1, "corpus_id": "k", "source_commit": "s", "nodes": lines, "files": [json.loads(r["json"]) for r in M.manifest_lines(docs, M.nodes(docs)).where("part = 'files'").collect()]}
    (tmp_path / "m.json").write_text(json.dumps(whole))
    assert M.manifest_conflicts(M.read_manifest(spark, str(tmp_path / "m.json"))).isEmpty()


def test_questions_and_denylist(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# note\n\n what   is it \nwhat is it\nwhy\n")
    assert sorted(r["q"] for r in M.questions(spark, str(tmp_path / "q.txt")).collect()) == ["what is it", "why"]
    (tmp_path / "none.txt").write_text("# note\n\n")
    with pytest.raises(ValueError, match="no question"):
        M.questions(spark, str(tmp_path / "none.txt"))
    deny = spark.createDataFrame([("b", "node"), ("a", "node"), ("c", "subtree")], "stable_id string, scope string")
    assert json.loads(M.denylist_manifest(deny, "k").first()["json"]) == {"format": 1, "corpus_id": "k", "denied": ["a", "b"], "denied_subtrees": ["c"]}


def test_chunk_sink(spark, tmp_path):
    rows = spark.createDataFrame([("t", 1, "x"), ("t", 2, "y")], "tenant_id string, generation int, content string")
    M.write_chunks(rows, str(tmp_path / "c"))
    assert (tmp_path / "c/tenant_id=t/generation=2").is_dir()


def test_ledger(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, t, "u", "search", None), (2, t, "u", "read", "{}"), (3, t, "u", "other", None)], "id bigint, created_at timestamp, actor string, action string, detail string")
    assert L.append(rows, str(tmp_path / "l")) and L.append(rows, str(tmp_path / "l"))
    assert L.read(spark, str(tmp_path / "l")).count() == 4
    assert [r["id"] for r in L.recent(rows, 2).collect()] == [3, 2]
    (tmp_path / "file").write_text("x")
    assert L.append(rows, str(tmp_path / "file")) is False


def test_stream(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i // 4), f"u{i % 2}", "read" if i % 3 else "search", None) for i in range(16)]
    spark.createDataFrame(rows, "id bigint, created_at timestamp, actor string, action string, detail string").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = stream.stream(spark, str(tmp_path / "in"), "id bigint, created_at timestamp, actor string, action string, detail string")
    q = stream.counts(events).writeStream.outputMode("complete").format("memory").queryName("counts_test").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM counts_test").first()[0] == 16
    q = stream.first_seen(stream.stream(spark, str(tmp_path / "in"), "id bigint, created_at timestamp, actor string, action string, detail string")).writeStream.format("memory").queryName("seen_test").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen_test").count() == 16
