"""Comparing by digests against exceptAll."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import digests as D
from corpusloom.operators.generations import difference

COLUMNS = ("stable_id", "title", "tags")
SCHEMA = "stable_id string, title string, tags array<string>"


def rows(n=400):
    rng = random.Random(2)
    return [(f"doc-{i}", rng.choice([None, "", f"title {i}"]), rng.choice([None, [], ["a"], ["a", None]])) for i in range(n)] + [("doc-3", "again", None)] * 3


def tree(spark, folder, data):
    D.write(spark.createDataFrame(data, SCHEMA).repartition(3), str(folder), COLUMNS)
    return D.Tree(spark, str(folder))


def test_like_generations_open_no_row(spark, tmp_path):
    data = rows()
    a, b = tree(spark, tmp_path / "a", data), tree(spark, tmp_path / "b", list(reversed(data)))
    found, opened = D.compared(a, b)
    assert opened == [] and found.count() == 0
    assert sum(n for n, _, _ in a.nodes(8, None).values()) == a.nodes(0, None)[0][0] == len(data)


def test_unlike_ones_open_the_differing_leaves(spark, tmp_path):
    data = rows()
    other = [r for r in data if r[0] != "doc-7"] + [("new", "x", None)]
    other[10] = (other[10][0], "edited", other[10][2])
    other.remove(("doc-3", "again", None))  # a copy less
    k = next(i for i, r in enumerate(other) if r[1] is None and r[0] not in ("doc-3", other[10][0]))
    other[k] = (other[k][0], "", other[k][2])  # null is not the empty text
    a, b = tree(spark, tmp_path / "a", data), tree(spark, tmp_path / "b", other)
    found, opened = D.compared(a, b)
    want = difference(spark.createDataFrame(data, SCHEMA), spark.createDataFrame(other, SCHEMA), COLUMNS)
    key = lambda df: sorted((r["stable_id"], r["title"] is None, r["title"] or "", str(r["tags"]), r["side"]) for r in df.collect())
    assert key(found) == key(want) and len(key(found)) == 7
    assert 1 <= len(opened) <= 5
    leaves = {r[0] for r in found.select(F.shiftrightunsigned(F.xxhash64("stable_id"), 56)).collect()}
    assert leaves == set(opened)
    assert {f.split("leaf=")[1].split("/")[0] for f in a.rows(opened).inputFiles()} <= {str(x) for x in opened}


def test_empty_and_other_trees(spark, tmp_path):
    a, none = tree(spark, tmp_path / "a", rows(5)), tree(spark, tmp_path / "none", [])
    found, _ = D.compared(a, none)
    assert found.count() == 8 and found.where("side = 'only_new'").count() == 8
    assert D.compared(none, none)[1] == []
    D.write(spark.createDataFrame(rows(5), SCHEMA), str(tmp_path / "two"), COLUMNS[:2])
    with pytest.raises(ValueError, match="other columns"):
        D.differing(a, D.Tree(spark, str(tmp_path / "two")))
