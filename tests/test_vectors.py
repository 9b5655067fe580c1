"""Vectors by the digest of their input: only misses go to the provider."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusloom.functions import providers as P
from corpusloom.operators import vectors as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks don't see the tests


class Letters:
    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[float(len(t)) + 1, 1.0] for t in texts]

    def retryable(self, error):
        return False


def counting(spark):
    """An embedder that counts the inputs it is given."""
    calls = spark.sparkContext.accumulator(0)

    def embed(rows):
        n = rows.count()
        calls.add(n)
        return P.drained(rows, Letters(), 2)

    return embed, calls


@pytest.fixture
def store(spark, tmp_path):
    return S.VectorStore(spark, str(tmp_path), "t", "c", "m", 2)


def table(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, input string")


def got(df):
    return {r["id"]: r for r in df.collect()}


def test_only_misses_are_embedded_and_each_once(spark, store):
    embed, calls = counting(spark)
    first = got(store.embedded(table(spark, "a", "b", "a", None, ""), embed, 1))
    assert calls.value == 3 and all(r["embedding_status"] == "embedded" and r["carried_from"] is None for r in first.values())
    assert first[0]["embedding"] == first[2]["embedding"] and first[3]["embedding"] == first[4]["embedding"]
    again = got(store.embedded(table(spark, "c", "b", "a"), embed, 2))
    assert calls.value == 4
    assert [again[i]["carried_from"] for i in range(3)] == [None, 1, 1]
    assert again[1]["embedding"] == first[1]["embedding"]


def test_failures_are_not_stored(spark, store):
    embed, calls = counting(spark)
    for n in (1, 2):
        rows = got(store.embedded(table(spark, "fine", "bad"), embed, n))
        assert rows[0]["embedding_status"] == "embedded" and rows[1]["embedding_status"] == "failed" and rows[1]["embed_error"]
    assert calls.value == 3  # two, then the one that failed


def test_other_corpora_models_intents_and_barred_runs_are_no_source(spark, store, tmp_path):
    embed, calls = counting(spark)
    store.embedded(table(spark, "a"), embed, 1)
    others = [("t", "d", "m", 2, "document"), ("u", "c", "m", 2, "document"), ("t", "c", "n", 2, "document"), ("t", "c", "m", 2, "query")]
    for i, other in enumerate(others):
        S.VectorStore(spark, str(tmp_path), *other).embedded(table(spark, "a"), embed, 1)
        assert calls.value == 2 + i
    rows = got(store.embedded(table(spark, "a"), embed, 3, without=[1]))
    assert rows[0]["carried_from"] is None and calls.value == 6
    rows = got(store.embedded(table(spark, "a"), embed, 4, without=[1]))
    assert rows[0]["carried_from"] == 3 and calls.value == 6


def test_lists_and_joins_find_the_same(spark, store, monkeypatch):
    texts = [f"text {i}" for i in range(300)]
    embed, _ = counting(spark)
    store.embedded(table(spark, *texts), embed, 1)
    asked = table(spark, *[f"text {i}" for i in range(200, 400)]).select(store.digest(F.col("input")).alias("digest"))
    listed = sorted(map(tuple, store.known(asked).select("digest", "generation").collect()))
    few = store.known(asked.limit(3))
    assert "PartitionFilters: [" in few._jdf.queryExecution().toString() and "bucket" in few._jdf.queryExecution().toString()
    monkeypatch.setattr(S, "MOST_LISTED", 10)
    joined = sorted(map(tuple, store.known(asked).select("digest", "generation").collect()))
    assert listed == joined and len(listed) == 100


def test_stored_twice_is_found_once(spark, store):
    embed, _ = counting(spark)
    store.embedded(table(spark, "a"), embed, 5)
    store.add(store.rows().withColumn("generation", F.lit(2)))
    assert [r["generation"] for r in store.known(store.rows()).collect()] == [2]


def test_an_empty_table_and_columns_of_the_same_names(spark, store):
    embed, calls = counting(spark)
    assert store.embedded(table(spark), embed, 1).count() == 0 and calls.value == 0
    rows = table(spark, "a").withColumn("embedding", F.lit("old")).withColumn("digest", F.lit("mine"))
    one = store.embedded(rows, embed, 1).first()
    assert one["digest"] == "mine" and one["embedding"] != "old"


def test_questions_are_normalised_and_empty_ones_refused(spark, tmp_path):
    queries = S.VectorStore(spark, str(tmp_path), "t", "c", "m", 2, "query")
    embed, calls = counting(spark)
    ask = lambda *texts: table(spark, *texts).withColumnRenamed("input", "q")
    rows = queries.asked(ask("who  is it ", "who is it", "why"), embed).collect()
    assert calls.value == 2 and len({tuple(r["vector"]) for r in rows if r["q"].startswith("who")}) == 1
    queries.asked(ask(" why"), embed)
    assert calls.value == 2
    with pytest.raises(S.EmptyQuery):
        queries.asked(ask("why", " \t"), embed)
    with pytest.raises(ValueError):
        S.VectorStore(spark, str(tmp_path), "t", "c", "m", 2).asked(ask("why"), embed)


def test_a_space_is_dropped_alone(spark, store, tmp_path):
    embed, _ = counting(spark)
    other = S.VectorStore(spark, str(tmp_path), "t", "c", "n", 2)
    for s in (store, other):
        s.embedded(table(spark, "a"), embed, 1)
    store.dropped()
    assert store.rows().count() == 0 and other.rows().count() == 1
