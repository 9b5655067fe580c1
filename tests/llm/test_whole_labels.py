"""Toxicity is learned from all labels, not from a sample of them."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import toxicity
from corpusloom.llm.registry import QUERIES


def corpus(spark, n=900):
    rng = np.random.default_rng(5)
    words = np.array(["tree", "house", "river", "stone", "green", "walk", "seven", "paper"])
    # words that say something share no first letters, so each has to be seen
    rows = [(i, " ".join([*rng.choice(words, 12), hashlib.md5(b"%d" % (i % 30 + 30 * (i % 3 == 0))).hexdigest()[:8]]), ("en", "de", None)[i % 7 % 3], int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_bounds_of_a_sample_have_no_effect_on_the_query(spark, tmp_path, monkeypatch):
    rows = corpus(spark)
    rows.drop("toxic").write.parquet(f"{tmp_path}/documents.parquet")
    rows.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    for name, most in (("MOST_TOXIC", 8), ("MOST_CLEAN", 8), ("MOST_WORDS", 200)):
        monkeypatch.setattr(toxicity, name, most)
    got = QUERIES["op2_toxicity"](spark, str(tmp_path)).where("held_out").collect()
    right = [r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got]
    assert len(got) > 100 and sum(right) / len(right) > 0.95


def test_many_shards_learn_one_model_however_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    monkeypatch.setattr(toxicity, "RATE", 0.03)
    rows = corpus(spark)
    docs, labels = rows.drop("toxic"), rows.select("doc_id", "toxic")
    a = toxicity.learned(docs.coalesce(1), labels)
    b = toxicity.learned(docs.repartition(7, F.rand(3)), labels.repartition(3))
    assert (a.rows == b.rows).all() and a.shift == b.shift and all((x == y).all() for x, y in zip(a.filters, b.filters))
    assert a.thresholds == b.thresholds and a.threshold == b.threshold and "en" in a.thresholds
    flags = toxicity.scored(docs, a).join(labels, "doc_id").where(toxicity.held_out()).select((F.col("toxic_flag") == (F.col("toxic") == 1)).cast("int").alias("x")).agg(F.avg("x")).first()[0]
    assert flags > 0.95


def test_counts_are_of_every_text(spark):
    rows = corpus(spark, 300)
    words = toxicity.labelled_words(rows.drop("toxic"), rows.select("doc_id", "toxic"))
    want = np.zeros((2, 2 * toxicity.BUCKETS + 1))
    for r in rows.where(~toxicity.held_out()).collect():
        want[r["toxic"], np.unique(toxicity.word_ids(pa.array([r["text"]]))[0])] += 1
    assert (toxicity.counted(words) == want).all()


@pytest.mark.parametrize("seed", range(5))
def test_thresholds_of_counts_are_those_of_rows(seed):
    rng = np.random.default_rng(seed)
    scores, labels = rng.integers(0, 12, 80) / 11, rng.integers(0, 2, 80)
    own = np.unique(scores)
    bad, good = (np.array([np.sum((scores == s) & (labels == y)) for s in own]) for y in (1, 0))
    assert toxicity.best_cut(own, bad, good) == toxicity.best_threshold(scores, labels)


def test_held_out_labels_and_odd_rows(spark):
    rows = corpus(spark, 400)
    labels = rows.select("doc_id", "toxic")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    odd = spark.createDataFrame([(None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    more = spark.createDataFrame([(None, "x", "en"), (7, None, "en"), (7, "zzz", "en")], "doc_id long, text string, lang string")
    docs = rows.drop("toxic").where("doc_id <> 7")
    a = toxicity.learned(docs.unionByName(more), labels)
    b = toxicity.learned(docs.unionByName(more.where("text is null")), turned.unionByName(odd))
    assert (a.rows == b.rows).all() and a.thresholds == b.thresholds
    assert not toxicity.learned(docs, labels.where("toxic = 0")).trained and not toxicity.learned(docs, labels.limit(0)).trained
