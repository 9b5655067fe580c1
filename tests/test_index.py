"""Stored lexemes against cutting the texts, and the English configuration."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import lexemes as X
from corpusloom.operators import index as I
from corpusloom.operators import search as S

TEXTS = ["the cat of the house and the cats", "of the", "the of", "", None, "cat cat dog of the cat", "Dog; DOG-cat", "the quick brown fox", "is the cat of the dog", "naïve 漢字 cat", "cat " * 300 + "of the"]
QUERIES = ["cat", "the of", '"of the"', '"of the" -is or dog', '"the cat of" or naïve', "cat dog -fox", "漢字", "nosuch", "-cat", "-cat or fox", '"cat dog of"', '"cat cat"', "", "or", '"" !!']


def chunks(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, content string").repartition(3)


@pytest.fixture(scope="module")
def simple(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "simple")
    I.write(I.postings(chunks(spark), "simple"), folder, "simple", buckets=8)
    return folder


@pytest.mark.parametrize("query", QUERIES)
def test_index_finds_and_ranks_what_cutting_finds(spark, simple, query):
    rows = chunks(spark).where("content is not null")
    want = {r["chunk_id"]: r["rank"] for r in S.keyword_hits(rows, query).collect()}
    got = {r["chunk_id"]: r["rank"] for r in I.Index(spark, simple, "simple").hits(query, rows.select("chunk_id")).collect()}
    assert got == want
    some = rows.where("chunk_id % 2 = 0")
    arm = I.Index(spark, simple, "simple").arm(query, some.select("chunk_id"), 3)
    assert sorted(map(tuple, arm.collect())) == sorted(map(tuple, S.keyword_arm(some, query, 3).collect()))


def test_only_the_terms_buckets_are_opened(spark, simple):
    index = I.Index(spark, simple, "simple")
    everything = {os.path.basename(os.path.dirname(f)) for f in spark.read.parquet(simple).inputFiles()}
    opened = {os.path.basename(os.path.dirname(f)) for f in index.rows(["cat", "fox"]).inputFiles()}
    assert len(everything) > 4 and len(opened) <= 2 and opened < everything
    read = {os.path.basename(os.path.dirname(r[0])) for r in index.rows(["cat", "fox"]).select(F.input_file_name()).collect()}
    assert read <= opened
    assert index.rows(["nosuchword"]).count() == 0


def test_another_configuration_than_declared_is_refused(spark, simple):
    with pytest.raises(I.Mismatch, match="simple"):
        I.Index(spark, simple, "english")
    with pytest.raises(ValueError, match="klingon"):
        I.postings(chunks(spark), "klingon")


def test_a_folder_without_its_last_file_is_no_index(spark, tmp_path):
    folder = str(tmp_path / "half")
    I.write(I.postings(chunks(spark), "simple"), folder, "simple")
    os.remove(f"{folder}/_index.json")
    with pytest.raises(Exception):
        I.Index(spark, folder, "simple")
    with pytest.raises(Exception, match="exist"):
        I.write(I.postings(chunks(spark), "simple"), folder, "simple")


def test_english_stems_drops_and_keeps_places(spark, tmp_path):
    texts = [(1, "The kings of France were running"), (2, "king France"), (3, "a king in the runs"), (4, "the of and")]
    folder = str(tmp_path / "english")
    I.write(I.postings(spark.createDataFrame(texts, "chunk_id long, content string"), "english"), folder, "english")
    index = I.Index(spark, folder, "english")
    found = lambda q: {r["chunk_id"] for r in index.hits(q).collect()}
    assert found("king") == found("kings") == {1, 2, 3}
    assert found('"king of france"') == {1} and found('"king france"') == {2}
    assert found("run -france") == {3} and found("the of") == set() and found("king -the") == {1, 2, 3}
    assert {r["term"] for r in index.rows(["the", "of", "king"]).collect()} == {"king"}


def test_stems():
    """Known pairs of the published vocabulary, one or more for each step."""
    pairs = {
        "consign": "consign", "consigned": "consign", "consigning": "consign", "consistency": "consist", "consolations": "consol", "knightly": "knight", "knocked": "knock", "knots": "knot",
        "caresses": "caress", "flies": "fli", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "this": "this", "agreed": "agre", "feed": "feed", "luxuriated": "luxuri",
        "hopping": "hop", "hoped": "hope", "hoping": "hope", "fizzed": "fizz", "cry": "cri", "by": "by", "say": "say", "enjoy": "enjoy", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam",
        "sensibility": "sensibl", "apology": "apolog", "hopefulness": "hope", "goodness": "good", "electrical": "electr", "formative": "format", "adoption": "adopt", "replacement": "replac", "rate": "rate",
        "controlling": "control", "generate": "generat", "general": "general", "generously": "generous", "communism": "communism", "arsenal": "arsenal", "skies": "sky", "dying": "die", "news": "news", "innings": "inning",
        "proceeds": "proceed", "yes": "yes", "youth": "youth", "boyish": "boyish", "national": "nation", "nationally": "nation", "happily": "happili", "easily": "easili", "triplicate": "triplic", "roll": "roll", "probate": "probat", "cease": "ceas",
    }
    assert {w: X.stem(w) for w in pairs} == pairs
    assert len(X.STOP_WORDS) == 127 and X.lexeme("the", "english") is None and X.lexeme("the", "simple") == "the"
