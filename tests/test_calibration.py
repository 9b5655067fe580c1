"""The calibration door that writes its own questions, and what retrieval is measured by."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusloom.durable import durable
from corpusloom.functions import embedding as M
from corpusloom.functions import providers as P
from corpusloom.functions import questions as W
from corpusloom.functions import text as X
from corpusloom.operators import calibration as E

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks don't see the tests

LONG = " ".join(f"word{i}" for i in range(60))


class Fussy:
    """Replies by what the passage holds."""

    def generate(self, prompt, most_tokens):
        assert prompt.startswith(W.PROMPT) and most_tokens == 64
        passage = prompt.removeprefix(W.PROMPT)
        if "refused" in passage:
            raise ValueError("no")
        return {"blank": " \n\n", "lines": "\n  What is  it?\nIt is this."}.get(passage, str(len(passage)))

    def retryable(self, error):
        return False


class Tired:
    """Fails twice, then answers."""

    def __init__(self):
        self.calls = 0

    def generate(self, prompt, most_tokens):
        self.calls += 1
        if self.calls < 3:
            raise TimeoutError
        return "Why?"

    def retryable(self, error):
        return isinstance(error, TimeoutError)


def chunks(spark):
    rows = [
        (1, "a", f"zebra pay {LONG}", "embedded", "prose", "published"),
        (2, "a", f"zebra leave {LONG}", "embedded", "prose", "published"),
        (3, "a", f"zebra third {LONG}", "embedded", "prose", "published"),
        (4, "b", f"lion {LONG}", "pending", "prose", "published"),
        (5, "b", f"links {LONG}", "embedded", "nav", "published"),
        (6, "b", f"draft {LONG}", "embedded", "prose", "draft"),
        (7, "b", "short", "embedded", "prose", "published"),
        (8, "c", f"secret {LONG}", "embedded", "prose", "published"),
        (9, "d", f"open {LONG}", "embedded", "prose", "published"),
    ]
    return spark.createDataFrame(rows, "chunk_id long, node_id string, content string, embedding_status string, source_type string, status string")


def test_passages_keep_every_rule(spark):
    denied = spark.createDataFrame([("c",), ("c",)], "node_id string")
    got = E.passages(chunks(spark), denied).collect()
    assert {r["node_id"] for r in got} == {"a", "d"} and sum(r["node_id"] == "a" for r in got) == 2
    assert "c" in {r["node_id"] for r in E.passages(chunks(spark), None).collect()}
    for column in ("embedding_status", "source_type", "status"):
        with pytest.raises(ValueError, match=column):
            E.passages(chunks(spark).drop(column), denied)


def test_a_question_is_the_first_line_that_says_something(spark):
    rows = spark.createDataFrame([("lines",), ("blank",), ("😀" * 2000,), (None,)], "content string")
    asked, skipped = E.synthesized(rows, Fussy())
    assert sorted(r["q"] for r in asked.collect()) == ["0", "1500", "What is it?"] and skipped == 1
    with pytest.raises(Exception, match="no"):
        E.synthesized(spark.createDataFrame([("refused",)], "content string"), Fussy())


def test_a_generator_is_asked_again():
    tired = Tired()
    assert P.Patience(3, 0, 0).call(lambda: tired.generate("x", 1), tired.retryable) == "Why?"


def test_a_run_by_the_synthesized_door(spark):
    udf = M.fake_embedder(dim=64)
    own = durable(chunks(spark).withColumn("embedding", udf("content")).withColumn("generation", F.lit(4).cast("long")))
    denied = spark.createDataFrame([("c",)], "node_id string")
    r = E.calibrated(own, None, udf, generator=W.Opening(3), denied=denied)
    assert (r["door"], r["generation"], r["pinned"], r["inside"], r["outside"], r["probes_from"]) == ("synthesized", 4, False, 3, 20, "built-in")
    text = E.rendered(r)
    assert E.DOORS["synthesized"] in text and E.BUILT_IN_NOTE in text and "4 (served)" in text and E.DOORS["queries-file"] not in text
    ask = spark.createDataFrame([("who  eats",), (" ",)], "q string")
    r = E.calibrated(own, spark.createDataFrame([("zebra pay",)], "q string"), udf, outside=ask, generation=4)
    text = E.rendered(r)
    assert r["outside"] == 1 and E.DOORS["queries-file"] in text and E.BUILT_IN_NOTE not in text and "4 (pinned)" in text
    with pytest.raises(ValueError, match="generator"):
        E.calibrated(own, None, udf)
    with pytest.raises(ValueError, match="no embedded chunks"):
        E.calibrated(own, ask, udf, generation=5)
    with pytest.raises(ValueError, match="long enough"):
        E.calibrated(own, None, udf, generator=W.Opening(), denied=denied, least=10_000)


def test_success_by_kind_and_controls(spark):
    asked = spark.createDataFrame([(1, "s", "a"), (2, "s", "b"), (3, "l", "c"), (4, "l", "x")], "qid long, kind string, expected string")
    hits = spark.createDataFrame([(1, "a", 1), (2, "n", 1), (2, "n", 2), (2, "a", 3), (2, "b", 4), (3, "n", 1)], "qid long, node_id string, r int")
    got = {r["kind"]: tuple(r)[1:] for r in E.success_by_kind(asked, hits).collect()}
    assert got == {"s": (2, 1, 2, 2), "l": (2, 0, 0, 0)}
    assert tuple(E.leaks(asked, hits, spark.createDataFrame([("n",), ("n",)], "node_id string")).first()) == (4, 2)
    assert tuple(E.answered_outside(asked, hits, spark.createDataFrame([(3,)], "qid long")).first()) == (4, 2)


def test_float_formats(spark):
    rng = random.Random(5)
    numbers = [0.0625, 0.4375, 2.675, 0.0, -0.0, 1e-5, 1e-4, 1e16, 123456789.125, -2.5, 5e-324, 1.0, 1e22, None] + [rng.uniform(-10, 10) ** 9 for _ in range(200)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = rows.select("i", X.fixed(F.col("x"), 3).alias("f"), X.rounded(F.col("x"), 3).alias("r"), X.shortest(F.col("x")).alias("s")).collect()
    for r in got:
        x = numbers[r["i"]]
        assert tuple(r)[1:] == ((None,) * 3 if x is None else (f"{x:.3f}", round(x, 3), repr(x)))
