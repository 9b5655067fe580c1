"""A provider that fails: bad texts alone, outages as pending, miscounts refused."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from corpusloom.functions import providers as P

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks don't see the tests


class Outage(RuntimeError):
    pass


class Flaky:
    """Refuses batches with a bad text; is down where a text says so; miscounts on request."""

    def __init__(self, log=None):
        self.log = log

    def embed(self, texts):
        if self.log is not None:
            self.log.append(list(texts))
        if "down" in texts:
            raise Outage("429")
        if any(t.startswith("bad") for t in texts):
            raise ValueError("can't read " + next(t for t in texts if t.startswith("bad")) + "é" * 600)
        if "count" in texts:
            return [[1.0, 0.0]] * (len(texts) + 1)
        return [[0.0, 0.0] if t == "zero" else [1.0] if t == "narrow" else [float(len(t)), 1.0] for t in texts]

    def retryable(self, error):
        return isinstance(error, Outage)


def run(texts, log=None):
    return list(P.isolated(texts, Flaky(log), 2, P.Patience(2, 0, 0), sleep=lambda s: None))


@pytest.mark.parametrize("bad", [set(), {0}, {63}, {64}, {5, 6}, {0, 99}, set(range(100))])
def test_bad_texts_fail_alone_and_in_order(bad):
    texts = [f"bad{i}" if i in bad else "x" * (i + 1) for i in range(100)]
    log = []
    got = run(texts, log)
    assert [s for s, _, _ in got] == ["failed" if i in bad else "embedded" for i in range(100)]
    for i, (_, vector, reason) in enumerate(got):
        if i in bad:
            assert len(reason) == 500 and f"bad{i}é" in reason and vector is None
        else:
            assert vector == pytest.approx(np.array([i + 1, 1]) / np.hypot(i + 1, 1)) and reason is None
    assert all(len(call) <= P.BATCH for call in log)
    if len(bad) == 1:
        assert len(log) <= 2 + 2 * 7


def test_degenerate_vectors_fail_with_their_reason():
    got = run(["a", "zero", "narrow", "b"])
    assert [s for s, _, _ in got] == ["embedded", "failed", "failed", "embedded"]
    assert "zero" in got[1][2] and "2 dimensions" in got[2][2]


def test_an_outage_leaves_the_rest_pending_and_asks_no_more():
    log = []
    got = run([f"t{i}" for i in range(64)] + ["down"] + ["u"] * 100, log)
    assert [s for s, _, _ in got] == ["embedded"] * 64 + ["pending"] * 101
    assert len(log) == 3  # one call, and the two attempts of the outage


def test_miscounts_are_refused():
    with pytest.raises(P.Miscounted):
        run(["a", "count"])


def test_patience():
    slept, calls = [], []

    def attempt():
        calls.append(1)
        if len(calls) < 4:
            raise Outage("x")
        return "got"

    patience = P.Patience(5, 1.0, 3.0)
    assert patience.call(attempt, lambda e: True, slept.append) == "got"
    assert len(slept) == 3 and all(0 <= s <= min(3, 2**n) for n, s in enumerate(slept))
    with pytest.raises(ZeroDivisionError):
        patience.call(lambda: 1 / 0, lambda e: False, slept.append)
    assert len(slept) == 3
    with pytest.raises(Outage):
        P.Patience(2, 0, 0).call(lambda: Flaky().embed(["down"]), lambda e: True, lambda s: None)


def test_in_tasks(spark):
    rows = spark.createDataFrame([(1, "fine"), (2, "bad one"), (3, None), (4, "fine too")], "id int, input string").coalesce(1)
    got = {r["id"]: (r["embedding_status"], r["embedding"] is not None, r["embed_error"] is not None) for r in P.drained(rows, Flaky(), 2, patience=P.Patience(1, 0, 0)).collect()}
    assert got == {1: ("embedded", True, False), 2: ("failed", False, True), 3: ("embedded", True, False), 4: ("embedded", True, False)}
