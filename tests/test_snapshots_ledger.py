"""Snapshot tokens as columns, and the ledger's columns, wall, days and groups."""

import hashlib
import hmac
import json
from base64 import urlsafe_b64decode, urlsafe_b64encode
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import snapshots as S
from corpusloom.sources import ledger as L

RING = S.KeyRing("k2", {"k1": b"old key", "k2": b"new key" * 20})
SCOPE = S.Scope("t", "c", "digest")


def now():
    return F.lit("2024-05-01 10:00:00").cast("timestamp")


def test_hmac_vectors(spark):
    """RFC 4231, cases 1 to 4, 6 and 7."""
    cases = [(b"\x0b" * 20, b"Hi There"), (b"Jefe", b"what do ya want for nothing?"), (b"\xaa" * 20, b"\xdd" * 50), (bytes(range(1, 26)), b"\xcd" * 50), (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First"), (b"\xaa" * 131, b"This is a test using a larger than block-size key and a larger than block-size data. The key needs to be hashed before being used by the HMAC algorithm.")]
    first = ["b0344c61d8db38535ca8afceaf0bf12b", "5bdcc146bf60754e6a042426089575c7", "773ea91e36800e46854db8ebd09181a7", "82558a389a443c0ea4cc819899f2083a", "60e431591ee0b67f0d8a26aacbf5b77f", "9b09ffa71b942fcb27635fbcd5b0e944"]
    got = spark.range(1).select(*[F.lower(F.hex(S.hmac_sha256(k, F.lit(m)))).alias(f"h{i}") for i, (k, m) in enumerate(cases)]).first()
    assert list(got) == [hmac.new(k, m, hashlib.sha256).hexdigest() for k, m in cases]
    assert [g[:32] for g in got] == first


def token(payload, key):
    body = json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()
    b64 = lambda x: urlsafe_b64encode(x).rstrip(b"=").decode()
    return f"{b64(body)}.{b64(hmac.new(key, body, hashlib.sha256).digest())}"


def test_tokens_are_judged(spark):
    good = {"corpus_id": "c", "tenant_id": "t", "generation": 7, "instance_digest": "digest", "expires_at": "2024-05-01T10:30:00Z", "key_id": "k2"}
    new, old = RING.keys["k2"], RING.keys["k1"]
    fine = token(good, new)
    tampered = token(good | {"generation": 8}, new).split(".")[0] + "." + fine.split(".")[1]
    spaced = urlsafe_b64encode(json.dumps(good, sort_keys=True).encode()).rstrip(b"=").decode()
    cases = {
        fine: (7, None),
        token(good | {"key_id": "k1"}, old): (7, None),
        token(good | {"key_id": "k1"}, new): (None, "invalid"),
        token(good | {"key_id": "k9"}, new): (None, "unknown_key"),
        token(good | {"expires_at": "2024-05-01T10:00:00Z"}, new): (None, "expired"),
        token(good | {"expires_at": "soon"}, new): (None, "invalid"),
        token(good | {"instance_digest": "other"}, new): (None, "foreign_deployment"),
        token(good | {"tenant_id": "x"}, new): (None, "invalid"),
        token(good | {"corpus_id": "x"}, new): (None, "invalid"),
        token(good | {"generation": 1.5}, new): (None, "invalid"),
        token(good | {"more": 1}, new): (None, "invalid"),
        tampered: (None, "invalid"),
        spaced + "." + fine.split(".")[1]: (None, "invalid"),
        fine + ".x": (None, "invalid"),
        fine.split(".")[0]: (None, "invalid"),
        fine.split(".")[0] + ".": (None, "invalid"),
        "é.è": (None, "invalid"),
        "": (None, "invalid"),
        "bm90IGpzb24.AAAA": (None, "invalid"),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", S.judged(RING, SCOPE, F.col("t"), now()).alias("v")).collect()
    assert {r["t"]: (r["v"]["generation"], r["v"]["reason"]) for r in rows} == cases
    null = spark.createDataFrame([(None,)], "t string").select(S.judged(RING, SCOPE, F.col("t"), now()).alias("v")).first()["v"]
    assert null["reason"] == "invalid"


def test_minted_tokens_are_taken(spark):
    rows = spark.range(1, 4).select("id", S.minted(RING, SCOPE, F.col("id"), now()).alias("t"))
    assert [r["v"]["generation"] for r in rows.select("id", S.judged(RING, SCOPE, F.col("t"), now()).alias("v")).orderBy("id").collect()] == [1, 2, 3]
    later = now() + F.expr("interval 1 hour")
    assert {r["v"]["reason"] for r in rows.select(S.judged(RING, SCOPE, F.col("t"), later).alias("v")).collect()} == {"expired"}
    body = json.loads(urlsafe_b64decode(rows.first()["t"].split(".")[0] + "=="))
    assert body["expires_at"] == "2024-05-01T11:00:00Z" and "new key" not in repr(RING)
    with pytest.raises(ValueError):
        S.KeyRing("k3", RING.keys)


def test_ledger_of_many_tenants_and_days(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(d * 100 + i, datetime(2024, 5, d, 12, 0, i), "t" if i % 2 else "u", "c", 1, "a", "search", "m", "p", "x", "{}") for d in (1, 2, 3) for i in range(10)]
    for part in (rows[:15], rows[15:]):
        assert L.append(spark.createDataFrame(part, L.SCHEMA), path)
    got, opened = L.latest(spark, path, 4, "t")
    assert [r["id"] for r in got.collect()] == [309, 307, 305, 303] and opened == ["2024-05-03"]
    got, opened = L.latest(spark, path, 7, "t", "c")
    assert {r["tenant_id"] for r in got.collect()} == {"t"} and got.count() == 7 and opened == ["2024-05-03", "2024-05-02"]
    assert L.latest(spark, path, 99, "nobody")[0].count() == 0
    before = L.read(spark, path).where("day = '2024-05-02'").select("id").collect()
    L.compacted(spark, path, "2024-05-02")
    after = L.read(spark, path)
    assert sorted(after.where("day = '2024-05-02'").select("id").collect()) == sorted(before) and after.count() == 30
    assert len([f for f in spark.read.parquet(f"{path}/day=2024-05-02").inputFiles()]) == 1


def test_rows_are_written_in_groups(spark, tmp_path):
    path = str(tmp_path / "log")
    log = L.Ledger(spark, path, most=3)
    assert log.add(action="read", tenant_id="t", actor="a") and log.add(action="search", tenant_id="t")
    assert not (tmp_path / "log").exists() and not log.add(action="drop")
    assert log.add(action="abstain", tenant_id="t", generation=4)
    assert L.read(spark, path).count() == 3 and len(spark.read.parquet(path).inputFiles()) == 1
    log.add(action="outline", tenant_id="t")
    assert log.flush() and log.flush() and L.read(spark, path).select("id").distinct().count() == 4


def test_a_ledger_that_cannot_be_written_fails_no_read(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    assert not L.Ledger(spark, str(tmp_path / "file" / "log")).add(action="read")
