"""Snapshot tokens: which generation a reader saw, signed, as column expressions over a table of them.

A token is the payload and its HMAC-SHA256, each in URL-safe Base64 and joined by a dot. The payload is
JSON with sorted keys and no spaces. HMAC is put together from SHA-256 over the padded keys, which
stand in the plan as literals: keep plans that hold a ring from those who may not mint.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds that a token lives, bytes of a block of SHA-256, and why a token isn't taken.
LIFETIME, BLOCK = 3600, 64
REASONS = ("expired", "foreign_deployment", "unknown_key", "invalid")
PAYLOAD = "corpus_id string, expires_at string, generation long, instance_digest string, key_id string, tenant_id string"


@dataclass(frozen=True)
class KeyRing:
    """Keys by id; new tokens are signed by the active one, old ones are known as long as their key is."""

    active: str
    keys: dict[str, bytes] = field(repr=False)

    def __post_init__(self) -> None:
        if self.active not in self.keys:
            raise ValueError(f"the key ring has no active key {self.active!r}")


@dataclass(frozen=True)
class Scope:
    tenant: str
    corpus: str
    instance_digest: str


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The HMAC of a binary column, as binary (RFC 2104)."""
    import hashlib

    padded = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ mask for b in padded)) for mask in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256))


def _to_url(data: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(data), "+/", "-_"), "[=\\s]+", "")


def _from_url(text: Column) -> Column:
    """The bytes of URL-safe Base64 without padding; null for anything else."""
    padded = F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4)).cast("int")))
    return F.when(text.rlike(r"^[A-Za-z0-9_-]+$") & (F.length(text) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))


def _canonical(fields: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]))


def minted(ring: KeyRing, scope: Scope, generation: Column, now: Column) -> Column:
    """A token for each generation, good for LIFETIME seconds from now (a timestamp)."""
    expires = F.date_format(F.timestamp_seconds(F.unix_timestamp(now) + LIFETIME), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = _canonical({"corpus_id": F.lit(scope.corpus), "tenant_id": F.lit(scope.tenant), "generation": generation.cast("long"), "instance_digest": F.lit(scope.instance_digest), "expires_at": expires, "key_id": F.lit(ring.active)})
    raw = F.encode(body, "UTF-8")
    return F.concat_ws(".", _to_url(raw), _to_url(hmac_sha256(ring.keys[ring.active], raw)))


def judged(ring: KeyRing, scope: Scope, token: Column, now: Column) -> Column:
    """(generation, reason) of a token: one of them is null. The session's time zone must be UTC.

    Only a payload in its canonical form is taken. A foreign tenant or corpus is invalid, without a word
    on whose it is; a foreign deployment, an unknown key and an expired token are told apart.
    """
    parts = F.split(token, "\\.")
    raw, signature = _from_url(F.get(parts, F.lit(0))), _from_url(F.get(parts, F.lit(1)))
    body = F.decode(raw, "UTF-8")
    p = F.from_json(body, PAYLOAD)
    known = p["key_id"].isin(list(ring.keys))
    right = F.lit(False)
    for name, key in ring.keys.items():
        right = right | ((p["key_id"] == name) & (hmac_sha256(key, raw) == signature))
    same = body == _canonical({f.split()[0]: p[f.split()[0]] for f in PAYLOAD.split(", ")})
    expires = F.try_to_timestamp(p["expires_at"], F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    reason = (
        F.when((F.size(parts) != 2) | raw.isNull() | signature.isNull() | p.isNull() | p["key_id"].isNull(), "invalid")
        .when(~known, "unknown_key")
        .when(~right | ~F.coalesce(same, F.lit(False)) | ~F.coalesce((p["corpus_id"] == scope.corpus) & (p["tenant_id"] == scope.tenant), F.lit(False)), "invalid")
        .when(~p["instance_digest"].eqNullSafe(F.lit(scope.instance_digest)), "foreign_deployment")
        .when(expires.isNull() | p["generation"].isNull(), "invalid")
        .when(now >= expires, "expired")
    )
    reason = F.when(token.isNull(), "invalid").otherwise(reason)
    return F.struct(F.when(reason.isNull(), p["generation"]).alias("generation"), reason.alias("reason"))
