"""SimHash near-duplicates by multi-index hashing (operator 6).

A fingerprint of b bits lies within r bits of another only if in one of m segments they differ
in r // m bits at most. So each segment's value is a table key, and a search enumerates the small
Hamming ball around its own value and fetches the matches; the complete distance then decides.
As links have no direction, a search flips bits from 0 to 1 only: of two values at distance 1 one
finds the other. Copies have one fingerprint and are searched once; what links is joined by
connected components over fingerprints, and documents come in again at the end.

Defined cases: a null text is empty; a text without words has fingerprint 0 and links like any
other; a text of fewer words than a shingle has one shingle of all its words. A component's id is
its smallest doc_id; null ids don't count unless there are no others. Repeated rows stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import blocks, buffers, spread, table, written
from .components import components
from .neardup import remaining

SHINGLE, RADIUS, SEED = 3, 3, 42
U64 = np.uint64


def shingle_spans(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with words set apart by one space, start and end of each shingle in them, and shingles per text."""
    data, offsets = buffers(column)
    text, starts, ends, first = hashing.word_spans(data, offsets)
    keep = ~hashing.WHITE[text]
    after = ends[ends < len(text)]
    keep[after[hashing.WHITE[text[after]]]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    text = np.where(hashing.WHITE[text], np.uint8(32), text)[keep]
    starts, ends = place[starts], place[ends]
    counts = np.diff(first)
    per = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    total = np.cumsum(per)
    at = np.arange(total[-1] if len(total) else 0) - np.repeat(total - per, per) + np.repeat(first[:-1], per)
    last = np.minimum(at + n, np.repeat(first[1:], per)) - 1
    return text, starts[at], ends[last], per


def majority(hashes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """For each text the bits that over half of its hashes have; 0 without hashes."""
    some = per > 0
    n = per[some]
    out = np.zeros(len(per), U64)
    if not len(n):
        return out
    pieces = -(-n // 255)  # a byte counts to 255
    firsts = np.cumsum(pieces) - pieces
    cut = np.repeat(np.cumsum(n) - n, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(firsts, pieces))
    found = np.zeros(len(n), U64)
    for b in range(8):
        lanes = np.add.reduceat((hashes >> U64(b)) & U64(0x0101010101010101), cut)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), firsts, axis=0)
        for byte in range(8):
            found |= (2 * counts[:, byte] > n).astype(U64) << U64(8 * byte + b)
    out[some] = found
    return out


def simhash(column: pa.Array, shingle: int = SHINGLE, words: int = 1) -> np.ndarray:
    """For each text `words` 64-bit fingerprints; the first is over XXH64 with seed 42, the others over hashes of it."""
    text, starts, ends, per = shingle_spans(column, shingle)
    first = hashing.xxh64_spans(text, starts, ends, SEED)
    return np.stack([majority(first if k == 0 else hashing.mix(first + U64(k * 0x9E3779B97F4A7C15 % 2**64)), per) for k in range(words)], axis=1)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                found = simhash(part.column(text), shingle)[:, 0].view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(found, pa.int64())], [key, "fp"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, fp long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in at most radius bits, each once.

    Two segments of 32 bits serve a radius of up to 3, as one of them differs in one bit at most.
    """
    if radius > 3:
        raise ValueError("two segments and balls of one bit hold for 3 bits at most")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    value = F.transform(F.array(low, high), lambda v, k: v.bitwiseOR(F.shiftleft(k.cast("long"), 32)))
    keyed = prints.select("fp", F.explode(value).alias("key"))
    flips = F.array(*[F.lit(1 << b) for b in range(32)])
    ball = F.concat(F.array(F.col("key")), F.transform(F.filter(flips, lambda bit: F.col("key").bitwiseAND(bit) == 0), lambda bit: F.col("key").bitwiseOR(bit)))
    probes = keyed.select(F.col("fp").alias("a"), F.explode(ball).alias("key"), F.col("key").alias("own"))
    tables = keyed.select(F.col("fp").alias("b"), "key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    once = (F.col("own") != probes["key"]) | (F.col("a") < F.col("b"))
    found = probes.join(tables.hint("shuffle_hash"), "key").where(near & once)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grouped(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows (key, fp) with component_id."""
    prints = written(rows.groupBy("fp").agg(F.min(key).alias("least")), "simhash-prints")
    linked = components(links(prints), "a", "b", "simhash-links")
    named = prints.join(linked, prints["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = written(named, "simhash-named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # one row for each fingerprint: rows of a much copied one are split over tasks
    return rows.join(named.join(ids, "root").select("fp", "component_id"), "fp")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs with one document of each component of linked fingerprints: the least id.

    Of rows that repeat an id and a fingerprint the text of the least digest stays. A component whose ids
    are all null keeps one row of each text; other null ids go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                data, offsets = buffers(part.column(text))
                digests = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
                found = simhash(part.column(text), shingle)[:, 0].view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(digests, pa.string()), pa.array(found, pa.int64())], [key, "digest", "fp"])

    every = written(spread(docs).select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, digest string, fp long"), "simhash-every")
    rows = grouped(every, key)
    first = rows.where(F.col(key) == F.col("component_id")).groupBy(key, "fp").agg(F.min("digest").alias("digest")).select(key, "digest")
    alone = rows.where(F.col("component_id").isNull()).select(key, "digest").distinct()
    kept = written(first.unionByName(alone), "simhash-kept")
    return remaining(docs, every, kept, key, text)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = grouped(written(fingerprints(docs), "simhash"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
