"""Document fingerprints: one-permutation MinHash, densified and packed (operator 1).

Each word shingle is hashed once. The hash picks one of BINS bins and every bin keeps its
smallest value; an empty bin copies the value of a filled bin that a fixed random probe
order, private to the bin, reaches first (optimal densification). The low BITS bits of each
bin are packed into the fingerprint. Two fingerprints agree in a share E of bins; as low bits
agree by chance at a rate of 2**-BITS, the likeness is (E - 2**-BITS) / (1 - 2**-BITS), from 0 to 1.

Defined cases: a null text is an empty text. A text without words has the empty string as its
fingerprint; its likeness is 1 to another such text and 0 to any other. A text of fewer words
than a shingle has one shingle of all its words. Equal texts have equal fingerprints. Rows with
equal doc_id follow each other by their texts' SHA-256; rows with a null doc_id come last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import hashing
from .common import blocks, buffers, clean_text, spread, table

BINS, BITS, SHINGLE = 512, 4, 5
#: Ranges of doc_id for each shuffle partition, so that partitions come out even.
RANGES_PER_PARTITION = 4
MOST_RANGES = 20_000


@lru_cache
def probes(bins: int) -> np.ndarray:
    """Row t, column b: the bin that bin b asks at its t-th attempt."""
    rng = np.random.default_rng(20240607)
    return np.argsort(rng.random((bins, bins), dtype=np.float32), axis=1).T.astype(np.int32).copy()


def sketch(column: pa.Array, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The low bits of every bin for each text, and whether the text has words."""
    data, offsets = buffers(column)
    text, starts, ends, first = hashing.word_spans(data, offsets)
    hashes, owner = hashing.shingle_hashes(hashing.span_hashes(text, starts, ends), first, shingle)
    width = bins.bit_length() - 1
    none = np.uint64(2**64 - 1)
    least = np.full(len(column) * bins, none, np.uint64)
    np.minimum.at(least, owner * bins + (hashes >> np.uint64(64 - width)).astype(np.int64), hashing.mix(hashes) >> np.uint64(1))
    least = least.reshape(-1, bins)
    has = np.diff(first) > 0
    filled = least != none
    row, bin_ = np.nonzero(~filled & has[:, None])
    order, attempt = probes(bins), 0
    while len(row):
        asked = order[attempt, bin_]
        hit = filled[row, asked]
        least[row[hit], bin_[hit]] = least[row[hit], asked[hit]]
        row, bin_ = row[~hit], bin_[~hit]
        attempt += 1
    return (least & np.uint64((1 << bits) - 1)).astype(np.uint8), has


def packed(low: np.ndarray, has: np.ndarray, bits: int = BITS) -> list[str]:
    """Bits of all bins after each other, as hexadecimal digits."""
    flat = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(low), -1)
    return [row.tobytes().hex() if yes else "" for row, yes in zip(np.packbits(flat, axis=1), has)]


def likeness(a: np.ndarray, has_a: np.ndarray, b: np.ndarray, has_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets, chance agreement taken out."""
    chance = 2.0**-bits
    share = (np.mean(a == b, axis=1) - chance) / (1 - chance)
    return np.where(has_a & has_b, np.clip(share, 0, 1), (has_a == has_b).astype(float))


def with_fingerprints(df: DataFrame, texts: dict[str, str], likenesses: dict[str, tuple[str, str]] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """df with a fingerprint column for each text column, which goes, and likenesses of pairs of them.

    texts: text column by name of its fingerprint; a name starting with _ serves likenesses only.
    likenesses: the two fingerprint names by the name of the new column.
    """
    likenesses = likenesses or {}
    kept = [c for c in df.columns if c not in texts.values()]
    shown = [c for c in texts if not c.startswith("_")]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T.StringType()) for c in shown] + [T.StructField(c, T.DoubleType()) for c in likenesses])
    longest = next(iter(texts.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, longest):
                found = {name: sketch(part.column(column), shingle=shingle) for name, column in texts.items()}
                columns = [part.column(c) for c in kept]
                columns += [pa.array(packed(*found[c]), pa.string()) for c in shown]
                columns += [pa.array(likeness(*found[a], *found[b]), pa.float64()) for a, b in likenesses.values()]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *shown, *likenesses])

    return df.mapInArrow(run, schema)


def with_next(df: DataFrame, key: str, column: str, into: str) -> DataFrame:
    """df with the column's value in the next row by descending key; the last row gets the first's.

    The keys are cut into ranges, each sorted on its own, so the work is one shuffle. The first
    row of every range, one row a range, is also dealt to the range before it, where it closes the gap.
    """
    spark = df.sparkSession
    ranges = min(MOST_RANGES, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    # the number of cuts below the key; null keys are last, in the lowest range
    number = F.coalesce(_cuts_below(F.col(key), cuts), F.lit(0))
    ordered = df.withColumn("_range", number).withColumn("_tie", F.sha2(F.coalesce(column, F.lit("")), 256))
    by = [F.col(key).desc_nulls_last(), F.col("_tie")]
    heads = ordered.select("_range", key).groupBy("_range").agg(F.max(key).alias("_key"), F.count(F.lit(1)).alias("_rows")).orderBy(F.col("_range").desc()).collect()
    if not heads:
        return df.withColumn(into, F.lit(None).cast("string"))
    # to which range the first row of each range is dealt too: the next higher one, and the highest's to the lowest
    goes = [(heads[i]["_range"], heads[i]["_key"], heads[i - 1]["_range"]) for i in range(len(heads))]
    goes = F.broadcast(spark.createDataFrame([(r, k, to) for r, k, to in goes], T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_key", df.schema[key].dataType), T.StructField("_to", T.IntegerType())])))
    first = ordered.select("_range", key, column, "_tie").alias("o").join(goes.alias("g"), (F.col("o._range") == F.col("g._range")) & F.col(f"o.{key}").eqNullSafe(F.col("g._key")))
    first = first.groupBy("_to").agg(F.min_by(f"o.{column}", "o._tie").alias(column), F.min("o._tie").alias("_tie"))
    ghosts = first.select(F.col("_to").alias("_range"), column, "_tie", F.lit(True).alias("_ghost"))
    rows = ordered.withColumn("_ghost", F.lit(False)).unionByName(ghosts, allowMissingColumns=True)
    window = Window.partitionBy("_range").orderBy(F.col("_ghost"), *by)
    return rows.withColumn(into, F.lead(column).over(window)).where(~F.col("_ghost")).drop("_range", "_tie", "_ghost")


def _cuts_below(key, cuts: list) -> F.Column:
    """How many of the sorted cuts are less than the key: first by groups of cuts, then within one group."""
    if not cuts:
        return F.lit(0)
    size = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    group = F.array_size(F.filter(F.lit([g[-1] for g in groups[:-1]]) if len(groups) > 1 else F.array().cast("array<bigint>"), lambda c: c < key))
    own = F.get(F.array(*[F.lit(g) for g in groups]), group)
    return group * size + F.array_size(F.filter(own, lambda c: c < key))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with both likenesses."""
    docs = spread(clean_text(table(spark, sf_dir, "documents").select("doc_id", "text")))
    rows = with_next(docs, "doc_id", "text", "_next")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("_next"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "text", "_next", edited.alias("_edited")).withColumn("edited_sha256", F.sha2("_edited", 256))
    return with_fingerprints(rows, {"fingerprint": "text", "edited_fingerprint": "_edited", "_following": "_next"}, {"near_edited": ("fingerprint", "edited_fingerprint"), "near_next": ("fingerprint", "_following")})
