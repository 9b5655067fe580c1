"""Mixing sources to target weights by hash-threshold histograms (operator 10).

Every document has a hash; a source's share is filled by its documents of lowest hash. No sort
finds the threshold: sizes are summed by source and leading hash bits, the bucket in which the
budget ends is found, and only that bucket's documents are summed again by the next bits, until
the bucket holds one hash. What is read for that is the hash and the size, never a text twice.

Targets fill up like water: sources share the total by weight, none gets more than MOST times its
own size, and what is over goes to the others by weight until none is above. A source whose
target is q whole sizes and a rest takes each document q times and those under the threshold
once more.

Defined cases: a null text has size 0; null is a source of its own and the last by code point;
a source of size 0 has target 0 and its documents are taken 0 times in words. Rows alike in
document, source and text have one hash and are taken or left together. An empty table gives an
empty result. The driver holds one row for each source, and per round one bucket for each.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import table, written

WEIGHTS, MOST = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that are used, and those that one histogram resolves.
HASH_BITS, STEP_BITS = 60, 12


def word_count(column: str = "text") -> F.Column:
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(WORD)).cast("long")


def document_hash(key: str) -> F.Column:
    """HASH_BITS bits that decide about a document: of its key, source and text."""
    return F.shiftrightunsigned(F.xxhash64(key, F.coalesce("source", F.lit("\0")), F.coalesce("text", F.lit(""))), 64 - HASH_BITS)


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[Fraction]:
    """What each source gets of the sum of sizes, by weight, at most so many times its size."""
    got = [Fraction(0)] * len(sizes)
    rest, weight = Fraction(sum(sizes)), sum(weights)
    # those that are full at the lowest level come first; from the first that isn't on, none is
    order = sorted(range(len(sizes)), key=lambda i: Fraction(most * sizes[i], weights[i]))
    for at, i in enumerate(order):
        share = rest / weight
        if share * weights[i] <= most * sizes[i]:
            for j in order[at:]:
                got[j] = share * weights[j]
            break
        got[i] = Fraction(most * sizes[i])
        rest, weight = rest - got[i], weight - weights[i]
    return got


def thresholds(rows: DataFrame, budgets: list[tuple[str | None, float]]) -> dict[str | None, int]:
    """The hash below which a source's documents come nearest to its budget of words.

    rows: source, size, hash (HASH_BITS bits).
    """
    spark = rows.sparkSession
    schema = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_left", T.DoubleType()), T.StructField("_prefix", T.LongType())])
    found: dict[str | None, int] = {}
    open_ = {source: (float(left), 0) for source, left in budgets}
    for used in range(0, HASH_BITS, STEP_BITS):
        if not open_:
            break
        over = HASH_BITS - used - STEP_BITS
        small = spark.createDataFrame([(s, left, prefix) for s, (left, prefix) in open_.items()], schema)
        part = rows.join(F.broadcast(small), F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("hash", over + STEP_BITS) == F.col("_prefix")))
        buckets = part.groupBy("_source", "_left", F.shiftright("hash", over).alias("bucket")).agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        sums = buckets.withColumn("upto", F.sum("size").over(Window.partitionBy("_source").orderBy("bucket")))
        # the first bucket that goes beyond the budget
        ends = sums.where(F.col("upto") > F.col("_left")).groupBy("_source").agg(F.min(F.struct("bucket", "upto", "size", "low", "high")).alias("end")).collect()
        ended = {row["_source"]: row["end"] for row in ends}
        for source, (left, _) in list(open_.items()):
            end = ended.get(source)
            if end is None:  # all of it fits
                found[source] = 1 << HASH_BITS
                del open_[source]
            elif end["low"] == end["high"]:
                before = end["upto"] - end["size"]
                found[source] = end["high"] + 1 if end["upto"] - left < left - before else end["low"]
                del open_[source]
            else:
                open_[source] = (left - (end["upto"] - end["size"]), end["bucket"])
    return found


def mixed(docs: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """For each document its source, size, source_size, target and copies (0 to most)."""
    rows = written(docs.select(F.col(key), F.col("source"), word_count().alias("size"), document_hash(key).alias("hash")), "mixing")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    sizes = sorted(((r["source"], r["size"] or 0) for r in sizes), key=lambda x: (x[0] is None, x[0] or ""))
    share = targets([n for _, n in sizes], [weights[i % len(weights)] for i in range(len(sizes))], most)
    plan, budgets = [], []
    for (source, size), target in zip(sizes, share):
        whole = int(target / size) if size else 0
        plan.append([source, size, float(target), whole])
        if size and target > whole * size:
            budgets.append((source, float(target - whole * size)))
    below = thresholds(rows, budgets)
    schema = T.StructType([T.StructField("_source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("_whole", T.IntegerType()), T.StructField("_below", T.LongType())])
    small = docs.sparkSession.createDataFrame([(*p, below.get(p[0], 0)) for p in plan], schema)
    out = rows.join(F.broadcast(small), F.col("source").eqNullSafe(F.col("_source")))
    return out.withColumn("copies", F.col("_whole") + (F.col("hash") < F.col("_below")).cast("int")).select(key, "source", "size", "source_size", "target", "copies", "hash")


def repeated(docs: DataFrame, mix: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs, each row as often as the mix takes it. mix: what mixed() returned for these docs.

    Copies follow from a row's source and hash, so no text is shuffled: the plan has one row for
    each source. The mix must be of the same rows.
    """
    ends = mix.groupBy("source").agg(F.max("copies").alias("_most"), F.min("copies").alias("_rest"), F.max(F.struct("copies", "hash")).alias("_top"))
    cut = ends.select(F.col("source").alias("_source"), "_most", "_rest", F.col("_top.hash").alias("_cut"))
    hashed = docs.withColumn("_hash", document_hash(key))
    rows = hashed.join(F.broadcast(cut), F.col("source").eqNullSafe(F.col("_source")))
    times = F.when(F.col("_hash") <= F.col("_cut"), F.col("_most")).otherwise(F.col("_rest"))
    return rows.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: words taken of each."""
    rows = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")
