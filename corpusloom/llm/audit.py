"""Filter interaction audit by a multilinear extension (operator 13).

Every document gets a mask of the filters that it fails. What a set of filters removes from a part
of the corpus depends on the part's mask counts alone, so Spark reduces the corpus to those: at most
2^5 masks for each part and label. From there a part is a polynomial. With x_i the chance that
filter i is applied, a document of mask m is removed with chance 1 - prod over i in m of (1 - x_i);
summed over documents this is multilinear in x, and its value at a corner of the cube is what
exactly those filters remove. Removals of a step in an order are differences of two corners.
A filter's Shapley value is the integral of its partial derivative along the diagonal from
(0,...,0) to (1,...,1) (Owen, 1972), in exact rationals; times 5! it is the sum over all orders.

E needs the whole table: a text's digest (SHA-256) stands for it, equal digests are grouped, and a
group is pre-aggregated by label and part before the least doc_id is known. So a group of copies of
any size is some rows when it meets, and no text is shuffled.

Defined cases: a null text is empty, a null lang the part of the empty string. A null doc_id is
neither smaller nor greater than another: such rows fail E never and bring no other to fail it. Rows
that repeat a doc_id and its text count each and don't fail E through each other. Several labels of a
doc_id: good if any is 1, and the same for toxic; null labels and those of no document say nothing.
Bytes that are no UTF-8 count as they stand. An empty table has no parts and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, buffers, spread, table, text_batches, written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, MARKS = 200, 50, 3, b"#$%&*|"
CAPITALS = bytes(range(65, 91))
#: Everything but the first byte of a UTF-8 character.
CONTINUATION = bytes(range(0x80, 0xC0))


def text_mask(text: bytes) -> int:
    """Bits 0 to 3 for A to D, of a text alone."""
    words = text.split()  # of bytes: cut at space and the control characters 9 to 13
    short = len(words) < LEAST_WORDS
    repeating = 100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)
    # bytes that a deletion takes away are those of the class
    capitals = len(text) - len(text.translate(None, CAPITALS))
    chars = len(text.translate(None, CONTINUATION))
    marked = len(text) != len(text.translate(None, MARKS))
    return short | repeating << 1 | (100 * capitals > MOST_CAPITALS_PERCENT * chars) << 2 | marked << 3


def text_masks(docs: DataFrame, key: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """id, part, digest and mask (without E) of each row."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    schema = "id long, part string, digest binary, mask int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in blocks(batch, "text"):
                data, offsets = buffers(some.column("text"))
                texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("part"), digests, pa.array(map(text_mask, texts), pa.int32())], ["id", "part", "digest", "mask"])

    return spread(rows).mapInArrow(run, schema)


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang") -> DataFrame:
    """part, mask, good, toxic and n: the documents of each part, mask and label. At most 128 rows a part."""
    rows = written(text_masks(docs, key, part), "audit")
    one = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = rows.where(F.col("id").isNotNull()).join(one, "id", "left").na.fill(False, ["good", "toxic"])
    # equal rows together, then the copies of each part and label, then the few that meet in a text's group
    known = known.groupBy("id", "digest", "part", "good", "toxic", "mask").agg(F.count(F.lit(1)).alias("n"))
    sides = known.groupBy("digest", "part", "good", "toxic", "mask").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    sides = sides.withColumn("own", F.when(F.col("least.id") == first, F.col("least.n")).otherwise(F.lit(0)))
    e = 1 << FILTERS.index("E")
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("own").alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - F.col("own")).alias("n"))))
    counted = sides.select("part", "good", "toxic", split.alias("x")).select("part", "good", "toxic", "x.*")
    nameless = rows.where(F.col("id").isNull()).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.unionByName(nameless.select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n"))
    return counted.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


class Polynomial:
    """What sets of filters remove, as a multilinear polynomial: coefficients by monomial (a bit set of variables)."""

    def __init__(self, counts: dict[int, int]) -> None:
        """counts: documents by mask."""
        self.of: dict[int, int] = {}
        for mask, n in counts.items():
            # 1 - prod (1 - x_i) = - sum over non-empty subsets s of the mask of (-1)^|s| x_s
            s = mask
            while s:
                self.of[s] = self.of.get(s, 0) + (n if s.bit_count() & 1 else -n)
                s = (s - 1) & mask

    def at(self, corner: int) -> int:
        """Documents that the filters of this bit set remove."""
        return sum(c for s, c in self.of.items() if s & ~corner == 0)

    def shapley(self, i: int) -> Fraction:
        """The integral from 0 to 1 of the derivative by x_i at (t, ..., t): each monomial with x_i leaves t^(|s| - 1)."""
        return sum((Fraction(c, s.bit_count()) for s, c in self.of.items() if s >> i & 1), Fraction(0))


def audited(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part, order of the filters and step: the audit's columns. counts: what mask_counts() returns."""
    orders = ["".join(p) for p in permutations(filters)]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names)

    def of_part(rows: pd.DataFrame) -> pd.DataFrame:
        def counted(some: pd.DataFrame) -> dict[int, int]:
            return {int(m): int(n) for m, n in some.groupby("mask")["n"].sum().items()}

        by_mask = counted(rows)
        whole, good, toxic = Polynomial(by_mask), Polynomial(counted(rows[rows["good"]])), Polynomial(counted(rows[rows["toxic"]]))
        total = sum(by_mask.values())
        fails = [sum(n for m, n in by_mask.items() if m >> i & 1) for i in range(len(filters))]
        value = [int(whole.shapley(i) * len(orders)) for i in range(len(filters))]
        out = []
        for order in orders:
            before = 0
            for step, letter in enumerate(order, 1):
                i = filters.index(letter)
                now = before | 1 << i
                removed, good_lost, toxic_lost = (p.at(now) - p.at(before) for p in (whole, good, toxic))
                out.append((rows["part"].iloc[0], order, step, total - whole.at(now), removed, fails[i] - removed, by_mask.get(1 << i, 0), good_lost, toxic_lost, value[i]))
                before = now
        return pd.DataFrame(out, columns=["part", "filter_order", "step", *names])

    return counts.groupBy("part").applyInPandas(of_part, schema)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, in all orders."""
    return audited(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    len(words) < 200 AS a,
    100 * list_unique(words) < 50 * len(words) AS b,
    100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS e
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), docs AS (
  SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed, count(*) AS n
  FROM fails GROUP BY ALL
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT concat(v.f, w.f, x.f, y.f, z.f) AS filter_order FROM f v, f w, f x, f y, f z
  WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5
), first AS (
  -- the step that removes documents of this set of failures
  SELECT docs.*, filter_order, CASE WHEN failed = '' THEN 6 ELSE list_min([instr(filter_order, t) FOR t IN string_split(failed, '')]) END AS gone FROM docs, orders
), steps AS (
  SELECT part, filter_order, step::INTEGER AS step, filter_order[step] AS letter,
    sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone < step AND contains(failed, filter_order[step]) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = step AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN gone = step AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM first, unnest([1, 2, 3, 4, 5]) AS s(step) GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM steps
"""
