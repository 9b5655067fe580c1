"""Importance resampling towards a target distribution, over an integer word dictionary (operator 12).

Features of a text are its runs of n_from to n_to words; each falls into one of `buckets` by the CRC-32 of
its bytes. A bucket's gain is the log ratio of its share in the target to its share in the corpus, a
text's weight the sum of its features' gains, and Gumbel noise on it turns the highest scores into a
draw without replacement.

Three levels keep strings out of the large tables:

* Blocks. A task cuts its texts into words and numbers the distinct ones of a block of bounded size.
  Documents are kept as packed tuple numbers with counts, tuples as tuples of word numbers.
* The dictionary. Distinct words of all blocks get an id; blocks translate their word numbers into
  ids, so equal n-grams of different blocks are equal tuples of ids.
* Tuples. Each distinct tuple's bytes are put together from the dictionary and hashed once. Its
  bucket, and later the bucket's gain, is joined back to the blocks' tuples, whose counts it meets
  in the block's own task. What is shuffled is a row for each block and distinct tuple, not one
  for each document and feature, nor one for each use.

No block holds more than BLOCK_WORDS words, besides a longer single text, so a block is a bounded
group. A word has one row in a block however common it is, and the joins on words have one row on
the other side, so Spark may split them. The gains are one row a bucket, a bound of the parameters.
Ranks come from a range-sorted table: a row's place in its partition and the counts of those before.

Defined cases: a null text has no words, weight 0 and no rank. A null doc_id is drawn as the text
"null". Rows that repeat a doc_id are documents of their own; those alike in all are ranked in any
order. Without a target each bucket has t = 0. An empty table gives an empty result. Bytes of 128
and more belong to words, whatever they encode.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, spread, table, text_batches, written

BUCKETS, SEED, LEAST_WORDS, DRAWN_PERCENT = 10_000, 2024, 20, 10
#: Words of a block at most, besides a longer single text.
BLOCK_WORDS = 1 << 21
#: Lower-cases A-Z and turns every other byte below 128 that is no digit or lower-case letter into a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

BLOCK_SCHEMA = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("kind", T.StringType()),  # word, tuple or doc
        T.StructField("at", T.IntegerType()),  # number of the word or tuple in the block
        T.StructField("word", T.BinaryType()),
        T.StructField("words", T.ArrayType(T.IntegerType())),  # of a tuple
        T.StructField("n", T.LongType()),  # uses in the block, of a tuple or of a word that is one; words of the document
        T.StructField("id", T.LongType()),
        T.StructField("features", T.BinaryType()),  # of a document: its distinct tuples and their counts, packed
    ]
)


def packed(found: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending tuple numbers as differences, and their counts, compressed."""
    return zlib.compress(np.concatenate([np.diff(found, prepend=0), counts]).astype("<i4").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), "<i4").astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


class Numbers(dict):
    """Numbers things in the order in which they come."""

    def __missing__(self, thing) -> int:
        self[thing] = number = len(self)
        return number


class Block:
    """Texts as tuple numbers, until there are enough of them."""

    def __init__(self, n_from: int, n_to: int) -> None:
        self.n_from, self.n_to = n_from, n_to
        self.words, self.tuples = Numbers(), Numbers()
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, key: int | None, text: bytes) -> None:
        cut = text.translate(TO_WORDS).split()
        numbers = np.fromiter(map(self.words.__getitem__, cut), np.int32, len(cut))
        if self.n_from == self.n_to == 1:
            features = numbers  # a tuple of one word has the word's number
        else:
            listed = numbers.tolist()
            grams = [tuple(listed[i : i + k]) for k in range(self.n_from, self.n_to + 1) for i in range(len(listed) - k + 1)]
            features = np.fromiter(map(self.tuples.__getitem__, grams), np.int32, len(grams))
        found, counts = np.unique(features, return_counts=True)
        self.ids.append(key)
        self.sizes.append(len(cut))
        self.docs.append((found, counts.astype(np.int32)))
        self.held += max(len(cut), len(features))

    def batches(self, block: int) -> Iterator[pa.RecordBatch]:
        """The block's rows."""
        single = self.n_from == self.n_to == 1
        totals = np.zeros(len(self.words if single else self.tuples), np.int64)
        for found, counts in self.docs:
            totals[found] += counts
        words = pa.array(list(self.words), pa.binary())
        uses = {"n": pa.array(totals)} if single else {}
        yield from _rows(block, "word", at=pa.array(np.arange(len(words), dtype=np.int32)), word=words, **uses)
        if not single:
            yield from _rows(block, "tuple", at=pa.array(np.arange(len(totals), dtype=np.int32)), words=pa.array(list(self.tuples), pa.list_(pa.int32())), n=pa.array(totals))
        yield from _rows(block, "doc", id=pa.array(self.ids, pa.int64()), n=pa.array(self.sizes, pa.int64()), features=pa.array([packed(*d) for d in self.docs], pa.binary()))


def _rows(block: int, kind: str, rows: int = 1 << 16, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    types = {"block": pa.int64(), "kind": pa.string(), "at": pa.int32(), "word": pa.binary(), "words": pa.list_(pa.int32()), "n": pa.int64(), "id": pa.int64(), "features": pa.binary()}
    columns |= {"block": pa.array(np.full(n, block)), "kind": pa.array([kind] * n)}
    whole = pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, t)).cast(t) for name, t in types.items()], list(types))
    for at in range(0, n, rows):
        yield whole.slice(at, rows)


def blocks_of(docs: DataFrame, key: str | None, text: str, n_from: int, n_to: int) -> DataFrame:
    """Rows of blocks: their words, tuples and documents. Block numbers are those of the task and are fixed once the table is written."""
    text_batches(docs.sparkSession)
    most = BLOCK_WORDS
    rows = spread(docs.select((F.lit(None) if key is None else F.col(key)).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = TaskContext.get().partitionId() << 31, Block(n_from, n_to)
        for batch in batches:
            for key, value in zip(batch.column("id").to_pylist(), batch.column("text")):
                now.add(key, value.as_py())
                if now.held >= most:
                    yield from now.batches(number)
                    number, now = number + 1, Block(n_from, n_to)
        if now.ids:
            yield from now.batches(number)

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def tuples_of(blocks: DataFrame, n_to: int) -> DataFrame:
    """side, block, at, tuple (an array of dictionary ids) and n, of every block's tuples; and, second, the dictionary: word, id, and the words' own uses s and t where they are tuples."""
    words = blocks.where("kind = 'word'").select("side", "block", "at", "word", "n")
    uses = [F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)).alias(name) for side, name in ((0, "s"), (1, "t"))]
    dictionary = written(words.groupBy("word").agg(*uses).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    known = words.join(dictionary.select("word", "id"), "word")
    if n_to == 1:  # a tuple of one word has the word's number
        return known.select("side", "block", "at", F.array("id").alias("tuple"), "n"), dictionary
    known = known.select("side", "block", F.col("at").alias("place"), "id")
    places = blocks.where("kind = 'tuple'").select("side", "block", "at", "n", F.posexplode("words").alias("k", "place"))
    ids = places.join(known, ["side", "block", "place"]).groupBy("side", "block", "at", "n")
    return ids.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("tuple")).select("side", "block", "at", "tuple", "n"), dictionary


def hashed(tuples: DataFrame, dictionary: DataFrame, buckets: int, n_to: int) -> DataFrame:
    """tuple, its bucket, s and t: every distinct tuple once, its bytes put together from the dictionary."""
    if n_to == 1:  # a tuple of one word is used as often as the word
        spelled = dictionary.select(F.array("id").alias("tuple"), F.col("word").alias("bytes"), "s", "t")
    else:
        uses = tuples.groupBy("tuple").agg(*(F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)).alias(name) for side, name in ((0, "s"), (1, "t"))))
        parts = uses.select("tuple", "s", "t", F.posexplode("tuple").alias("k", "id")).join(dictionary.select("word", "id"), "id")
        spelled = parts.groupBy("tuple", "s", "t").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("p"))
        spelled = spelled.withColumn("bytes", F.aggregate(F.slice("p", 2, n_to), F.col("p")[0]["word"], lambda a, x: F.concat(a, F.lit(b" "), x["word"])))
    return spelled.select("tuple", F.pmod(F.crc32("bytes"), F.lit(buckets)).cast("int").alias("bucket"), "s", "t")


def gains(counts: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain, of the buckets that have a feature. counts: bucket, s, t; at most `buckets` rows come out."""
    sums = counts.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    whole = sums.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    gain = F.floor(F.lit(1000.0) * F.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))
    return sums.join(F.broadcast(whole)).select("bucket", gain.cast("long").alias("gain"))


def weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", n_from: int = 1, n_to: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """id, n_features, n_words and weight of every document."""
    sides = [blocks_of(docs, key, text, n_from, n_to).withColumn("side", F.lit(0)), blocks_of(target, None, text, n_from, n_to).withColumn("side", F.lit(1))]
    parts = [written(side, "blocks") for side in sides]
    tuples, dictionary = tuples_of(parts[0].unionByName(parts[1]), n_to)
    tuples = written(tuples, "tuples")
    distinct = written(hashed(tuples, dictionary, buckets, n_to), "distinct")
    # at most one row a bucket
    valued = distinct.select("tuple", "bucket").join(F.broadcast(gains(distinct, buckets)), "bucket").select("tuple", "gain")
    of_blocks = tuples.where("side = 0").join(valued, "tuple").select("block", "at", "gain")

    def meet(documents: pa.Table, values: pa.Table) -> pa.Table:
        gain = np.zeros(values.num_rows, np.int64)
        gain[values.column("at").to_numpy()] = values.column("gain").to_numpy()
        uses, sums = [], []
        for data in documents.column("features"):
            found, counts = unpacked(data.as_py())
            uses.append(counts.sum())
            sums.append((gain[found] * counts).sum())
        columns = [documents.column("id"), pa.array(uses, pa.int64()), documents.column("n"), pa.array(sums, pa.int64())]
        return pa.table(columns, names=["id", "n_features", "n_words", "weight"])

    documents = parts[0].where("kind = 'doc'").select("block", "id", "n", "features")
    out = documents.groupBy("block").cogroup(of_blocks.groupBy("block")).applyInArrow(meet, "id long, n_features long, n_words long, weight long")
    out = written(out, "weights")
    dropped(*parts, tuples, dictionary, distinct)
    return out


def drawn(rows: DataFrame, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = DRAWN_PERCENT) -> DataFrame:
    """rows with score and rank: the percent of documents of enough words that score highest, ties to the smaller id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = written(rows.withColumn("score", F.col("weight") + noise), "scores")
    enough = rows.where(F.col("n_words") >= least_words)
    many = enough.count() * percent // 100
    placed = enough.orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "weight", "n_words")
    placed = written(placed.withColumn("place", F.monotonically_increasing_id()), "places")
    part = F.shiftright("place", 33)
    # one row a partition of the sort
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, before = [], 0
    for number, n in sizes:
        starts.append((number, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "part long, before long")
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ranked.withColumn("rank", F.when(rank <= many, rank)).select(*rows.columns, "rank")
    return ranked.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark's words."""
    rows = drawn(weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return rows.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 by its table, a fold over a word's bytes: DuckDB has no function for it.
ORACLE_SQL = r"""
WITH RECURSIVE crc(i, k, c) AS (
  SELECT i, 0, i FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8
), crcs AS (SELECT list(c ORDER BY i) AS crcs FROM crc WHERE k = 8
), d AS (
  SELECT doc_id, 0 AS side, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), uses AS (
  SELECT doc_id, side, unnest(words) AS word FROM d UNION ALL SELECT NULL, 1, unnest(words) FROM b
), counted AS (SELECT word, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM uses GROUP BY word
), bytes AS (
  SELECT word, s, t, list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(encode(word)), (2 * i - 1)::BIGINT, 2))::BIGINT) AS raw FROM counted
), hashed AS (
  SELECT word, s, t, xor(list_reduce(raw, lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM bytes, crcs
), sums AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket
), valued AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS gain FROM sums
), weighed AS (
  SELECT doc_id, sum(gain)::BIGINT AS weight FROM uses JOIN hashed USING (word) JOIN valued USING (bucket) WHERE side = 0 GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(len(words), 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN weighed ON d.doc_id = weighed.doc_id
), ranked AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM ranked
"""
