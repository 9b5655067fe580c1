"""Near-duplicates by exact Jaccard similarity of five-word shingles: a prefix-filter join.

A text's shingles are put in one order that all texts share, the rarest first (by counts of hash
slots; any order gives the same result, a good one gives short buckets). Two texts of similarity s
share one of their first n - ceil(s n) + 1 shingles, n being the size of the set, so those are the
text's buckets and no pair is missed, whatever the number of documents. Pairs that sizes and places
in the order rule out are left; so are pairs whose parity sketches differ in more bits than the sets
may differ in shingles, which no pair of that similarity can. The rest is verified exactly.

No bucket's pairs are listed at first: a bucket has up to three leaders (least and greatest id, and
one by hash), and its documents are compared with those. The links found make groups. In buckets
with two documents or more that lead none, those of different groups are then compared with each other, whether
they have links or not; documents of one group need no more links. So no link between groups is
lost, and a large group of copies costs as many comparisons as it has members.

Defined cases: null texts are empty; texts without words are copies of each other and near nothing
else. Copies are found by digest. Of a group the least doc_id stays, of equal rows one. Rows with a
null doc_id are kept unless they copy a row with an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import TEXT_ROWS, blocks, buffers, dropped, small_batches, spread, written
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Slots that shingles are counted in, slots of a row of those counts, and bits of a parity sketch: the
#: short one, and the most of the wide one, which has a bit or more for each shingle up to there.
SLOTS, ROW, SKETCH, WIDEST = 1 << 18, 1 << 12, 512, 1 << 20


def _shingles(part: pa.RecordBatch, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, and where each text's begin (and the end)."""
    data, offsets = buffers(part.column(text))
    lower, starts, ends, first = hashing.word_spans(data, offsets)
    hashes, owner = hashing.shingle_hashes(hashing.span_hashes(lower, starts, ends), first, shingle)
    return hashes, np.searchsorted(owner, np.arange(part.num_rows + 1))


def commonness(df: DataFrame, text: str = "text", shingle: int = SHINGLE) -> np.ndarray:
    """How many shingles of all texts fall into each slot: 1 MB, however many the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in blocks(batch, text):
                hashes, _ = _shingles(part, text, shingle)
                total += np.bincount((hashes & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        if total.any():
            rows = [x.tobytes() for x in total.reshape(-1, ROW)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    out = np.zeros(SLOTS, np.int64)
    for r in df.select(text).mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect():
        out[r["part"] * ROW : (r["part"] + 1) * ROW] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def _parities(found: list[np.ndarray], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set a sketch of so many bits, as longs one after the other, and how many longs each has: a bit is whether an odd number of hashes falls on it."""
    ends = np.cumsum(bits)
    every = np.concatenate(found) if found else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
    bit = (ends - bits)[owner] + ((every >> np.uint64(40)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(bit, minlength=int(ends[-1]) if len(ends) else 0) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8"), bits // 64


def prints(df: DataFrame, common: np.ndarray, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """key, digest of the text, n (size of its set of shingles), fp and wide (short and wide parity sketch of the set, longs) and prefix (its rarest shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                data, offsets = buffers(part.column(text))
                digests = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
                hashes, at = _shingles(part, text, shingle)
                found = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:])]
                n = np.array([len(x) for x in found], np.int64)
                rarest = []
                for x in found:
                    order = np.lexsort((x, common[x & np.uint64(SLOTS - 1)]))
                    # rounding may lengthen a prefix, not shorten it
                    rarest.append(x[order[: len(x) - int(np.ceil(similarity * len(x) - 1e-6)) + 1]])
                wide = np.minimum(1 << np.ceil(np.log2(np.maximum(n, SKETCH))).astype(np.int64), WIDEST)
                lists = []
                for values, sizes in (_parities(found, np.full(len(n), SKETCH)), _parities(found, wide), (np.concatenate(rarest).view(np.int64), [len(x) for x in rarest])):
                    lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, pa.int64())))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(digests, pa.string()), pa.array(n.astype(np.int32)), *lists], [key, "digest", "n", "fp", "wide", "prefix"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, digest string, n int, fp array<long>, wide array<long>, prefix array<long>")


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _possible(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column, similarity: float) -> Column:
    """Whether sets of these sizes that share the shingle at these places can be so similar."""
    shared = F.least(pos_a, pos_b) + F.least(n_a - pos_a, n_b - pos_b)
    return (F.least(n_a, n_b) >= similarity * F.greatest(n_a, n_b) - 1e-6) & (shared >= similarity / (1 + similarity) * (n_a + n_b) - 1e-6)


def _sketched(n_a: Column, fp_a: Column, n_b: Column, fp_b: Column, similarity: float) -> Column:
    """Whether sets of these sizes and sketches can be so similar: a bit that differs takes a shingle that only one has."""
    return _distance(fp_a, fp_b) <= (1 - similarity) / (1 + similarity) * (n_a + n_b) + 1e-6


def _folded(fp: Column, longs: Column) -> Column:
    """A sketch of so many longs or of twice as many, as one of so many: its halves laid over each other."""
    return F.when(F.size(fp) > longs, F.zip_with(F.slice(fp, F.lit(1), longs), F.slice(fp, longs + 1, longs), lambda x, y: x.bitwiseXOR(y))).otherwise(fp)


def _jaccard(pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of pairs (a, b, text_a, text_b) those whose sets of shingles are so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text_a"):
                sides = [_shingles(part, t, shingle) for t in ("text_a", "text_b")]
                keep = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    x, y = (np.unique(hashes[at[i] : at[i + 1]]) for hashes, at in sides)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = both > 0 and both >= similarity * (len(x) + len(y) - both)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, pairs.select("a", "b").schema)


def _verified(pairs: DataFrame, known: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """Of candidate pairs (a, b: distinct ids) those near by their wide sketches and then by the exact Jaccard similarity.

    Sketches are 1/64 of the sets and leave few pairs beyond the near ones; only those pairs' texts
    meet, each hashed where the pair is.
    """
    sketch = known.select(F.col(key).alias("id"), "n", "wide")
    close = pairs.join(sketch.toDF("a", "n_a", "w_a"), "a").join(sketch.toDF("b", "n_b", "w_b"), "b")
    longs = F.least(F.size("w_a"), F.size("w_b"))
    ratio = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6
    # sizes so near have sketches of one length, or of twice it
    near = F.when(ratio & (F.greatest(F.size("w_a"), F.size("w_b")) <= 2 * longs), _sketched(F.col("n_a"), _folded(F.col("w_a"), longs), F.col("n_b"), _folded(F.col("w_b"), longs), similarity)).otherwise(ratio)
    close = written(close.where(near).select("a", "b"), "neardup-close")
    ids = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # the few texts that are needed; rows that repeat an id are one document here, with its least text
    texts = maybe_among(docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("t")), "id", ids)
    texts = texts.where(F.col("_maybe") & F.col("id").isNotNull()).groupBy("id").agg(F.min("t").alias("t"))
    # a table, so that the joins read shuffles on both sides: only then can Spark split a leader that many pairs share
    texts = written(texts, "neardup-texts")
    both = close.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    # two whole texts a row: few rows a batch
    with small_batches(docs.sparkSession):
        out = written(_jaccard(both, shingle, similarity), "neardup-verified")
    dropped(close, texts)
    return out


def _known(every: DataFrame, key: str) -> DataFrame:
    """One row of each text, with its least id. Rows of texts that stand alone are not shuffled."""
    copied = every.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("ids")).where("n > 1 or ids < 1").select(F.col("digest").alias("id"))
    marked = maybe_among(every, "digest", copied)
    columns = ("n", "fp", "wide", "prefix")
    alone = marked.where(~F.col("_maybe")).select("digest", key, *columns)
    # combined before the shuffle
    several = marked.where("_maybe").groupBy("digest").agg(F.min(key).alias(key), *[F.first(c).alias(c) for c in columns])
    return alone.unionByName(several).where(F.col(key).isNotNull())


def near_links(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """What is known of every row (key, digest), and near links (a, b) between the least ids of different texts."""
    docs_ = spread(docs)
    with small_batches(docs.sparkSession, TEXT_ROWS):
        every = written(prints(docs_, commonness(docs_, text, shingle), key, text, shingle, similarity), "neardup-prints")
    known = written(_known(every, key), "neardup-known")
    narrow = written(every.select(key, "digest"), "neardup-digests")
    dropped(every)
    # most buckets have one document: they are counted by their hash alone, and their rows are never shuffled
    shared = written(known.select(F.explode("prefix").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("id"), "neardup-shared")
    every_member = known.select(F.col(key).alias("id"), "n", F.posexplode("prefix").alias("pos", "bucket"))
    member = written(maybe_among(every_member, "bucket", shared).where("_maybe").drop("_maybe"), "neardup-member")
    dropped(shared)
    who = F.struct("id", "n", "pos")
    led = member.groupBy("bucket").agg(F.min(who).alias("l1"), F.max(who).alias("l2"), F.min(F.struct(F.xxhash64("id").alias("h"), who.alias("who"))).alias("l3"), F.count(F.lit(1)).alias("members")).where("members > 1")
    led = written(led.select("bucket", F.array_distinct(F.array("l1", "l2", "l3.who")).alias("leaders"), "members"), "neardup-led")
    met = member.join(led.select("bucket", "leaders").hint("shuffle_hash"), "bucket").select("id", "n", "pos", F.explode("leaders").alias("other"))
    met = met.where((F.col("id") != F.col("other.id")) & _possible(F.col("n"), F.col("pos"), F.col("other.n"), F.col("other.pos"), similarity))
    pairs = written(met.select(F.least("id", "other.id").alias("a"), F.greatest("id", "other.id").alias("b")).distinct(), "neardup-pairs")
    links = _verified(pairs, known, docs, key, text, shingle, similarity)
    # crowded buckets, where two documents have not met: documents of one group with those of another
    groups = components(links, "a", "b", "neardup-grouped").toDF("id", "group")
    crowd = member.join(led.where(F.col("members") > F.size("leaders") + 1).select("bucket"), "bucket", "left_semi").join(groups, "id", "left")
    crowd = written(crowd.withColumn("group", F.coalesce("group", "id")).join(known.select(F.col(key).alias("id"), "fp"), "id"), "neardup-crowd")
    dropped(groups, member, led)
    # a bucket's groups, then their members: pairs within a group are never made, others only where not ruled out
    ahead = [F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("pos").alias("most_pos"), F.max(F.col("n") - F.col("pos")).alias("most_rest"), F.count(F.lit(1)).alias("size"), F.first("fp").alias("fp_b")]
    met = crowd.join(crowd.groupBy("bucket", F.col("group").alias("group_b")).agg(*ahead), "bucket").where(F.col("group") < F.col("group_b"))
    overlap = F.least("pos", "most_pos") + F.least(F.col("n") - F.col("pos"), "most_rest")
    met = met.where((F.least("n", "most_n") >= similarity * F.greatest("n", "least_n") - 1e-6) & (overlap >= similarity / (1 + similarity) * (F.col("n") + F.col("least_n")) - 1e-6))
    met = met.where((F.col("size") > 1) | _sketched(F.col("n"), F.col("fp"), F.col("least_n"), F.col("fp_b"), similarity))
    met = met.select("bucket", "id", "n", "pos", "fp", "group_b").join(crowd.select("bucket", F.col("group").alias("group_b"), F.col("id").alias("other"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("fp").alias("fp_b")), ["bucket", "group_b"])
    met = met.where((F.col("id") != F.col("other")) & _possible(F.col("n"), F.col("pos"), F.col("n_b"), F.col("pos_b"), similarity) & _sketched(F.col("n"), F.col("fp"), F.col("n_b"), F.col("fp_b"), similarity))
    more = met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    more = written(more.join(pairs, ["a", "b"], "left_anti"), "neardup-more")
    dropped(crowd, pairs)
    if not more.isEmpty():
        links = links.unionByName(_verified(more, known, docs, key, text, shingle, similarity))
    dropped(known, more)
    return narrow, links


#: Bits of the filter that maybe_among broadcasts: 8 MB, however many the ids.
FILTER_BITS = 26


def maybe_among(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """df with _maybe: false only for rows whose key is certainly not in ids (column id). No shuffle of df.

    A Bloom filter of one hash: at most 2**FILTER_BITS / 32768 rows of 4 KB are broadcast.
    """
    place = F.xxhash64(F.lit("filter"), F.col(key)).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bits = ids.select(F.xxhash64(F.lit("filter"), F.col("id")).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("p"))
    bits = bits.groupBy(F.shiftright("p", 15).alias("_part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("_bits"))
    rows = df.withColumn("_place", place).withColumn("_part", F.shiftright("_place", 15)).join(F.broadcast(bits), "_part", "left")
    within = F.col("_place").bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(within, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.bit_get(byte, within.bitwiseAND(F.lit(7)).cast("int")) == 1
    return rows.withColumn("_maybe", F.coalesce(hit, F.lit(False)) | F.col(key).isNull()).drop("_place", "_part", "_bits")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of copies and near copies: the least id."""
    every, links = near_links(docs, key, text, shingle, similarity)
    groups = components(links, "a", "b", "neardup-groups")
    dropped(links)
    first = every.groupBy("digest").agg(F.min(key).alias(key))
    kept = written(first.join(groups.where(F.col("node") != F.col("component")).select(F.col("node").alias(key)), key, "left_anti"), "neardup-kept")
    dropped(groups)
    return remaining(docs, every, kept, key, text)


def remaining(docs: DataFrame, every: DataFrame, kept: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row for each of kept. every, kept: tables of key and digest of the text, of all rows and of those that stay. Few texts are shuffled."""
    # ids of rows that go, or that stand there more than once
    counted = every.groupBy(key, "digest").agg(F.count(F.lit(1)).alias("n"))
    stays = kept.select(F.col(key).alias("_key"), F.col("digest").alias("_kept"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_kept"))
    doubtful = counted.join(stays, same, "left").where(F.col("_kept").isNull() | (F.col("n") > 1)).select(F.col(key).alias("id")).where(F.col("id").isNotNull()).distinct()
    doubtful = written(doubtful, "neardup-doubtful")
    dropped(every)
    marked = maybe_among(docs, key, doubtful)
    certain = marked.where(~F.col("_maybe")).select(docs.columns)
    rest = marked.where("_maybe").select(*docs.columns, F.sha2(F.coalesce(text, F.lit("")), 256).alias("_digest"))
    rest = rest.join(stays, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_digest") == F.col("_kept")), "left_semi").dropDuplicates([key, "_digest"]).select(docs.columns)
    return certain.unionByName(rest)
