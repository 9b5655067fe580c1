"""Stored lexemes: an inverted index with places, in buckets of terms, written by a build and read by bucket.

A row is a term in a block of chunks: the chunks that have it, and its places there. A block is what a
task cuts at once, so a term of many chunks is few rows. Rows lie in folders by bucket, a hash of the
term, sorted by term in each file, so a query opens the folders of its terms only and skips the
row groups of other terms. A term that most chunks hold is many rows: they are dealt to as many files
as they need, whatever their bucket.

Defined cases: a null text has no rows. Rows that repeat a key are one chunk: their places meet in one
map and the last wins, so keys should be distinct. A query of no words finds nothing; words that the
configuration drops (stop words) neither ask nor exclude, and leave their gap in a phrase.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import files
from ..config import POOL_PER_ARM
from ..functions.lexemes import lexeme
from ..functions.text import tokens
from .search import cover_of, parse_websearch

BUCKETS = 64
#: Words that a task works on at once, besides a longer single chunk, and whose lexemes it remembers.
BLOCK_WORDS, REMEMBERED = 1 << 20, 500_000


class Mismatch(ValueError):
    """The stored lexemes are of another configuration than the one declared."""


def _runs(lists: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices (begin, rows) of about BLOCK_WORDS list values, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(lists):
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_WORDS, side="right"))
        end = max(end, at + 1)
        yield at, end - at
        at = end


def postings(chunks: DataFrame, config: str, key: str = "chunk_id", content: str = "content") -> DataFrame:
    """term, key, starts, places: a row for each lexeme of each block of chunks. No shuffle.

    key: the block's chunks that have the lexeme; places: its places in them (from 0, ascending), one chunk
    after the other; starts: where each chunk's begin.
    """
    lexeme("", config)  # an unknown configuration fails here
    words = chunks.where(F.col(content).isNotNull()).select(F.col(key).cast("long").alias("key"), tokens(F.col(content)).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        for batch in batches:
            for at, many in _runs(batch.column("words")):
                part = batch.slice(at, many)
                words, counts = part.column("words").flatten(), pc.list_value_length(part.column("words")).to_numpy()
                coded = words.dictionary_encode()
                # each distinct word of the block is looked up once; words with one lexeme share its number
                numbers: dict[str, int] = {}
                if len(known) > REMEMBERED:
                    known.clear()
                lexemes = np.empty(len(coded.dictionary), np.int64)
                for i, word in enumerate(coded.dictionary.to_pylist()):
                    if word not in known:
                        known[word] = lexeme(word, config)
                    term = known[word]
                    lexemes[i] = -1 if term is None else numbers.setdefault(term, len(numbers))
                term = lexemes[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(many), counts)
                place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
                # uses by lexeme and chunk, their places ascending as the sort is stable
                pair = term * many + owner
                uses = np.flatnonzero(term >= 0)
                uses = uses[np.argsort(pair[uses], kind="stable")]
                first = np.flatnonzero(np.diff(pair[uses], prepend=-1))
                of = term[uses[first]]
                head = np.flatnonzero(np.diff(of, prepend=-1))
                begin = np.append(first[head], len(uses)).astype(np.int32)
                chunk = np.append(head, len(first)).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(chunk), part.column("key").take(pa.array(owner[uses[first]])))
                starts = pa.ListArray.from_arrays(pa.array(chunk), pa.array((first - np.repeat(begin[:-1], np.diff(chunk))).astype(np.int32)))
                places = pa.ListArray.from_arrays(pa.array(begin), pa.array(place[uses].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.string()).take(pa.array(of[head])), keys, starts, places], ["term", "key", "starts", "places"])

    return words.mapInArrow(run, "term string, key array<long>, starts array<int>, places array<int>").withColumnRenamed("key", key)


def write(rows: DataFrame, folder: str, config: str, buckets: int = BUCKETS) -> None:
    """Stores postings in a new folder, and last what they are: a folder without that is no index."""
    spark = rows.sparkSession
    # rebalanced: a bucket that is too large for one task is split
    dealt = rows.withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int")).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", "term").write.mode("errorifexists").partitionBy("bucket").parquet(folder)
    key = next(c for c in rows.columns if c not in ("term", "starts", "places"))
    files.create(spark, f"{folder}/_index.json", json.dumps({"config": config, "buckets": buckets, "key": key}))


class Index:
    """A stored index, opened for the declared configuration."""

    def __init__(self, spark: SparkSession, folder: str, declared: str) -> None:
        about = json.loads(files.read_text(spark, f"{folder}/_index.json"))
        if about["config"] != declared:
            raise Mismatch(f"lexemes are stored as {about['config']!r}, {declared!r} is declared: rebuild or change the declaration")
        self.spark, self.folder, self.config, self.buckets, self.key = spark, folder, about["config"], about["buckets"], about["key"]

    def rows(self, terms: list[str]) -> DataFrame:
        """term, key, places: a row for each of these terms in a chunk; opens their buckets' folders only."""
        folders = [f"{self.folder}/bucket={b}" for b in sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})]
        folders = [f for f in folders if files.exists(self.spark, f)]
        if not folders:
            return self.spark.createDataFrame([], f"term string, {self.key} long, places array<int>")
        packed = self.spark.read.schema(f"term string, {self.key} array<long>, starts array<int>, places array<int>").parquet(*folders).where(F.col("term").isin(terms))

        def one(key: Column, i: Column) -> Column:
            start = F.get("starts", i)
            return F.struct(key.alias(self.key), F.slice("places", start + 1, F.coalesce(F.get("starts", i + 1), F.size("places")) - start).alias("places"))

        return packed.select("term", F.explode(F.transform(self.key, one)).alias("_use")).select("term", "_use.*")

    def asked(self, query: str) -> list[list[tuple[bool, list[tuple[str, int]]]]]:
        """Alternatives of (excluded, lexemes with their offsets) as the configuration has them; terms without a lexeme go."""
        out = []
        for terms in parse_websearch(query):
            found = []
            for t in terms:
                words = [(lexeme(w, self.config), i) for i, w in enumerate(t.lstrip("-").strip('"').split())]
                kept = [(w, i) for w, i in words if w is not None]
                if kept:
                    found.append((t.startswith("-"), kept))
            if found:
                out.append(found)
        return out

    def hits(self, query: str, chunks: DataFrame | None = None) -> DataFrame:
        """key and rank of the chunks that meet a websearch query.

        chunks: what may be found (key). Needed where an alternative only excludes, as such a one
        finds what has no row here.
        """
        asked = self.asked(query)
        terms = sorted({w for one in asked for _, words in one for w, _ in words})
        if not terms:
            return self.spark.createDataFrame([], f"{self.key} long, rank double")
        # a row for each of the query's words in a chunk
        found = self.rows(terms).groupBy(self.key).agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
        if chunks is not None:
            excluding = any(all(out for out, _ in one) for one in asked)
            found = chunks.select(self.key).join(found, self.key, "left" if excluding else "inner")
            found = found.withColumn("at", F.coalesce("at", F.create_map().cast("map<string,array<int>>")))
        meets, rank = F.lit(False), F.lit(0.0)
        for one in asked:
            all_ = F.lit(True)
            for out, words in one:
                all_ = all_ & (~_has(words) if out else _has(words))
            wanted = list(dict.fromkeys(w for out, words in one if not out for w, _ in words))
            meets = meets | all_
            if wanted:
                rank = rank + F.when(all_, cover_of(_places(wanted), len(wanted))).otherwise(0.0)
        return found.where(meets).select(self.key, F.round(rank, 9).alias("rank"))

    def arm(self, query: str, chunks: DataFrame | None = None, k: int = POOL_PER_ARM) -> DataFrame:
        """The k best chunks for a websearch query: key, rank, r."""
        top = self.hits(query, chunks).orderBy(F.col("rank").desc(), self.key).limit(k)
        return top.withColumn("r", F.row_number().over(Window.orderBy(F.col("rank").desc(), self.key)))


def _of(term: str) -> Column:
    return F.coalesce(F.element_at(F.col("at"), F.lit(term)), F.array().cast("array<int>"))


def _has(words: list[tuple[str, int]]) -> Column:
    """Whether a chunk has a word, or the words of a phrase at their offsets."""
    (first, begin), rest = words[0], words[1:]
    if not rest:
        return F.coalesce(F.map_contains_key("at", F.lit(first)), F.lit(False))

    def here(place: Column) -> Column:
        found = F.lit(True)
        for word, offset in rest:
            found = found & F.array_contains(_of(word), (place + (offset - begin)).cast("int"))
        return found

    return F.exists(_of(first), here)


def _places(terms: list[str]) -> Column:
    """Places of the terms in order, as (term from 1, at)."""
    def of(term: str, number: int) -> Column:
        return F.transform(_of(term), lambda place: F.struct(place.alias("at"), F.lit(number).alias("term")))

    return F.array_sort(F.flatten(F.array(*[of(t, i) for i, t in enumerate(terms, 1)])))
