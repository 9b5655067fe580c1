"""Retrieval: vector and keyword arms, rank fusion, abstention, response packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import MIN_CONTENT_CHARS, POOL_PER_ARM, RRF_K
from ..functions.text import dense_length, tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; divides by the norms, so vectors needn't be normalised."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def searchable(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Prose with enough in it: what the arms may return. Where a build stored dense_length, no text is read."""
    length = F.col("dense_length") if "dense_length" in chunks.columns else dense_length(F.col(content))
    return chunks.where((F.col("source_type") == "prose") & (length >= MIN_CONTENT_CHARS))


def vector_arm(chunks: DataFrame, query: list[float], k: int = POOL_PER_ARM, key: str = "chunk_id") -> DataFrame:
    """The k nearest chunks: key, sim, r. Limits first and numbers the k rows after."""
    top = chunks.select(key, cosine(F.col("embedding"), F.lit(query)).alias("sim")).orderBy(F.col("sim").desc(), key).limit(k)
    return top.withColumn("r", F.row_number().over(Window.orderBy(F.col("sim").desc(), key)))


#: Vectors of a block: a matrix product takes two blocks.
QUERY_BLOCK, CHUNK_BLOCK = 256, 4096


def _blocks(rows: DataFrame, key: str, vector: str, size: int, names: tuple[str, str]) -> DataFrame:
    """Rows in blocks: ids and their normalised vectors, one after the other, as bytes."""
    ids, data = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = np.stack([np.asarray(v, np.float64) for v in part.column(vector).to_pylist()])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(key).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], [ids, data])

    return rows.select(F.col(key).cast("long").alias(key), vector).where(F.col(vector).isNotNull()).mapInArrow(run, f"{ids} array<long>, {data} binary")


def search_many(chunks: DataFrame, queries: DataFrame, k: int = POOL_PER_ARM, key: str = "chunk_id", leave_out: bool = False) -> DataFrame:
    """The k nearest chunks of each query (qid, vector): qid, key, sim, r. leave_out: none is its own (qid = key).

    Queries and chunks meet block by block, each pair of blocks a matrix product of which k rows a query
    are left; nothing comes to the driver, and the queries may be a share of the chunks.
    """
    spread = queries.sparkSession.sparkContext.defaultParallelism
    asked = _blocks(queries.coalesce(max(1, spread // 4)), "qid", "vector", QUERY_BLOCK, ("qids", "q"))
    known = _blocks(chunks, key, "embedding", CHUNK_BLOCK, ("ids", "c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one pair of blocks at a time, read where the batch holds it
            for i in range(batch.num_rows):
                qids, ids = (batch.column(c)[i].values.to_numpy() for c in ("qids", "ids"))
                q, c = (np.frombuffer(batch.column(c)[i].as_buffer()) for c in ("q", "c"))
                sims = q.reshape(len(qids), -1) @ c.reshape(len(ids), -1).T
                if leave_out:
                    sims[qids[:, None] == ids[None, :]] = -np.inf
                # rounded, so that equal vectors tie whatever their block
                sims = np.round(sims, 12)
                best = np.lexsort((np.broadcast_to(ids, sims.shape), -sims))[:, :k]
                row = np.repeat(np.arange(len(qids)), best.shape[1])
                best = best.ravel()
                keep = np.isfinite(sims[row, best])
                yield pa.RecordBatch.from_arrays([pa.array(qids[row][keep]), pa.array(ids[best][keep]), pa.array(sims[row, best][keep])], ["qid", key, "sim"])

    # a stated set of queries against all chunks, in blocks
    pairs = known.crossJoin(asked).mapInArrow(run, f"qid long, {key} long, sim double")
    window = Window.partitionBy("qid").orderBy(F.col("sim").desc(), key)
    return pairs.withColumn("r", F.row_number().over(window)).where(F.col("r") <= k)


def has_all_terms(terms_of_text: Column, terms: list[str]) -> Column:
    """The conjunction of websearch terms; - excludes, a phrase in quotes is its words in a row."""
    found = F.lit(True)
    for t in terms:
        out = t.startswith("-")
        words = t.lstrip("-").strip('"').split()
        if len(words) == 1:
            one = F.array_contains(terms_of_text, words[0])
        else:
            n = F.size(terms_of_text)
            one = F.when(n >= len(words), F.exists(F.sequence(F.lit(1), F.greatest(n - len(words) + 1, F.lit(1))), lambda i: F.slice(terms_of_text, i, len(words)) == F.array(*map(F.lit, words)))).otherwise(False)
        found = found & (~one if out else one)
    return found


def parse_websearch(query: str) -> list[list[str]]:
    """Alternatives (or) of conjunctions of terms: words, "phrases" and -exclusions."""
    import re

    out: list[list[str]] = [[]]
    for t in re.findall(r'-?"[^"]*"|\S+', query.lower()):
        if t == "or":
            out.append([])
        elif re.search(r"[^\W_]", t):
            out[-1].append(t)
    return [terms for terms in out if terms]


def matches(words: Column, query: str) -> Column:
    """Whether a text's words meet a websearch query."""
    found = F.lit(False)
    for terms in parse_websearch(query):
        found = found | has_all_terms(words, terms)
    return found


def _wanted(terms: list[str]) -> list[str]:
    """The words that a conjunction asks for, each once; exclusions ask for none."""
    return list(dict.fromkeys(w for t in terms if not t.startswith("-") for w in t.strip('"').split()))


def cover_density(words: Column, terms: list[str]) -> Column:
    """Cover-density rank: each shortest stretch that holds all terms adds weight by how little else it holds.

    A cover of the n terms from word p to word q adds 0.1 / (1 + the words in it beyond n); covers don't
    nest. One fold over the places of the terms.
    """
    listed = F.array(*map(F.lit, terms))
    places = F.filter(F.transform(words, lambda w, i: F.struct(F.array_position(listed, w).alias("term"), i.alias("at"))), lambda h: h["term"] > 0)
    return cover_of(places, len(terms))


def cover_of(places: Column, n: int) -> Column:
    """The cover density of n terms by their places (term from 1, at), in order of at."""
    start = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(-1).alias("done"), F.lit(0.0).alias("total"))

    def step(state: Column, hit: Column) -> Column:
        last = F.transform(state["last"], lambda x, j: F.when(j + 1 == hit["term"], hit["at"]).otherwise(x))
        first = F.array_min(last)
        covers = (first >= 0) & (first > state["done"])
        gain = F.when(covers, 0.1 / (2 + hit["at"] - first - n)).otherwise(0.0)
        return F.struct(last.alias("last"), F.when(covers, first).otherwise(state["done"]).alias("done"), (state["total"] + gain).alias("total"))

    return F.aggregate(places, start, step)["total"]


def websearch_rank(words: Column, query: str) -> Column:
    """Cover density of the alternatives that a text meets, added up; to nine digits, so that equal sums tie."""
    total = F.lit(0.0)
    for terms in parse_websearch(query):
        wanted = _wanted(terms)
        if wanted:
            total = total + F.when(has_all_terms(words, terms), cover_density(words, wanted)).otherwise(0.0)
    return F.round(total, 9)


def keyword_hits(chunks: DataFrame, query: str, key: str = "chunk_id", content: str = "content") -> DataFrame:
    """key and rank of all chunks that meet a websearch query."""
    alternatives = [_wanted(terms) for terms in parse_websearch(query)]
    # texts without the letters of a word can't have the word: looked for before texts are cut into words
    likely = F.lit(False)
    for wanted in alternatives:
        one = F.lit(True)
        for w in wanted:
            one = one & F.contains(F.lower(content), F.lit(w))
        likely = likely | one
    hits = chunks.where(likely).select(key, tokens(F.col(content)).alias("words")).where(matches(F.col("words"), query))
    return hits.select(key, websearch_rank(F.col("words"), query).alias("rank"))


def keyword_arm(chunks: DataFrame, query: str, k: int = POOL_PER_ARM, key: str = "chunk_id", content: str = "content") -> DataFrame:
    """The k best chunks for a websearch query by cover density: key, rank, r."""
    top = keyword_hits(chunks, query, key, content).orderBy(F.col("rank").desc(), key).limit(k)
    return top.withColumn("r", F.row_number().over(Window.orderBy(F.col("rank").desc(), key)))


def fuse(arms: list[DataFrame], key: str = "chunk_id", c: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: key and score = sum of 1 / (c + r) over the arms (key, r)."""
    rows = arms[0].select(key, "r")
    for arm in arms[1:]:
        rows = rows.unionByName(arm.select(key, "r"))
    return rows.groupBy(key).agg(F.sum(1.0 / (c + F.col("r"))).alias("score"))


def hybrid(chunks: DataFrame, vector: list[float], query: str, k: int, key: str = "chunk_id", content: str = "content", index=None) -> DataFrame:
    """The k best chunks by fused rank, each with the best vector similarity of the whole answer.

    chunks: what may be served. Each arm reads only its own columns and leaves POOL_PER_ARM rows.
    index: the stored lexemes; without them the texts are cut into words.
    """
    near = vector_arm(chunks.select(key, "embedding"), vector, key=key)
    words = keyword_arm(chunks.select(key, content), query, key=key, content=content) if index is None else index.arm(query, chunks.select(key))
    fused = fuse([near, words], key)
    top = near.agg(F.max("sim").alias("top_vec_sim"))
    return fused.orderBy(F.col("score").desc(), key).limit(k).crossJoin(F.broadcast(top))  # the other side is one row


#: What a hit of an answer has, in order; the best vector similarity of the answer stands last.
HIT = ("chunk_id", "source_id", "heading_path_text", "content", "node_id", "stable_id", "slug", "permalink", "score", "top_vec_sim")


def projected(hits: DataFrame) -> DataFrame:
    """hits with the columns of HIT in order. Others, or a similarity of another type than double, are refused: a gate must not read them as no signal."""
    if sorted(hits.columns) != sorted(HIT):
        raise TypeError(f"hits have the columns {hits.columns}, an answer has {list(HIT)}")
    if hits.schema["top_vec_sim"].dataType.simpleString() != "double":
        raise TypeError(f"top_vec_sim is {hits.schema['top_vec_sim'].dataType.simpleString()}, not double")
    top = F.when(F.isnan("top_vec_sim"), F.raise_error(F.lit("top_vec_sim is no number")).cast("double")).otherwise(F.col("top_vec_sim"))
    return hits.withColumn("top_vec_sim", top).select(*HIT)


def abstains(top: Column, floor: float | str | None) -> Column:
    """Whether an answer must be withheld: no floor, never; else without a score or under the floor."""
    if floor == "uncalibrated":
        raise ValueError("the corpus isn't calibrated")
    return F.lit(False) if floor is None else top.isNull() | (top < floor)


def keyword_abstains(top: Column, floor: float | None) -> Column:
    return top.isNull() if floor is None else top.isNull() | (top < floor)


def clamp_k(k: int, most: int = 50) -> int:
    return max(1, min(k, most))


def packed(hits: DataFrame, budget: int, query: str = "qid", order: str = "r", size: str = "chars") -> DataFrame:
    """Hits that ship: in rank order a hit that would overflow is left out, the first always ships.

    A query has at most 50 hits, so the fold is over a short array.
    """
    kept = hits.columns
    rows = hits.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(order, size, *[c for c in kept if c not in (query, order, size)]))).alias("hits"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("ships"))

    def step(acc: Column, i: Column) -> Column:
        n = F.get("hits", i)[size].cast("long")
        ships = (i == 0) | (acc["used"] + n <= budget)
        return F.struct((acc["used"] + F.when(ships, n).otherwise(0)).alias("used"), F.when(ships, F.concat(acc["ships"], F.array(i))).otherwise(acc["ships"]).alias("ships"))

    rows = rows.withColumn("ships", F.aggregate(F.sequence(F.lit(0), F.size("hits") - 1), start, step)["ships"])
    return rows.select(query, F.explode("ships").alias("i"), "hits").select(query, F.get("hits", F.col("i")).alias("h")).select(query, "h.*")
