"""Embeddings: the contract that vectors must keep, a deterministic embedder for tests, and the pending queue."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())


def problem(vector: Column, dim: int) -> Column:
    """Why a vector can't be stored: null, another length, all zeros or a number that isn't finite; else null."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.expr("double('Infinity')")))
    return (
        F.when(vector.isNull(), "no vector")
        .when(F.size(vector) != dim, F.concat(F.lit(f"the declared space has {dim} dimensions, the vector "), F.size(vector).cast("string")))
        .when(odd | ~F.exists(vector, lambda x: x != 0), "empty, all zero or not finite")
    )


def normalized(vector: Column) -> Column:
    """The vector by its length; a zero vector as it is."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length == 0, vector).otherwise(F.transform(vector, lambda x: x / length))


def contracted(vector: Column, dim: int) -> Column:
    """The normalised vector; one that breaks the contract fails the job."""
    return F.when(problem(vector, dim).isNotNull(), F.raise_error(problem(vector, dim)).cast(VECTOR)).otherwise(normalized(vector))


def literal(vector: Column) -> Column:
    """A vector as text with eight decimals: what is stored elsewhere has this precision."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.8f", x)), ","), F.lit("]"))


@lru_cache(100_000)
def direction(model: str, dim: int, token: str) -> np.ndarray:
    """A token's direction: numbers from -1 to 1 by its digest."""
    blocks = (hashlib.sha256(f"{model} {dim} {b} {token}".encode()).digest() for b in range(-(-dim // 8)))
    return np.frombuffer(b"".join(blocks), ">u4")[:dim] / 2.0**32 * 2 - 1


def fake_embedder(model: str = "fake", dim: int = 64) -> Callable[[Column], Column]:
    """Bags of tokens: each token has a direction by its digest, a text is their sum. The same in every run; not normalised."""

    @F.pandas_udf(VECTOR)
    def embed(texts: pd.Series) -> pd.Series:
        # a little of one fixed direction, so that a text without tokens has a vector
        return pd.Series([None if t is None else sum((direction(model, dim, w) for w in re.findall("[a-z0-9]+", t.lower())), direction(model, dim, "") * 1e-6) for t in texts])

    return embed


def pending(chunks: DataFrame, sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks that wait for a vector, with their node's title, by source and ordinal."""
    keys = ["tenant_id", "generation"]
    titled = sources.select(*keys, "source_id", "node_id").join(nodes.select(*keys, "node_id", "title"), [*keys, "node_id"])
    return chunks.where("embedding_status = 'pending'").join(titled, [*keys, "source_id"]).orderBy("source_id", "ordinal")


def drained(rows: DataFrame, embed: Callable[[Column], Column], dim: int, text: str = "input") -> DataFrame:
    """rows with embedding, embedding_status and embed_error: one bad chunk fails alone, the others are embedded."""
    raw = rows.withColumn("_raw", embed(F.col(text)))
    bad = problem(F.col("_raw"), dim)
    return raw.select(*rows.columns, F.when(bad.isNull(), normalized(F.col("_raw"))).alias("embedding"), F.when(bad.isNull(), "embedded").otherwise("failed").alias("embedding_status"), bad.alias("embed_error"))
