"""Embedding by a provider that may fail: patience with outages, and one bad text fails alone.

A provider has embed(texts), one vector a text in order, and retryable(error): whether the same call
may work later. Tasks call it with batches of their own rows. A batch that is refused for good is
halved until single texts remain, so a text that the provider can't take costs a logarithm of calls
and fails with its reason; the others get their vectors. An outage that outlasts the retries leaves
the rest of the task's rows pending: the next run takes them up. A provider that returns another
number of vectors than texts is refused, as nobody knows whose they are.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol, TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts of a call, and code points of a stored reason.
BATCH, MOST_REASON = 64, 500
Got = TypeVar("Got")


class Miscounted(RuntimeError):
    """Another number of vectors than texts."""


class Provider(Protocol):
    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...

    def retryable(self, error: Exception) -> bool: ...


@dataclass(frozen=True)
class Patience:
    """Attempts of a call, and the seconds between them: up to first * 2^n, `most` at most, drawn anew each time."""

    attempts: int
    first: float
    most: float

    def call(self, attempt: Callable[[], Got], retryable: Callable[[Exception], bool], sleep: Callable[[float], None] = time.sleep) -> Got:
        """What an attempt returns; the last error is raised as it is, and one that no retry mends at once."""
        for n in range(self.attempts):
            try:
                return attempt()
            except Exception as error:
                if n + 1 == self.attempts or not retryable(error):
                    raise
            sleep(random.uniform(0, min(self.most, self.first * 2**n)))
        raise ValueError("patience needs an attempt")


#: A build waits for a provider, a reader doesn't.
BUILDING, READING = Patience(5, 1.0, 30.0), Patience(2, 0.2, 0.5)


def degenerate(vector: Sequence[float], dim: int) -> str | None:
    """Why a vector can't be stored."""
    x = np.asarray(vector, np.float64)
    if x.shape != (dim,):
        return f"the declared space has {dim} dimensions, the vector {x.size}"
    return None if np.isfinite(x).all() and x.any() else "empty, all zero or not finite"


def isolated(texts: Sequence[str], provider: Provider, dim: int, patience: Patience = BUILDING, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[str, np.ndarray | None, str | None]]:
    """Of each text in order: status (embedded, failed or pending), the normalised vector, the reason of a failure."""
    down = False

    def of(part: Sequence[str]) -> Iterator[tuple[str, np.ndarray | None, str | None]]:
        nonlocal down
        if down:
            yield from (("pending", None, None) for _ in part)
            return
        try:
            vectors = patience.call(lambda: provider.embed(part), provider.retryable, sleep)
        except Exception as error:
            if provider.retryable(error):
                down = True
                yield from of(part)
            elif len(part) == 1:
                yield "failed", None, str(error)[:MOST_REASON]
            else:
                half = len(part) // 2
                yield from of(part[:half])
                yield from of(part[half:])
            return
        if len(vectors) != len(part):
            raise Miscounted(f"{len(vectors)} vectors for {len(part)} texts")
        for vector in vectors:
            problem = degenerate(vector, dim)
            x = np.asarray(vector, np.float64)
            yield ("failed", None, problem) if problem else ("embedded", x / np.linalg.norm(x), None)

    for at in range(0, len(texts), BATCH):
        yield from of(texts[at : at + BATCH])


def drained(rows: DataFrame, provider: Provider, dim: int, text: str = "input", patience: Patience = BUILDING) -> DataFrame:
    """rows with embedding, embedding_status and embed_error. The provider goes to the tasks, so it must pickle. A null text is an empty one."""
    own = ("embedding", "embedding_status", "embed_error")
    rest = [f for f in rows.schema.fields if f.name not in own]
    schema = T.StructType([*rest, T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("embedding_status", T.StringType()), T.StructField("embed_error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(isolated([t or "" for t in batch.column(text).to_pylist()], provider, dim, patience))
            status, vectors, reasons = ([f[k] for f in found] for k in range(3))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array([None if v is None else v.tolist() for v in vectors], pa.list_(pa.float64())), pa.array(status, pa.string()), pa.array(reasons, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)
