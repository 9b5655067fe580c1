"""Vectors stored by what they are made of: a text that was embedded once is looked up, not embedded again.

A vector is a function of its input, the model, the dimension and the intent (document or query), so
its key is their digest. A store belongs to one tenant and corpus: what another corpus has embedded
is never found. Rows are only ever appended, in a folder for each space and bucket of digests. An
append that fails halfway leaves whole files with right vectors, so it needs no commit; two writers
at once may store a vector twice, and one is taken. Each row names the run that made it, and a lookup
leaves out the runs that it is told to (abandoned ones).

Few digests are looked up by their own buckets and by pushed filters on the digest; many by an
equi-join on the digest, of distinct inputs only. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import files
from ..durable import Scratch
from ..functions import text as X

#: Digests of a lookup that go into the plan as a list; more are joined.
MOST_LISTED = 500
#: Hexadecimal digits of a bucket: sixteen folders, so that an append of few rows writes few files.
BUCKET_DIGITS = 1
SCHEMA = "digest string, vector array<double>, generation long"
INTENTS = ("document", "query")


class EmptyQuery(ValueError):
    """Nothing to embed."""


class VectorStore:
    """The vectors of one corpus in one space (model, dimension, intent) under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, tenant: str, corpus: str, model: str, dim: int, intent: str = "document") -> None:
        if intent not in INTENTS:
            raise ValueError(f"intent is one of {INTENTS}")
        if any(not name or "/" in name for name in (tenant, corpus)):
            raise ValueError("tenant and corpus name folders")
        self.spark, self.model, self.dim, self.intent = spark, model, dim, intent
        space = spark.range(1).select(F.sha2(F.lit(f"{len(model)}:{model}{dim}:{intent}"), 256)).first()[0]
        self.folder = f"{root.rstrip('/')}/{tenant}/{corpus}/space={space[:16]}"

    def digest(self, text: Column) -> Column:
        """The key of an input. The model's length stands before it, so that no two spaces share a key."""
        return F.sha2(F.concat(F.lit(f"{len(self.model)}:{self.model}{self.dim}:{self.intent}:"), text), 256)

    def rows(self) -> DataFrame:
        """All stored rows with their bucket; none where nothing was stored."""
        if not files.names(self.spark, self.folder):
            return self.spark.createDataFrame([], f"{SCHEMA}, bucket string")
        return self.spark.read.schema(f"{SCHEMA}, bucket string").parquet(self.folder)

    def known(self, digests: DataFrame, without: Iterable[int] = ()) -> DataFrame:
        """digest, vector and generation, once for each of the digests that is stored by another run than those of `without`."""
        asked = digests.select("digest").distinct()
        few = [r["digest"] for r in asked.limit(MOST_LISTED + 1).collect()]
        rows = self.rows()
        barred = sorted(set(without))
        if barred:
            rows = rows.where(~F.col("generation").isin(barred))
        bucket = F.substring("digest", 1, BUCKET_DIGITS)
        if len(few) <= MOST_LISTED:
            rows = rows.where(F.col("bucket").isin(sorted({d[:BUCKET_DIGITS] for d in few})) & F.col("digest").isin(few))
        else:
            rows = rows.join(asked.withColumn("bucket", bucket), ["bucket", "digest"], "left_semi")
        # equal keys have equal vectors; the least run makes reruns agree on whose it is
        return rows.groupBy("digest").agg(F.min(F.struct("generation", "vector")).alias("_r")).select("digest", "_r.vector", "_r.generation")

    def add(self, rows: DataFrame) -> None:
        """Appends digest, vector and generation, in ranges of digests, so that a file's statistics and filters leave row groups out."""
        out = rows.select("digest", "vector", F.col("generation").cast("long").alias("generation"), F.substring("digest", 1, BUCKET_DIGITS).alias("bucket"))
        spread = out.repartitionByRange("digest").sortWithinPartitions("digest")
        spread.write.mode("append").option("parquet.bloom.filter.enabled#digest", "true").partitionBy("bucket").parquet(self.folder)

    def embedded(self, rows: DataFrame, embed: Callable[[DataFrame], DataFrame], generation: int = 0, without: Iterable[int] = (), text: str = "input", scratch: Scratch | None = None) -> DataFrame:
        """rows with embedding, embedding_status, embed_error and carried_from (the run that made a found vector).

        embed: a table of inputs (input) with embedding, embedding_status and embed_error, such as
        `providers.drained` makes it. It gets each input once that isn't stored, however often rows
        repeat it. What it embeds is stored; what failed or is pending isn't, and is asked again next
        time. A null input is an empty text. Columns of these four names are replaced.
        """
        scratch = scratch or Scratch.of(self.spark)
        own = ("embedding", "embedding_status", "embed_error", "carried_from")
        kept = [c for c in rows.columns if c not in own]
        inputs = scratch.keep(rows.select(F.coalesce(text, F.lit("")).alias("input")).distinct().withColumn("digest", self.digest(F.col("input"))))
        found = scratch.keep(self.known(inputs, without))
        lack = inputs.join(found.select("digest"), "digest", "left_anti")
        # written before anything reads it, so that no input goes to the provider twice
        made = scratch.keep(embed(lack))
        new = made.where("embedding_status = 'embedded'")
        if not new.isEmpty():
            self.add(new.select("digest", F.col("embedding").alias("vector"), F.lit(generation).alias("generation")))
        status = F.lit("embedded"), F.lit(None).cast("string")
        old = found.select("digest", F.col("vector").alias("embedding"), status[0].alias("embedding_status"), status[1].alias("embed_error"), F.col("generation").alias("carried_from"))
        answers = old.unionByName(made.select("digest", *own[:3], F.lit(None).cast("long").alias("carried_from")))
        # rows that repeat one input are many on one side only, which adaptive execution splits
        key = "digest"
        while key in kept:
            key += "_"
        out = rows.select(*kept, self.digest(F.coalesce(text, F.lit(""))).alias(key)).join(answers.withColumnRenamed("digest", key), key)
        return out.select(*kept, *own)

    def asked(self, questions: DataFrame, embed: Callable[[DataFrame], DataFrame], text: str = "q") -> DataFrame:
        """questions with vector: normalised, and embedded unless some earlier question was the same. An empty one is refused.

        A question that can't be embedded has a null vector and its reason in embed_error.
        """
        if self.intent != "query":
            raise ValueError("questions are looked up in a store of queries")
        plain = questions.withColumn("_plain", X.normalized_query(F.coalesce(text, F.lit(""))))
        if not plain.where("_plain = ''").isEmpty():
            raise EmptyQuery("a question is empty: nothing to embed")
        out = self.embedded(plain, embed, text="_plain")
        return out.select(*questions.columns, F.col("embedding").alias("vector"), "embed_error")

    def dropped(self) -> None:
        """Deletes the space, once its model is no longer declared."""
        files.delete(self.spark, self.folder)
