"""The audit ledger: an append-only table by day, of who read what from which generation."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import files
from ..durable import Scratch

ACTIONS = ("search", "outline", "read", "abstain")
SCHEMA = "id bigint, created_at timestamp, tenant_id string, corpus_id string, generation bigint, actor string, action string, embedding_model string, chunk_policy string, instance_digest string, detail string"


def append(rows: DataFrame, path: str) -> bool:
    """Appends rows of the read actions; a failure is reported, and never fails the read. Columns that rows lack are null."""
    try:
        have = set(rows.columns)
        whole = rows.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in SCHEMA.split(", "))])
        whole.where(F.col("action").isin(*ACTIONS)).withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)
    except Exception:  # the ledger is best effort
        logging.getLogger(__name__).exception("the ledger could not be written")
        return False
    return True


class Ledger:
    """Rows of one process, written together: once `most` are there, or by flush()."""

    def __init__(self, spark: SparkSession, path: str, most: int = 1) -> None:
        self.spark, self.path, self.most, self.rows = spark, path, most, []

    def add(self, **row) -> bool:
        """Whether the rows so far are written or will be: an unknown action and a failed write are reported, not raised."""
        if row.get("action") not in ACTIONS:
            logging.getLogger(__name__).error("no read action: %r", row.get("action"))
            return False
        import datetime

        self.rows.append({"created_at": datetime.datetime.now(datetime.UTC), **row})
        return len(self.rows) < self.most or self.flush()

    def flush(self) -> bool:
        rows, self.rows = self.rows, []
        if not rows:
            return True
        names = [c.split()[0] for c in SCHEMA.split(", ")][1:]
        df = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA.split(", ", 1)[1])
        return append(df.coalesce(1).withColumn("id", F.xxhash64(F.uuid())), self.path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA + ", day date").parquet(path)


def recent(ledger: DataFrame, n: int, tenant: str | None = None, corpus: str | None = None) -> DataFrame:
    """The n latest rows, of a tenant and a corpus if named; ties by id."""
    for column, value in (("tenant_id", tenant), ("corpus_id", corpus)):
        ledger = ledger if value is None else ledger.where(F.col(column) == value)
    return ledger.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def days(spark: SparkSession, path: str) -> list[str]:
    """Days that have rows, the latest first."""
    return sorted((n.removeprefix("day=") for n in files.names(spark, path) if n.startswith("day=") and not n.endswith("__")), reverse=True)


def latest(spark: SparkSession, path: str, n: int, tenant: str, corpus: str | None = None) -> tuple[DataFrame, list[str]]:
    """The n latest rows of a tenant and the days that were opened for them: day by day back, until there are n."""
    opened, found = [], 0
    whole = lambda: spark.read.schema(SCHEMA + ", day date").option("basePath", path).parquet(*[f"{path}/day={d}" for d in opened])
    for day in days(spark, path):
        opened.append(day)
        rows = whole().where((F.col("tenant_id") == tenant) & (F.lit(True) if corpus is None else F.col("corpus_id") == corpus))
        found = rows.where(F.col("day") == day).limit(n).count() + found
        if found >= n:
            break
    return recent(whole() if opened else spark.createDataFrame([], SCHEMA + ", day date"), n, tenant, corpus), opened


def compacted(spark: SparkSession, path: str, day: str, files_a_day: int = 1) -> None:
    """Rewrites a closed day's files as few. The day is replaced when all is written; nobody may append to it meanwhile."""
    with Scratch(spark) as scratch:
        rows = scratch.keep(read(spark, path).where(F.col("day") == day))
        rows.coalesce(files_a_day).sortWithinPartitions("created_at").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
