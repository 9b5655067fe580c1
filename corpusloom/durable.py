"""Intermediate tables in the folder that driver and executors share: they cut the lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from .files import delete


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only on a single machine that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='corpusloom-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, until the session ends."""
    return Scratch.of(df.sparkSession).keep(df)


class Scratch:
    """Owns durable tables: each goes by drop(), the rest at the end of the with block or by close()."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    _of: dict[str, Scratch] = {}

    @classmethod
    def of(cls, spark: SparkSession) -> Scratch:
        """The session's own: what functions return as DataFrames stays until the program ends."""
        name = spark.sparkContext.applicationId
        if name not in cls._of:
            own = cls._of[name] = cls(spark)

            def end() -> None:
                with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
                    own.close()

            atexit.register(end)
        return cls._of[name]

    def folder(self) -> str:
        """A new path that goes with the tables."""
        self.paths.append(f"{shared_folder(self.spark)}/durable-{uuid.uuid4().hex}")
        return self.paths[-1]

    def keep(self, df: DataFrame, **counted: Column) -> DataFrame:
        """df as a table; what `counted` aggregates while it is written is in the result's `counted`, without another job."""
        seen = Observation() if counted else None
        if seen is not None:
            df = df.observe(seen, *[c.alias(name) for name, c in counted.items()])
        path = self.folder()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        out.counted = seen.get if seen is not None else {}
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes what keep() returned, once nothing reads it any more."""
        path = df._scratch_path
        self.paths.remove(path)
        delete(self.spark, path)

    def close(self) -> None:
        while self.paths:
            delete(self.spark, self.paths.pop())

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()
