"""Small files in Spark's file system."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    fs, path = file_system(spark, path)
    return fs.exists(path)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    fs, path = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, path = file_system(spark, path)
    stream = fs.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that isn't there yet, whole or not at all; False where it is there.

    The text is written beside the file and then takes its name. Of several that do so at once one
    succeeds: HDFS refuses to rename onto a file, and on a local disk a hard link is made.
    """
    jvm = spark.sparkContext._jvm
    fs, target = file_system(spark, path)
    fs.mkdirs(target.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            place = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            try:
                jvm.java.nio.file.Files.createLink(place(target), place(beside))
                return True
            except Exception as e:  # noqa: BLE001
                if "FileAlreadyExistsException" in str(e):
                    return False
                raise
        return bool(not fs.exists(target) and fs.rename(beside, target))
    finally:
        if fs.exists(beside):
            fs.delete(beside, False)


def delete(spark: SparkSession, path: str) -> None:
    fs, path = file_system(spark, path)
    fs.delete(path, True)
