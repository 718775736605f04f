"""Files by way of Hadoop's file system, so that any store that Spark reads will do; and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). One of our own only where none is set and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tidelog-"))
    return _own_dir[0]


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def listing(spark: SparkSession, folder: str) -> list[tuple[str, bool, int, int]]:
    """(name, is a folder, bytes, modified ms) in a folder, by name; nothing where there is none."""
    fs, p = _at(spark, folder)
    if not fs.exists(p):
        return []
    return sorted((s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))


def total_size(spark: SparkSession, folder: str) -> int:
    fs, p = _at(spark, folder)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def create_once(spark: SparkSession, path: str, data: bytes) -> bool:
    """Writes a file that must not exist yet; False if another writer was first."""
    fs, p = _at(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out.write(bytearray(data))
    out.close()
    return True


def read_bytes(spark: SparkSession, path: str, limit: int | None = None) -> bytes:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        part = stream if limit is None else spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, limit)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(part))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
