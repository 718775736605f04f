"""What the corpus operators share: shared-folder tables, white space, sizes, components."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import saved, shared_dir
from ..operators.joins import join_hot

__all__ = ["join_hot", "saved", "shared_dir"]

#: The white space that the contracts name: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Ids that a broadcast may hold (16 MB); beyond it joins shuffle.
BROADCAST_IDS = 1_000_000

#: What an operator keeps in a Python worker between tasks, by the operator's name: how to let it go.
kept: dict[str, Callable[[], None]] = {}


def alone(owner: str) -> None:
    """Called as a task of owner begins: a worker serves operators in turn, and what others keep in it goes."""
    for name in [n for n in kept if n != owner]:
        kept.pop(name)()


def release() -> None:
    """Gives memory that is free in this worker back to the system: idle workers count while other stages run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def task_of(owner: str):
    """For a function of batches that runs in a worker: others' things go as it begins, free memory as it ends."""

    def of(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
        @wraps(run)
        def task(batches: Iterator) -> Iterator:
            alone(owner)
            release()
            try:
                yield from run(batches)
            finally:
                release()

        return task

    return of


def trim_heaps(spark: SparkSession) -> None:
    """Has the JVM of each executor collect its garbage and give back the heap that falls free.

    A heap keeps the size that the hungriest stage before gave it, which counts beside the Python
    workers of the next one. A task for each slot calls System.gc(); results never depend on it.
    """
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(name: str = "doc_id") -> Column:
    """True for rows that no model may learn from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def parts(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))


def broadcastable(rows: int) -> bool:
    """Whether a side of so many rows of ids or numbers may be broadcast."""
    return rows <= BROADCAST_IDS


def only_ids(df: DataFrame, ids: DataFrame, keep: bool, count: int) -> DataFrame:
    """Rows of df whose doc_id is (keep) or is not in ids; ids are broadcast up to BROADCAST_IDS, shuffled beyond."""
    side = F.broadcast(ids) if broadcastable(count) else ids
    return df.join(side, "doc_id", "left_semi" if keep else "left_anti")


def components(edges: DataFrame, name: str = "cc", a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of undirected edges; component is the least node reached.

    Alternating large-star and small-star rounds, each written to the shared folder: a number of
    rounds that grows with the logarithm of the longest path, and never a component in one task;
    the edges of a hub are joined where they lie.
    """
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    ends = lambda p, q: F.explode(F.array(F.struct(F.col(p).alias("v"), F.col(q).alias("u")), F.struct(F.col(q).alias("v"), F.col(p).alias("u")))).alias("e")
    cur, before = saved(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("v < u").distinct(), name), None
    while True:
        both = cur.select(ends("v", "u")).select("e.*")
        least = both.groupBy("v").agg(F.min("u").alias("m0"), F.count("*").alias("rows")).select("v", F.least("v", "m0").alias("m"), "rows")
        # Each greater neighbour of a node goes to its least one: large-star.
        large = join_hot(both, saved(least, f"{name}-least"), "v", "rows").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = saved(large.distinct(), f"{name}-large")
        # Small-star: a node and its lesser neighbours go to the least of them; a node has few after the first rounds.
        low = saved(large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("rows")), f"{name}-low")
        pair = F.explode(F.array(F.struct("m", F.col("v").alias("x")), F.struct("m", F.col("u").alias("x")))).alias("e")
        cur = join_hot(large, low, "v", "rows").select(pair).select(F.col("e.m").alias("v"), F.col("e.x").alias("u")).where("v < u").distinct()
        cur = saved(cur, name)
        now = sign(cur)
        if now == before:
            break
        before = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
