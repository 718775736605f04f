"""Orders: the merge of many stores, stitching, ranks, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entries import scanned


def merge_key(chunks: DataFrame) -> DataFrame:
    """chunks with merge_ms, the time at which a head-of-queue merge reaches them.

    Such a merge takes the source whose next chunk is oldest, so a chunk comes no earlier than those
    before it in its source: its key is the running maximum of the first write times.
    """
    return scanned(chunks, maxs={"merge_ms": F.col("first_write_ms")}, order="seq").drop("__block")


def fleet_merge(entries: DataFrame, chunks: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """entries with merge_ms and src_idx, to be sorted by order_of(); ties go to the source named first."""
    keys = merge_key(chunks).select("store_id", F.col("seq").alias("chunk_seq"), "merge_ms")
    out = entries.join(keys, ["store_id", "chunk_seq"])
    if sources is None:
        return out.withColumn("src_idx", F.col("store_id"))
    place = F.create_map(*[F.lit(x) for k, s in enumerate(sources) for x in (s, k)])
    return out.where(F.col("store_id").isin(sources)).withColumn("src_idx", F.element_at(place, F.col("store_id")))


def order_of() -> list[Column]:
    return [F.col("merge_ms"), F.col("src_idx"), F.col("chunk_seq"), F.col("entry_no")]


def first_n(merged: DataFrame, n: int) -> DataFrame:
    """The first n entries of the merge: a top-k, kept small in each task before they meet."""
    return merged.orderBy(*order_of()).limit(n)


def stitch_order(lines: DataFrame) -> DataFrame:
    """(source, first_ms) by first stamp; sources without a stamp are left out, two equal starts are an error."""
    firsts = lines.where("ts_ms is not null").groupBy("source").agg(F.min_by("ts_ms", "line_no").alias("first_ms"))
    twice = firsts.groupBy("first_ms").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two sources start at {twice[0][0]}: their order is not determined")
    return firsts.orderBy("first_ms")


def follower_rank(standings: DataFrame) -> DataFrame:
    """Holds-everything first, then the largest backlog, then by name."""
    w = Window.partitionBy("store_id").orderBy(F.desc("holds_all"), F.desc_nulls_last("behind_bytes"), "name")
    return standings.withColumn("rank", F.row_number().over(w))


def batches(entries: DataFrame, size: int = 512) -> DataFrame:
    """entries with batch_no: size entries to a batch in each store, in order of entry_no, which chunks follow."""
    numbered = scanned(entries, sums={"__k": F.lit(1)}, order="entry_no").drop("__block")
    return numbered.withColumn("batch_no", F.floor((F.col("__k") - 1) / size)).drop("__k")
