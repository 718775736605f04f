"""Ingest: overlap deduplication, segments already present, prefix checks, routing, reassembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..files import saved
from .entries import scanned
from .joins import join_hot


def overlap_dedup(source: DataFrame, stored: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Lines of source that the overlap with stored does not hold: a bag difference in order.

    source has (store_id, pos, line, eff_ms), stored (store_id, line, eff_ms). The overlap is what is stored
    from the first chunk on whose last_write_ms reaches the source's first stamp; with chunks
    (store_id, seq, last_write_ms), stored has chunk_seq too, without them it is one chunk per store. As many
    copies of a line as the overlap holds are dropped, first ones first, until eff_ms passes the store's end.
    """
    ends = stored.groupBy("store_id").agg(F.max("eff_ms").alias("__end"))
    overlap = stored
    if chunks is not None:
        starts = source.groupBy("store_id").agg(F.min_by("eff_ms", F.when(F.col("eff_ms").isNotNull(), F.col("pos"))).alias("__start"))
        first = chunks.join(starts, "store_id").where(F.col("last_write_ms") >= F.col("__start")).groupBy("store_id").agg(F.min("seq").alias("__first"))
        overlap = stored.join(first, "store_id").where(F.col("chunk_seq") >= F.col("__first"))
    # Only lines that the overlap holds are numbered; a very common one is joined where it lies and numbered in blocks.
    key = ["store_id", "line"]
    held = overlap.groupBy(*key).agg(F.count("*").alias("__held")).join(source.groupBy(*key).agg(F.count("*").alias("__rows")), key)
    met = join_hot(source, saved(held, "held"), key, "__rows")
    copies = scanned(met.where("__held is not null"), sums={"__copy": F.lit(1)}, key=key, order="pos").drop("__block")
    out = copies.unionByName(met.where("__held is null").withColumn("__copy", F.lit(1).cast("long"))).join(ends, "store_id", "left")
    new = (F.col("__copy") > F.coalesce("__held", F.lit(0))) | (F.col("eff_ms") > F.col("__end"))
    return out.where(F.coalesce(new, F.lit(True))).drop("__copy", "__held", "__end")


def refused(source: DataFrame, stored: DataFrame) -> DataFrame:
    """Stores whose source starts before the first stamp stored."""
    first = stored.groupBy("store_id").agg(F.min("eff_ms").alias("store_first"))
    start = source.groupBy("store_id").agg(F.min_by("eff_ms", "pos").alias("source_first"))
    return start.join(first, "store_id").where("source_first < store_first")


def segment_present(segment: DataFrame, chunks: DataFrame) -> DataFrame:
    """(segment_id, start_seq) where all records of a segment stand in a row in chunks.

    Both have first_write_ms, last_write_ms, uncomp_len and comp_len; segment has (segment_id, pos).
    """
    same = ["first_write_ms", "last_write_ms", "uncomp_len", "comp_len"]
    size = segment.groupBy("segment_id").agg(F.count("*").alias("size"), F.min("pos").alias("p0"))
    hits = segment.join(chunks, same).withColumn("start_seq", F.col("seq") - F.col("pos"))
    runs = hits.groupBy("segment_id", "start_seq").agg(F.countDistinct("pos").alias("found"))
    return runs.join(size, "segment_id").where("found = size").select("segment_id", (F.col("start_seq") + F.col("p0")).alias("start_seq"))


def prefix_verified(stored: DataFrame, source: DataFrame, sample: int | None = None) -> DataFrame:
    """(store_id, n, same): whether the stored lines are the source's first ones; sample: the first, middle and last only."""
    pairs = stored.select("store_id", "pos", F.col("line").alias("a")).join(source.select("store_id", "pos", F.col("line").alias("b")), ["store_id", "pos"], "left")
    if sample:
        last = stored.groupBy("store_id").agg(F.max("pos").alias("last"))
        pairs = pairs.join(last, "store_id").where((F.col("pos") == 0) | (F.col("pos") == F.floor(F.col("last") / 2)) | (F.col("pos") == F.col("last")))
    return pairs.groupBy("store_id").agg(F.count("*").alias("n"), F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


def routed(records: DataFrame, stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records of declared stores, records of undeclared ones), by store name."""
    known = stores.select("name").distinct()
    return records.join(known, "name", "left_semi"), records.join(known, "name", "left_anti")


def reassembled(fragments: DataFrame) -> DataFrame:
    """(partial_id, message_no, ts_ms, text): fragments joined in order of arrival, a message at each last fragment.

    The first fragment's time is the message's. Fragments after the last complete message wait.
    """
    order = Window.partitionBy("partial_id").orderBy("arrival")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    part = fragments.withColumn("message_no", F.coalesce(F.sum(F.col("partial_last").cast("int")).over(before), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("arrival", "text"))), lambda x: x["text"]), "")
    out = part.groupBy("partial_id", "message_no").agg(F.min_by("ts_ms", "arrival").alias("ts_ms"), text.alias("text"), F.bool_or("partial_last").alias("done"))
    return out.where("done").drop("done")
