"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of the digests are taken in each partition and merged by summing; the
largest candidates are counted exactly, and the winners that hold (at most ``counters`` rows) are
broadcast, so that rows of very frequent texts are resolved where they lie. All other digests
meet in an ordinary shuffle, aggregated before it.

Defined results: null text counts as empty, and empty texts are equal to each other; of rows with
equal text and equal doc_id the first read stays (``row_id``); a null doc_id sorts before all
others; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, saved, text_of


def _misra_gries(counters: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[bytes, int] = {}
        for pdf in batches:
            for d, n in pdf["digest"].value_counts().items():
                kept[d] = kept.get(d, 0) + int(n)
            if len(kept) > counters:
                cut = sorted(kept.values(), reverse=True)[counters]
                kept = {d: n - cut for d, n in kept.items() if n > cut}
        yield pd.DataFrame({"digest": list(kept), "n": list(kept.values())})

    return run


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row_id, digest): SHA-256 of the text with each run of white space made one space."""
    plain = F.regexp_replace(text_of(), SPACE, " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.unhex(F.sha2(plain, 256)).alias("digest"))


def resolve(docs: DataFrame, counters: int = 1024) -> DataFrame:
    """(doc_id, row_id, digest, keep_id, group_size, kept) for each row of docs."""
    rows = saved(digests(docs), "digests")
    first = F.min(F.struct("doc_id", "row_id")).alias("first")
    sketch = rows.select("digest").mapInPandas(_misra_gries(counters), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    likely = sketch.orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    winners = saved(rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(F.count("*").alias("size"), first).where("size > 1"), "winners")
    hot = rows.join(F.broadcast(winners), "digest", "left")
    rest = hot.where("size is null").select("doc_id", "row_id", "digest")
    groups = rest.groupBy("digest").agg(F.count("*").alias("size"), first).where("size > 1")
    cold = rest.join(groups, "digest", "left")
    both = hot.where("size is not null").unionByName(cold)
    return both.select(
        "doc_id", "row_id", "digest", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("first.row_id") == F.col("row_id"), F.lit(True)).alias("kept"),
    )


def exact_dedup(docs: DataFrame, counters: int = 1024) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return resolve(docs, counters).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, counters: int = 1024) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    from .common import only_ids

    found = saved(resolve(docs, counters).select("doc_id", "kept", "keep_id", "digest"), "resolved")
    gone = found.where(~F.col("kept") & ~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id").distinct()
    again = found.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id")
    gone_n, again_n = gone.count(), again.count()
    if not again_n:
        return only_ids(docs, gone, False, gone_n)
    # Ids that several rows carry: those rows are decided by id and text together.
    twice = docs.join(again, docs["doc_id"].eqNullSafe(again["doc_id"]), "left_semi").withColumn("__digest", F.unhex(F.sha2(F.regexp_replace(text_of(), SPACE, " "), 256)))
    stay = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__d"))
    twice = twice.join(stay, twice["doc_id"].eqNullSafe(stay["__id"]) & (twice["__digest"] == stay["__d"]), "left_semi").dropDuplicates(["doc_id", "__digest"]).drop("__digest")
    once = docs.join(again, docs["doc_id"].eqNullSafe(again["doc_id"]), "left_anti")
    return only_ids(once, gone, False, gone_n).unionByName(twice)
