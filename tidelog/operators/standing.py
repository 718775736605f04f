"""Consumers and retention: who has read what, what may go, what was lost.

Chunks are (store_id, seq, uncomp_len, comp_len, first_write_ms, last_write_ms), cursors
(consumer, store_id, seq, n, wl), followers (name, store_id, retaining, seq).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..files import saved
from ..functions.times import human_duration
from .entries import scanned

#: Chunks to a block, entries of a chunk to a part of it, and consumers to a group, where consumers meet entries.
BLOCK = 16
PART = 256
GROUP = 256
#: Rows that a task makes of consumers and entries; beyond MAX_TASKS tasks they make more.
ROWS_PER_TASK = 2_000_000
MAX_TASKS = 20_000


def vital_signs(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("store_id").agg(
        F.count("*").alias("n_chunks"), F.sum("n_entries").alias("n_entries"), F.sum("uncomp_len").alias("uncomp_bytes"), F.min("first_write_ms").alias("first_ms"), F.max("last_write_ms").alias("last_ms"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), (F.max("seq") + 1).alias("next_seq"),
    )


def dropped(stores: DataFrame, chunks: DataFrame) -> DataFrame:
    """(store_id, dropped): chunks ever dropped, the number of the oldest that is left, or the next number."""
    left = chunks.groupBy("store_id").agg(F.min("seq").alias("first"))
    return stores.join(left, "store_id", "left").select("store_id", F.coalesce("first", "next_seq").alias("dropped"))


def standing(cursors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per cursor: consumed and behind chunks, bytes behind, lag in ms, and the gap if its position is gone."""
    # Cursors and chunks in one order, a cursor before the chunk at its position: a running count and sum, not a row for each pair.
    none = F.lit(None)
    marks = cursors.select("store_id", (F.coalesce("seq", F.lit(0)) * 2).alias("at"), F.struct("consumer", "seq", "n", "wl").alias("cursor"), F.lit(0).alias("one"), F.lit(0).cast("long").alias("bytes"))
    kind = marks.schema["cursor"].dataType
    steps = chunks.select("store_id", (F.col("seq") * 2 + 1).alias("at"), none.cast(kind).alias("cursor"), F.lit(1).alias("one"), F.col("uncomp_len").cast("long").alias("bytes"))
    passed = scanned(marks.unionByName(steps), sums={"consumed": F.col("one"), "read": F.col("bytes")}, order="at").where("cursor is not null")
    whole = chunks.groupBy("store_id").agg(F.count("*").alias("__n"), F.sum("uncomp_len").alias("__bytes"), F.max("last_write_ms").alias("__last"), F.min("seq").alias("__first"), F.max("seq").alias("last_seq"))
    out = passed.join(whole, "store_id", "left")
    ran, gap = F.col("cursor.seq").isNotNull() & F.col("__n").isNotNull(), F.col("__first") - F.col("cursor.seq")
    counted = lambda c: F.when(ran, c).otherwise(0).cast("long")
    return out.select(
        "cursor.consumer", "store_id", F.col("cursor.seq").alias("position"), "cursor.n", counted(F.col("consumed")).alias("consumed"), counted(F.col("__n") - F.col("consumed")).alias("behind"), counted(F.col("__bytes") - F.col("read")).alias("behind_bytes"),
        (F.col("__last") - F.col("cursor.wl")).alias("behind_ms"), "last_seq", F.when(gap > 0, gap).alias("gap_chunks"),
    )


CURSOR_SCHEMA = "consumer string, store_id string, path string, seq long, n long, wl long, delivered long, updated string"


def read_cursors(spark, path: str) -> tuple[DataFrame, int]:
    """(cursors, unreadable) of files of JSON lines: what is no cursor is counted, not guessed at."""
    raw = spark.read.schema(CURSOR_SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    ok = F.col("_bad").isNull() & F.col("consumer").isNotNull() & F.col("store_id").isNotNull()
    marked = saved(raw.withColumn("__ok", ok), "cursors")
    return marked.where("__ok").drop("__ok", "_bad"), marked.where(~F.col("__ok")).count()


def at_stores(cursors: DataFrame, stores: DataFrame) -> DataFrame:
    """The cursors whose store is among stores (store_id); those of others are passed over."""
    return cursors.join(stores.select("store_id").distinct(), "store_id", "left_semi")


def lag_text(gap: Column, behind: Column, live: Column, behind_ms: Column) -> Column:
    """A gap outranks a distance."""
    return F.when(gap.isNotNull(), F.lit("GAP")).when(behind == 0, F.lit("caught up")).when(live, F.lit("at the live edge")).otherwise(F.concat(human_duration(behind_ms), F.lit(" behind")))


def interest_floor(followers: DataFrame, stores: DataFrame, unreadable: int = 0) -> DataFrame:
    """(store_id, floor): what every retaining follower has read; null holds everything.

    A follower that never ran, or stands at or past the next number, makes the floor null; so does a
    store without retaining followers, for which nothing may be dropped on this axis. Declarations that
    cannot be read (their number) may be of any store, so with one all floors are null.
    """
    if unreadable:
        return stores.select("store_id", F.lit(None).cast("long").alias("floor"))
    mine = followers.where("retaining").select("store_id", "seq")
    joined = stores.select("store_id", "next_seq").join(mine.withColumn("__f", F.lit(1)), "store_id", "left")
    bad = F.count_if(F.col("__f").isNotNull() & (F.col("seq").isNull() | (F.col("seq") >= F.col("next_seq"))))
    return joined.groupBy("store_id").agg(F.when(bad == 0, F.min("seq")).alias("floor"))


def retention_drop(chunks: DataFrame, floors: DataFrame, cutoff_ms: int, budget: int, margin: int = 8192) -> DataFrame:
    """(store_id, by_age, by_size, by_interest, drop): leading chunks that each axis would drop; the largest goes.

    Age drops a leading run once it is a tenth of the bytes; size drops down to 95 % of the budget less
    the margin once the budget is passed; interest drops what lies below the floor.
    """
    c = scanned(chunks, sums={"__end": F.col("comp_len")}, maxs={"__late": (F.col("last_write_ms") >= cutoff_ms).cast("int")}, order="seq").withColumn("__lead", 1 - F.col("__late"))
    target = max(0, max(0, budget - budget // 20) - margin)
    c = c.join(chunks.groupBy("store_id").agg(F.sum("comp_len").alias("__all")), "store_id").join(floors, "store_id", "left")
    age_n, age_bytes = F.count_if(F.col("__lead") == 1), F.coalesce(F.max(F.when(F.col("__lead") == 1, F.col("__end"))), F.lit(0))
    size_n = F.when(F.any_value("__all") > budget, F.count_if(F.col("__all") - (F.col("__end") - F.col("comp_len")) > target)).otherwise(0)
    out = c.groupBy("store_id").agg(F.when(age_bytes * 10 >= F.any_value("__all"), age_n).otherwise(0).alias("by_age"), size_n.alias("by_size"), F.count_if(F.coalesce(F.col("seq") < F.col("floor"), F.lit(False))).alias("by_interest"))
    return out.withColumn("drop", F.greatest("by_age", "by_size", "by_interest"))


def loss_record(chunks: DataFrame, drops: DataFrame, followers: DataFrame) -> DataFrame:
    """(store_id, name, from_seq, to_seq): chunks dropped at or past the position of the furthest-behind retaining follower."""
    gone = scanned(chunks, sums={"__k": F.lit(1)}, order="seq").join(drops.select("store_id", "drop"), "store_id").where(F.col("__k") <= F.col("drop"))
    span = gone.groupBy("store_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    worst = followers.where("retaining").groupBy("store_id").agg(F.min(F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), "name")).alias("w"))
    out = span.join(worst, "store_id").select("store_id", F.col("w.name").alias("name"), F.greatest("w.seq", "first").alias("from_seq"), F.col("last").alias("to_seq"))
    return out.where("from_seq <= to_seq")


def held_bytes(standings: DataFrame) -> DataFrame:
    """(store_id, held): the largest backlog; null where a consumer holds everything."""
    return standings.groupBy("store_id").agg(F.when(F.count_if("holds_all") > 0, F.lit(None).cast("long")).otherwise(F.max("behind_bytes")).alias("held"))


def resume(entries: DataFrame, cursors: DataFrame, block: int = BLOCK, group: int = GROUP, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Entries after each consumer's position: later chunks, and of its chunk all but the first n.

    An entry's place in its chunk is the same for all consumers and is found once. Entries are packed by blocks
    of chunks and cursors by groups, a row each; parts of either are dealt out once, and every task reads one
    part of both and makes their rows. So disk grows with the inputs, not with consumers times blocks, and
    tasks with the rows that the result may have: the inputs are small beside it.
    """
    block_of = lambda seq: F.floor(F.col(seq) / block)
    e = entries.withColumn("__block", block_of("chunk_seq"))
    at = cursors.select("consumer", "store_id", "seq", "n", block_of("seq").alias("__from"))
    sizes = at.groupBy("store_id", "__from").agg(F.count("*").alias("__n"), F.ceil(F.count("*") / group).alias("__groups"))
    readers = sizes.groupBy("store_id").agg(F.sum("__n").alias("__n"), F.sum("__groups").alias("__groups"))
    blocks = e.groupBy("store_id", "__block").agg(F.count("*").alias("__rows")).groupBy("store_id").agg(F.sum("__rows").alias("__rows"), F.count("*").alias("__blocks"))
    rows, n_blocks, n_groups = blocks.join(readers, "store_id").agg(F.sum(F.col("__rows").cast("double") * F.col("__n")), F.sum("__blocks"), F.sum("__groups")).first()
    tasks = max(1, min(math.ceil((rows or 0) / per_task), MAX_TASKS))
    right = min(n_groups or 1, max(math.ceil(math.sqrt(tasks)), math.ceil(tasks / (n_blocks or 1))))
    left = math.ceil(tasks / right)

    # One dealing out by store and block serves the places in chunks and the packs.
    place = Window.partitionBy("store_id", "__block", "chunk_seq").orderBy("entry_no")
    e = e.repartition("store_id", "__block").withColumn("__k", F.row_number().over(place)).withColumn("__part", F.floor((F.col("__k") - 1) / PART))
    packs = e.groupBy("store_id", "__block", "__part").agg(F.collect_list(F.struct("__k", *[c for c in entries.columns if c != "store_id"])).alias("__entries")).repartition(left)
    # Null positions start nowhere, so the join may leave them out.
    at = at.join(sizes.drop("__n"), ["store_id", "__from"]).withColumn("__group", F.pmod(F.xxhash64("consumer", "seq", "n"), "__groups"))
    groups = at.groupBy("store_id", "__from", "__group").agg(F.collect_list(F.struct("consumer", F.col("seq").alias("__seq"), "n")).alias("__cursors")).repartition(right)
    met = packs.join(groups.withColumnRenamed("store_id", "__store").hint("shuffle_replicate_nl"), (F.col("store_id") == F.col("__store")) & (F.col("__block") >= F.col("__from")))
    both = met.select("store_id", "__entries", F.inline("__cursors")).select("store_id", "consumer", "__seq", "n", F.inline("__entries"))
    after = (F.col("chunk_seq") > F.col("__seq")) | ((F.col("chunk_seq") == F.col("__seq")) & (F.col("__k") > F.col("n")))
    return both.where(after).select(*entries.columns, "consumer")


def folded(delivered: DataFrame) -> DataFrame:
    """(consumer, store_id, seq, n, wl, delivered) after deliveries (consumer, store_id, chunk_seq, wl_ms)."""
    by = delivered.groupBy("consumer", "store_id", "chunk_seq").agg(F.count("*").alias("n"), F.max("wl_ms").alias("wl"))
    last = by.groupBy("consumer", "store_id").agg(F.max(F.struct("chunk_seq", "n", "wl")).alias("c"), F.sum("n").alias("delivered"))
    return last.select("consumer", "store_id", F.col("c.chunk_seq").alias("seq"), F.col("c.n").alias("n"), F.col("c.wl").alias("wl"), "delivered")


def resolved(cursors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(consumer, store_id, seq, n) of cursors that know a write time only: the first chunk written to then or later, or past the last."""
    # The first chunk whose running maximum reaches wl is the first that was written to then: one look-up in the order of those maxima.
    upto = scanned(chunks, maxs={"most": F.col("last_write_ms")}, order="seq").groupBy("store_id", "most").agg(F.min("seq").alias("seq"))
    steps = upto.select("store_id", (-2 * F.col("most") - 1).alias("at"), "seq", F.lit(None).cast("string").alias("consumer"))
    marks = cursors.select("store_id", (-2 * F.col("wl")).alias("at"), F.lit(None).cast("long").alias("seq"), F.col("consumer").cast("string").alias("consumer"))
    hit = scanned(steps.unionByName(marks), lasts={"hit": F.col("seq")}, order="at", block=2 * 86_400_000).where("consumer is not null")
    last = chunks.groupBy("store_id").agg(F.max("seq").alias("last"))
    return hit.join(last, "store_id").select("consumer", "store_id", F.coalesce("hit", F.col("last") + 1).alias("seq"), F.lit(0).cast("long").alias("n"))


def anchored(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(consumer, store_id, seq, overtaken) of anchors (consumer, store_id, first_write_ms, last_write_ms, uncomp_len, comp_len, hint).

    An anchor is the last chunk that a consumer saw, known by its write window and lengths, which a trim
    does not change. seq is the first chunk after it: at the hint, else the last one alike at or before it.
    Where none is left the store overtook the consumer, which goes on at the end.
    """
    same = ["store_id", "first_write_ms", "last_write_ms", "uncomp_len", "comp_len"]
    at = F.when(F.col("seq") <= F.col("hint"), F.col("seq"))
    found = anchors.join(chunks.select(*same, "seq"), same, "left").groupBy("consumer", "store_id").agg(F.max(at).alias("at"))
    last = chunks.groupBy("store_id").agg(F.max("seq").alias("last"))
    return found.join(last, "store_id", "left").select("consumer", "store_id", (F.coalesce("at", "last", F.lit(-1)) + 1).alias("seq"), F.col("at").isNull().alias("overtaken"))
