"""Entries: a stamped line with the lines that follow it.

Lines are (store_id, line_no, line, ts_ms). What a line takes from lines before it is carried over blocks of
line numbers: first inside each block, then over one row per block. A store of any size so spreads
over many tasks, and none holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 50_000
#: Bytes of an entry's text beyond which it goes on as a new one.
ENTRY_CAP = 16 << 20
#: Lines before the first stamp of a store that may wait for it.
LEADING_LINES = 1_000


def scanned(df: DataFrame, lasts: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, maxs: dict[str, Column] | None = None, key: str | list[str] = "store_id", order: str = "line_no", block: int = BLOCK, dealt: bool = False) -> DataFrame:
    """df with, in order within key, the last non-null value up to each row (lasts), the sum up to it (sums) and the greatest (maxs).

    Rows meet once, by key and block; a row per block carries over. dealt: df lies by key and
    __block already, as scanned returns it.
    """
    lasts, sums, maxs = lasts or {}, sums or {}, maxs or {}
    keys = [key] if isinstance(key, str) else list(key)
    base = df.withColumns({f"__v_{n}": v for n, v in {**lasts, **sums, **maxs}.items()})
    if not dealt:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        base = base.withColumn("__block", F.floor(F.col(order) / block)).repartition(n, *keys, "__block")
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    own = {n: F.last(f"__v_{n}", ignorenulls=True).over(inside) for n in lasts} | {n: F.sum(f"__v_{n}").over(inside) for n in sums} | {n: F.max(f"__v_{n}").over(inside) for n in maxs}
    per = [F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(order))).alias(f"__b_{n}") for n in lasts] + [F.sum(f"__v_{n}").alias(f"__b_{n}") for n in sums] + [F.max(f"__v_{n}").alias(f"__b_{n}") for n in maxs]
    blocks = base.groupBy(*keys, "__block").agg(*per)
    carry = {f"__c_{n}": F.last(f"__b_{n}", ignorenulls=True).over(before) for n in lasts} | {f"__c_{n}": F.sum(f"__b_{n}").over(before) for n in sums} | {f"__c_{n}": F.max(f"__b_{n}").over(before) for n in maxs}
    blocks = blocks.select(*keys, "__block", *[c.alias(n) for n, c in carry.items()])
    out = base.withColumns({f"__o_{n}": c for n, c in own.items()}).join(blocks, [*keys, "__block"])
    found = {n: F.coalesce(f"__o_{n}", f"__c_{n}") for n in lasts} | {n: F.coalesce(f"__o_{n}", F.lit(0)) + F.coalesce(f"__c_{n}", F.lit(0)) for n in sums} | {n: F.greatest(f"__o_{n}", f"__c_{n}") for n in maxs}
    return out.select(*df.columns, *[c.alias(n) for n, c in found.items()], *([] if "__block" in df.columns else ["__block"]))


def carried(df: DataFrame, value: Column, name: str, key: str = "store_id", order: str = "line_no", block: int = BLOCK) -> DataFrame:
    """df with the last non-null value up to each row, in order within key."""
    return scanned(df, lasts={name: value}, key=key, order=order, block=block).drop("__block")


def group_entries(lines: DataFrame, cap: int = ENTRY_CAP) -> DataFrame:
    """(store_id, entry_no, ts_ms, n_lines, text). entry_no is the number of the entry's first line.

    Lines before the first stamp of a store form an entry of their own, without a stamp. After cap bytes an
    entry goes on as a new one, with the same stamp. Where lines have eff_ms, so has an entry: its first.
    """
    size = F.octet_length(F.coalesce("line", F.lit(""))) + 1
    upto = scanned(lines, sums={"__upto": size})
    first = F.when(F.col("ts_ms").isNotNull(), F.struct("line_no", (F.col("__upto") - size).alias("at"), "ts_ms"))
    head = scanned(upto, lasts={"__head": first}, dealt=True)
    piece = F.floor((F.col("__upto") - 1 - F.coalesce("__head.at", F.lit(0))) / cap)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    grouped = head.groupBy("store_id", F.col("__head.line_no").alias("head"), piece.alias("piece"))
    eff = [F.min("eff_ms").alias("eff_ms")] if "eff_ms" in lines.columns else []
    out = grouped.agg(F.min("line_no").alias("entry_no"), F.any_value("__head.ts_ms").alias("ts_ms"), F.count("*").cast("int").alias("n_lines"), text.alias("text"), *eff)
    return out.drop("head", "piece")


def inherit_stamps(lines: DataFrame) -> DataFrame:
    """lines with eff_ms: the line's stamp, else the one before it, else the store's first."""
    firsts = lines.where("ts_ms is not null").groupBy("store_id").agg(F.min_by("ts_ms", "line_no").alias("__first"))
    out = carried(lines, F.col("ts_ms"), "eff_ms").join(firsts, "store_id", "left")
    return out.withColumn("eff_ms", F.coalesce("eff_ms", "__first")).drop("__first")


def leading(lines: DataFrame, limit: int = LEADING_LINES) -> DataFrame:
    """(store_id, waiting): stores with more than limit lines before their first stamp; stores without any stamp count all."""
    firsts = lines.groupBy("store_id").agg(F.min(F.when(F.col("ts_ms").isNotNull(), F.col("line_no"))).alias("__first"))
    early = lines.join(firsts, "store_id").where(F.col("__first").isNull() | (F.col("line_no") < F.col("__first")))
    return early.groupBy("store_id").agg(F.count("*").alias("waiting")).where(F.col("waiting") > limit)


def stampable(lines: DataFrame) -> DataFrame:
    """(store_id, stampable): whether any line has a stamp."""
    return lines.groupBy("store_id").agg(F.bool_or(F.col("ts_ms").isNotNull()).alias("stampable"))


def zone_tripwire(entries: DataFrame) -> DataFrame:
    """Stores whose entries lie outside their write window by whole hours (within five minutes), on average of 20 or more."""
    off = F.when(F.col("ts_ms") < F.col("wf_ms"), F.col("ts_ms") - F.col("wf_ms")).when(F.col("ts_ms") > F.col("wl_ms"), F.col("ts_ms") - F.col("wl_ms"))
    mean = entries.withColumn("off", off).where("off is not null").groupBy("store_id").agg(F.count("*").alias("n"), F.sum("off").alias("total"))
    mean = mean.withColumn("mean_ms", F.floor(F.col("total") / F.col("n"))).withColumn("hours", F.round(F.col("mean_ms") / 3_600_000).cast("long"))
    return mean.where((F.col("n") >= 20) & (F.col("hours") != 0) & (F.abs(F.col("mean_ms") - F.col("hours") * 3_600_000) <= 300_000)).select("store_id", "n", "hours")
