"""Log lines out of an event table, and lines out of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stamps import stamp_millis

#: Stores that the events are dealt to, and events to a chunk.
STORES, EVENTS_PER_CHUNK = 8, 500


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, pos, line): lines end at line feeds alone. pos orders lines of a file; it has gaps."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def write_entries(entries: DataFrame, path: str, label: str | None = None) -> None:
    """Entries as text records that end with a NUL byte, so that their line feeds stay inside; label is a column that goes before each."""
    text = F.regexp_replace("text", r"\n\z", "")
    out = F.concat(F.col(label).cast("string"), F.lit(":"), text) if label else text
    entries.select(out.alias("value")).write.option("lineSep", "\0").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(text) of records that end with a NUL byte."""
    return spark.read.option("lineSep", "\0").text(path).withColumnRenamed("value", "text")


def rendered(events: DataFrame) -> DataFrame:
    """(store_id, line_no, ts_ms, line, chunk_seq, user_id, event_type, props): one stamped line per event."""
    ts = F.col("ts").cast("timestamp")
    line = F.concat_ws(" ", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.upper("event_type"), F.concat(F.lit("user="), F.col("user_id")))
    return events.select(
        F.concat(F.lit("s"), F.col("user_id") % STORES).alias("store_id"), F.col("event_id").alias("line_no"), F.unix_millis(ts).alias("ts_ms"), line.alias("line"),
        F.floor(F.col("event_id") / EVENTS_PER_CHUNK).alias("chunk_seq"), "user_id", "event_type", "props",
    )


def log_lines(events: DataFrame) -> DataFrame:
    """(store_id, line_no, line, ts_ms) with two continuation lines after each error; stamps are parsed."""
    base = rendered(events)
    more = F.when(F.col("event_type") == "error", F.array(F.col("line"), F.concat(F.lit("  at "), F.col("props")), F.concat(F.lit("  caused by user "), F.col("user_id")))).otherwise(F.array("line"))
    out = base.select("store_id", F.col("line_no").alias("n"), F.posexplode(more).alias("k", "line"))
    return out.select("store_id", (F.col("n") * 3 + F.col("k")).alias("line_no"), "line", stamp_millis(F.col("line")).alias("ts_ms"))


def entries(events: DataFrame) -> DataFrame:
    """(store_id, chunk_seq, entry_no, ts_ms, wf_ms, wl_ms, text): an entry per event, written a second after its stamp at most."""
    b = rendered(events)
    return b.select("store_id", "chunk_seq", F.col("line_no").alias("entry_no"), "ts_ms", F.col("ts_ms").alias("wf_ms"), (F.col("ts_ms") + F.col("user_id") % 1000).alias("wl_ms"), F.col("line").alias("text"))
