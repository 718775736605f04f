"""Streaming: entries put together from lines as they come, reassembly of split messages, shipping.

An entry is open until the next stamped line of its source, or until its source is idle. State is one
open entry per source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import files
from ..operators.entries import ENTRY_CAP
from ..operators.stamps import stamp_millis

ENTRY_SCHEMA = "source string, ts_ms long, n_lines int, text string"
_STATE = "ts_ms long, n_lines int, text string"


def _bytes(text: str) -> int:
    # A character has four bytes at most: short texts are not encoded.
    return len(text) if 4 * len(text) <= ENTRY_CAP // 2 else len(text.encode("utf-8", "surrogatepass"))


def _assemble(idle_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        source, out = key[0], []
        entry = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            if entry is not None:
                out.append((source, *entry))
        else:
            rows = pd.concat(list(batches)).sort_values("pos")
            for ts, line in zip(rows["ts_ms"].astype("Int64"), rows["line"]):
                ts = None if pd.isna(ts) else int(ts)
                if entry is None:
                    entry = (ts, 1, line)
                elif ts is not None or _bytes(entry[2]) + _bytes(line) > ENTRY_CAP:
                    out.append((source, *entry))
                    entry = (ts, 1, line)
                else:
                    entry = (entry[0], int(entry[1]) + 1, f"{entry[2]}\n{line}")
            if entry is not None:
                state.update(entry)
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["source", "ts_ms", "n_lines", "text"]).astype({"ts_ms": "Int64"})

    return run


def assembled(lines: DataFrame, idle_ms: int = 10_000) -> DataFrame:
    """Entries of a stream of (source, pos, line)."""
    stamped = lines.withColumn("ts_ms", stamp_millis(F.col("line")))
    return stamped.groupBy("source").applyInPandasWithState(_assemble(idle_ms), ENTRY_SCHEMA, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


_PART_SCHEMA = "partial_id string, ts_ms long, text string"


def _join_parts(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ts, text = state.get if state.exists else (None, None)
    out = []
    if state.hasTimedOut:
        state.remove()
        out.append((key[0], ts, text))
    else:
        for r in pd.concat(list(batches)).sort_values("arrival").itertuples():
            ts, text = (int(r.ts_ms), r.text) if text is None else (ts, text + r.text)
            if r.partial_last or _bytes(text) > ENTRY_CAP:
                out.append((key[0], ts, text))
                ts = text = None
        if text is None:
            if state.exists:
                state.remove()
        else:
            state.update((ts, text))
            state.setTimeoutDuration(60_000)
    yield pd.DataFrame(out, columns=["partial_id", "ts_ms", "text"])


def reassembled(fragments: DataFrame) -> DataFrame:
    """Whole messages of a stream of fragments (partial_id, arrival, ts_ms, text, partial_last); one left for a minute is emitted as it is."""
    return fragments.groupBy("partial_id").applyInPandasWithState(_join_parts, _PART_SCHEMA, "ts_ms long, text string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def follow(spark, path: str, schema: str, files_per_trigger: int = 64, from_now: bool = False) -> DataFrame:
    """New files of a folder as a stream; a checkpoint remembers what was read. from_now passes over the files that are there."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    if not from_now:
        return stream
    there = [(n, at) for n, folder, _, at in files.listing(spark, path) if not folder]
    latest = max((at for _, at in there), default=0)
    # Of the files of the last moment, those that are there are named; all older ones go by their time.
    last = [n for n, at in there if at == latest]
    when = F.unix_millis("_metadata.file_modification_time")
    return stream.where((when > latest) | ((when == latest) & ~F.col("_metadata.file_name").isin(last)))


def follow_all(spark, sources: dict[str, str], schema: str, **options) -> DataFrame:
    """Several folders as one stream, each row with its source's name in src; there is no order among sources."""
    streams = [follow(spark, p, schema, **options).withColumn("src", F.lit(n)) for n, p in sources.items()]
    out = streams[0]
    for more in streams[1:]:
        out = out.unionByName(more)
    return out


def bounded(stream: DataFrame, most: int, take, checkpoint: str, order: list[str] | None = None, **trigger):
    """Gives the first rows of a stream, most of them in all, to take(DataFrame), and stops. Returns the query."""
    left = [most]

    def each(df: DataFrame, _: int) -> None:
        if left[0] > 0:
            some = files.saved((df.orderBy(*order) if order else df).limit(left[0]), "bounded")
            left[0] -= some.count()
            take(some)
        if left[0] <= 0 and running:
            # A query cannot wait for its own end from inside a batch.
            import threading

            threading.Thread(target=running[0].stop, daemon=True).start()

    running: list = []
    running.append(stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start())
    return running[0]


def append_stream(store, lines: DataFrame, checkpoint: str, name: str, maintain: bool = True, followers=None, **trigger):
    """Appends a stream of (pos, line) to a store as it comes; returns the query.

    Each trigger adds one batch and closes its chunks, so the trigger's interval is the age of the oldest line
    that is not stored yet. A batch that was added before a restart is passed over by its number, so
    each is added once. After it the store's retention is enforced; declared facts are read again each
    time, and while a manifest cannot be read the last good one holds. followers() gives the declared ones.
    """
    from ..store import Conflict

    def each(df: DataFrame, number: int) -> None:
        for attempt in range(20):
            try:
                store.append(df, source=name, number=number)
                break
            except Conflict:
                if attempt == 19:
                    raise
        if maintain and {"retain", "retain_size"} & set(store.facts):
            store.trim(followers=followers() if followers else None)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def shipped(stream: DataFrame, send, checkpoint: str, batch: int = 512, attempts: int = 5, longest_wait: float = 30.0, **trigger):
    """Starts sending a stream of (store_id, chunk_seq, entry_no, record) in batches, in the order of each store.

    send(store_id, records) gives an HTTP status, or what otlp.classify gives. The checkpoint moves only after
    all batches of a trigger are delivered, so delivery is at least once.
    """
    import time

    from ..sources.otlp import classify

    def deliver(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, waiting, sent = None, [], 0

        def post():
            for k in range(attempts):
                found = send(store, waiting)
                found = classify(found) if isinstance(found, int) else found
                if found["what"] != "retry":
                    break
                time.sleep(min(longest_wait, found["after"] if found["after"] is not None else 0.01 * 2**k))
            if found["what"] != "delivered":
                raise RuntimeError(f"a batch of {store} was not delivered: {found['what']}")

        for pdf in rows:
            for sid, record in zip(pdf["store_id"].array, pdf["record"].array):
                if waiting and (sid != store or len(waiting) >= batch):
                    post()
                    sent += len(waiting)
                    waiting = []
                store = sid
                waiting.append(record)
        if waiting:
            post()
        yield pd.DataFrame({"sent": [sent + len(waiting)]})

    def each(df: DataFrame, _: int) -> None:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # A store's records are delivered one after the other, so one task has them; in its order, whatever its batches.
        df.repartition(n, "store_id").sortWithinPartitions("store_id", "chunk_seq", "entry_no").mapInPandas(deliver, "sent long").agg(F.sum("sent")).collect()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
