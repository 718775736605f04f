"""The chunk index and what it selects.

Entries are (store_id, chunk_seq, entry_no, ts_ms, wf_ms, wl_ms, text); chunks are one row per
(store_id, seq) with counts, bytes, the write window and, on request, the distinct tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .entries import scanned

#: How far a write window may lie from the stamps in it before a widened selection misses them.
WIDEN_MS = 60_000
KEY = ["store_id", "seq"]


def chunk_index(entries: DataFrame) -> DataFrame:
    """(store_id, seq, n_entries, uncomp_len, first_write_ms, last_write_ms)."""
    size = F.octet_length("text") + 1
    return entries.groupBy("store_id", F.col("chunk_seq").alias("seq")).agg(
        F.count("*").alias("n_entries"), F.sum(size).cast("long").alias("uncomp_len"), F.min("wf_ms").alias("first_write_ms"), F.max("wl_ms").alias("last_write_ms"),
    )


def chunk_tokens(entries: DataFrame) -> DataFrame:
    """(store_id, seq, tokens), each chunk's distinct tokens in order; aggregated before the shuffle."""
    words = entries.select("store_id", F.col("chunk_seq").alias("seq"), F.explode(tokens(F.col("text"))).alias("token")).distinct()
    return words.groupBy(*KEY).agg(F.sort_array(F.collect_list("token")).alias("tokens"))


def uncovered(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks that the token index does not cover yet."""
    return chunks.join(index, KEY, "left_anti")


def overlaps(start: int | None, end: int | None, widen_ms: int = 0) -> Column:
    """The chunk's write window meets [start, end]; both ends inclusive, null is open."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (F.col("last_write_ms") >= max(0, start - widen_ms))
    if end is not None:
        ok = ok & (F.col("first_write_ms") <= end + widen_ms)
    return ok


def tail(chunks: DataFrame, n: int) -> DataFrame:
    """The last chunks of each store that together hold n entries or more; whole chunks."""
    upto = scanned(chunks, sums={"__upto": F.col("n_entries")}, order="seq").drop("__block")
    total = chunks.groupBy("store_id").agg(F.sum("n_entries").alias("__total"))
    return upto.join(total, "store_id").where(F.col("__total") - F.col("__upto") < n).select(*chunks.columns)


def from_number(chunks: DataFrame, seq: int) -> DataFrame:
    return chunks.where(F.col("seq") >= seq)


def follow_from(chunks: DataFrame, start_ms: int) -> DataFrame:
    """From the first chunk written to at start or later; everything after it too."""
    first = chunks.where(F.col("last_write_ms") >= start_ms).groupBy("store_id").agg(F.min("seq").alias("__first"))
    return chunks.join(first, "store_id").where(F.col("seq") >= F.col("__first")).drop("__first")


def leading_run(chunks: DataFrame, cutoff_ms: int) -> DataFrame:
    """The chunks at the front of each store that all end before cutoff; one that straddles it ends the run."""
    late = scanned(chunks, maxs={"__late": (F.col("last_write_ms") >= cutoff_ms).cast("int")}, order="seq")
    return late.where("__late = 0").select(*chunks.columns)


def fixed_chunks(offset: Column, chunk_size: int) -> Column:
    """The chunk of an entry by the bytes before it: the form that SQL can state."""
    return F.floor(offset / chunk_size)


def greedy_chunks(entries: DataFrame, chunk_size: int) -> DataFrame:
    """entries with chunk_seq as a writer assigns it: a chunk is closed by the entry that fills it.

    A running state, so each store is read in order by one task, in batches; only numbers are kept.
    """
    schema = entries.select("store_id", "entry_no").schema.add("chunk_seq", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, size, seq = None, 0, 0
        for pdf in batches:
            out = np.empty(len(pdf), np.int64)
            for k, (s, n) in enumerate(zip(pdf["store_id"].array, pdf["n"].array)):
                if s != store:
                    store, size, seq = s, 0, 0
                out[k] = seq
                size += int(n)
                if size >= chunk_size:
                    seq, size = seq + 1, 0
            yield pdf[["store_id", "entry_no"]].assign(chunk_seq=out)

    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = entries.select("store_id", "entry_no", (F.octet_length("text") + 1).alias("n")).repartition(n, "store_id").sortWithinPartitions("store_id", "entry_no")
    return entries.drop("chunk_seq").join(slim.mapInPandas(run, schema), ["store_id", "entry_no"])


# ---- Bloom filters: a compact form of the token index ---------------------------------------

#: Bits per token, and hash functions.
BITS_PER_TOKEN, HASHES = 10, 7
_PRIME, _SEEDS = np.uint64(0x100000001B3), (np.uint64(0xCBF29CE484222325), np.uint64(0x84222325CBF29CE4))


def _two_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """FNV-1a of each word from two seeds, all words a byte at a time."""
    raw = [w.encode() for w in words]
    width = max(map(len, raw), default=0)
    grid = np.zeros((len(raw), width), np.uint64)
    for k, b in enumerate(raw):
        grid[k, : len(b)] = np.frombuffer(b, np.uint8)
    n = np.array([len(b) for b in raw])
    out = []
    for seed in _SEEDS:
        h = np.full(len(raw), seed, np.uint64)
        for j in range(width):
            h = np.where(j < n, (h ^ grid[:, j]) * _PRIME, h)
        out.append(h)
    return out[0], out[1] | np.uint64(1)


def bloom_of(words: list[str]) -> bytes:
    bits = max(64, -(-len(words) * BITS_PER_TOKEN // 64) * 64)
    field = np.zeros(bits, bool)
    if words:
        a, b = _two_hashes(words)
        for k in range(HASHES):
            field[((a + np.uint64(k) * b) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(field, bitorder="little").tobytes()


def bloom_has(bloom: bytes, words: list[str]) -> bool:
    field = np.unpackbits(np.frombuffer(bloom, np.uint8), bitorder="little").astype(bool)
    if not words:
        return True
    a, b = _two_hashes(words)
    return all(field[((a + np.uint64(k) * b) % np.uint64(len(field))).astype(np.int64)].all() for k in range(HASHES))


def bloom_index(index: DataFrame) -> DataFrame:
    """(store_id, seq, bloom) of a token index."""

    @F.pandas_udf("binary")
    def build(words: pd.Series) -> pd.Series:
        return words.map(lambda w: bloom_of(list(w)))

    return index.select(*KEY, build("tokens").alias("bloom"))


def bloom_may_have(words: list[str]) -> Column:
    @F.pandas_udf("boolean")
    def test(blooms: pd.Series) -> pd.Series:
        return blooms.map(lambda b: b is None or bloom_has(b, words))

    return test(F.col("bloom"))
