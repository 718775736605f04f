"""Stores: Parquet datasets of entries with a chunk index and a manifest, and the verbs on them.

A store is a folder: entries/ (by batch and, in a batch, by folders of CHUNKS_PER_FILE chunks, so that a query
lists and reads only those that hold selected chunks), chunks/ and tokens/ (index tables, by batch), and
manifests/ (a numbered file per change). Writers stage a batch and add the manifest last, under a number that no
other writer took, so a reader sees a write whole or not at all.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .functions.times import parse_duration, parse_size
from .operators import chunks as C
from .operators import order as O
from .operators import standing as S
from .operators.entries import group_entries, inherit_stamps, leading, scanned
from .operators.ingest import overlap_dedup
from .operators.manifest import checked, derived_facts
from .operators.predicates import Predicates, in_window
from .operators.stamps import stamp_millis

ENTRY_SCHEMA = "store_id string, chunk_seq long, entry_no long, ts_ms long, wf_ms long, wl_ms long, text string, block long"
CHUNK_SCHEMA = "store_id string, seq long, n_entries long, uncomp_len long, first_write_ms long, last_write_ms long, comp_len long"
TOKEN_SCHEMA = "store_id string, seq long, tokens array<string>"
#: Chunks whose entries lie in one folder; at 256 KiB a chunk 64 MiB.
CHUNKS_PER_FILE = 256
#: Folders that a query names one by one; beyond it, their range.
NAMED_BLOCKS = 4_096


class Conflict(RuntimeError):
    """Another writer changed the store first."""


def validate(start=None, end=None, follow=False, tail=None, max_n=None, from_chunk=None, has=None, any_=None) -> None:
    """Refuses what cannot be combined."""
    if start is not None and end is not None and start > end:
        raise ValueError("the window ends before it starts")
    if (has or any_) and (follow or tail is not None):
        raise ValueError("has and any select chunks that exist; they do not go with follow or tail")
    if from_chunk is not None and not follow:
        raise ValueError("from_chunk goes with follow only")
    if tail is not None and max_n is not None:
        raise ValueError("max and tail exclude each other")


@dataclass
class Store:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str, **facts) -> Store:
        store = cls(spark, path.rstrip("/"))
        store._commit({"facts": {"id": str(uuid.uuid4()), **checked(facts)}, "batches": [], "next_seq": 0, "next_entry": 0, "first_seq": 0, "dropped_chunks": 0, "dropped_bytes": 0, "chunks_per_file": CHUNKS_PER_FILE, "sources": {}}, 0)
        return store

    # ---- manifests: numbered files, of which the last whole one counts ------------------------

    def _commit(self, body: dict, after: int) -> None:
        """Adds manifest after + 1, unless another writer has added it."""
        data = json.dumps(body, sort_keys=True).encode()
        if not files.create_once(self.spark, f"{self.path}/manifests/{after + 1:012d}.json", data):
            raise Conflict(f"{self.path}: manifest {after + 1} was written by another writer")

    def _last(self) -> tuple[int, dict]:
        names = [n for n, folder, *_ in files.listing(self.spark, f"{self.path}/manifests") if not folder and n.endswith(".json") and n[:-5].isdigit()]
        for name in reversed(names):
            try:
                return int(name[:-5]), json.loads(files.read_bytes(self.spark, f"{self.path}/manifests/{name}"))
            except ValueError:  # being written: the one before it is the last good one
                continue
        raise FileNotFoundError(f"{self.path} is no store: it has no manifest")

    def manifest(self) -> dict:
        return self._last()[1]

    @property
    def facts(self) -> dict:
        return self.manifest()["facts"]

    def declare(self, **facts) -> None:
        """Changes declared facts; None takes one away."""
        n, body = self._last()
        body["facts"] = {"id": body["facts"]["id"], **checked({k: v for k, v in {**body["facts"], **facts}.items() if v is not None and k != "id"})}
        self._commit(body, n)

    # ---- tables --------------------------------------------------------------------------------

    def _table(self, name: str, schema: str, body: dict | None = None) -> DataFrame:
        body = body or self.manifest()
        if not body["batches"]:
            return self.spark.createDataFrame([], schema)
        out = self._parquet(name, schema, [b["name"] for b in body["batches"]])
        return out.where(F.col("chunk_seq" if name == "entries" else "seq") >= body["first_seq"])

    def _folder(self, name: str, batch: str) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def _parquet(self, name: str, schema: str, batches: list[str]) -> DataFrame:
        reader = self.spark.read.schema(f"{schema}, batch string").option("basePath", f"{self.path}/{name}")
        return reader.parquet(*[self._folder(name, b) for b in batches]).drop("batch")

    def entries(self) -> DataFrame:
        return self._table("entries", ENTRY_SCHEMA).drop("block")

    def chunks(self) -> DataFrame:
        return self._table("chunks", CHUNK_SCHEMA)

    def tokens(self) -> DataFrame:
        return self._table("tokens", TOKEN_SCHEMA)

    def _read(self, chunks: DataFrame, body: dict | None = None) -> DataFrame:
        """The entries of chunks: only their folders are listed and read."""
        body = body or self.manifest()
        per = body["chunks_per_file"]
        blocks = chunks.select(F.floor(F.col("seq") / per).alias("b")).distinct().limit(NAMED_BLOCKS + 1).collect()
        if len(blocks) > NAMED_BLOCKS:
            low, high = chunks.agg(F.min("seq"), F.max("seq")).first()
            at = F.col("block").between(low // per, high // per)
        else:
            at = F.col("block").isin([r[0] for r in blocks]) if blocks else F.lit(False)
        keys = chunks.select("store_id", F.col("seq").alias("chunk_seq"))
        return self._table("entries", ENTRY_SCHEMA, body).where(at).drop("block").join(keys, ["store_id", "chunk_seq"], "left_semi")

    def _stage(self, entries: DataFrame, per: int) -> tuple[dict | None, str]:
        """Writes entries and their index; ({name, first, last, entries}, or None where there are none)."""
        batch = f"batch-{uuid.uuid4().hex}"
        out = entries.withColumn("block", F.floor(F.col("chunk_seq") / per))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        at = self._folder("entries", batch)
        out.repartition(n, "block").sortWithinPartitions("block", "chunk_seq", "entry_no").write.partitionBy("block").option("compression", "zstd").parquet(at)
        written = self._parquet("entries", ENTRY_SCHEMA, [batch]) if any(f for _, f, *_ in files.listing(self.spark, at)) else None
        if written is None:
            files.delete(self.spark, at)
            return None, batch
        rows, raw, first, last, last_entry = written.agg(F.count("*"), F.sum(F.octet_length("text") + 1), F.min("chunk_seq"), F.max("chunk_seq"), F.max("entry_no")).first()
        # Parquet does not say what a chunk takes of a file: its share by length.
        share = files.total_size(self.spark, at) / max(1, raw)
        C.chunk_index(written).withColumn("comp_len", F.ceil(F.col("uncomp_len") * share)).write.parquet(self._folder("chunks", batch))
        C.chunk_tokens(written).write.parquet(self._folder("tokens", batch))
        return {"name": batch, "first": first, "last": last, "entries": rows, "last_entry": last_entry}, batch

    def _added(self, body: dict, staged: dict) -> dict:
        batch = {k: staged[k] for k in ("name", "first", "last")}
        return {**body, "batches": [*body["batches"], batch], "next_seq": staged["last"] + 1, "next_entry": staged["last_entry"] + 1}

    # ---- verbs that write ------------------------------------------------------------------------

    def _chunked(self, entries: DataFrame, body: dict, chunk_size: int) -> DataFrame:
        """entries (store_id, entry_no, ...) numbered on from the store's last, a chunk for each chunk_size bytes before an entry."""
        size = F.octet_length("text") + 1
        out = scanned(entries, sums={"__upto": size}, order="entry_no").drop("__block")
        return out.withColumn("chunk_seq", C.fixed_chunks(F.col("__upto") - size, chunk_size) + body["next_seq"]).withColumn("entry_no", F.col("entry_no") + body["next_entry"])

    def ingest(self, lines: DataFrame, chunk_size: int = 256 << 10) -> int:
        """Adds the lines (pos, line) that the store does not hold; returns how many entries are new.

        Stamps are inherited, the overlap with what is stored is dropped as a bag, and chunk numbers
        go on from the last. Refused are lines that start before all that is stored, and more than a
        thousand lines before the first stamp. Of what is stored, only chunks that the overlap meets are read.
        """
        version, body = self._last()
        facts = body["facts"]
        sid = facts["id"]
        stamp = stamp_millis(F.col("line"), facts.get("timestamp_regex"), facts.get("timestamp_format"))
        source = files.saved(lines.select(F.lit(sid).alias("store_id"), F.col("pos").alias("line_no"), "line", stamp.alias("ts_ms")), "source")
        if not leading(source).isEmpty():
            raise ValueError("more than a thousand lines stand before the first stamp")
        new = inherit_stamps(source).withColumnRenamed("line_no", "pos")
        chunks = self._table("chunks", CHUNK_SCHEMA, body)
        start = new.agg(F.min_by("eff_ms", F.when(F.col("eff_ms").isNotNull(), F.col("pos")))).first()[0]
        first = chunks.agg(F.min("first_write_ms")).first()[0]
        if start is not None and first is not None and start < first:
            raise ValueError("the lines start before everything the store holds; ingest in order of time, or to a new store")
        if first is not None:
            overlap = C.follow_from(chunks, start) if start is not None else chunks
            stored = self._read(overlap, body).select("store_id", "chunk_seq", F.explode(F.split("text", "\n")).alias("line"), F.col("wf_ms").alias("eff_ms"))
            new = overlap_dedup(new, stored, chunks)
        new = new.withColumnRenamed("pos", "line_no")
        grouped = group_entries(new.select("store_id", "line_no", "line", "ts_ms", "eff_ms"))
        grouped = grouped.select("store_id", "entry_no", "ts_ms", F.col("eff_ms").alias("wf_ms"), F.col("eff_ms").alias("wl_ms"), "text")
        staged, _ = self._stage(self._chunked(grouped, body, chunk_size).select(*[c.split()[0] for c in ENTRY_SCHEMA.split(", ")[:-1]]), body["chunks_per_file"])
        if staged is None:
            return 0
        self._commit(self._added(body, staged), version)
        return staged["entries"]

    def append(self, lines: DataFrame, now_ms: int | None = None, chunk_size: int = 256 << 10, source: str | None = None, number: int | None = None) -> int:
        """Adds lines (pos, line) as they come, written now; returns how many entries are new.

        Each call closes its chunks. With source and number, a number that was added before is passed
        over, so that a writer that starts again adds each of its batches once.
        """
        version, body = self._last()
        if source is not None and number is not None and body["sources"].get(source, -1) >= number:
            return 0
        facts = body["facts"]
        now = int(time.time() * 1000) if now_ms is None else now_ms
        stamp = stamp_millis(F.col("line"), facts.get("timestamp_regex"), facts.get("timestamp_format"))
        grouped = group_entries(lines.select(F.lit(facts["id"]).alias("store_id"), F.col("pos").alias("line_no"), "line", stamp.alias("ts_ms")))
        grouped = grouped.select("store_id", "entry_no", "ts_ms", F.lit(now).cast("long").alias("wf_ms"), F.lit(now).cast("long").alias("wl_ms"), "text")
        staged, _ = self._stage(self._chunked(grouped, body, chunk_size).select(*[c.split()[0] for c in ENTRY_SCHEMA.split(", ")[:-1]]), body["chunks_per_file"])
        if staged is not None:
            body = self._added(body, staged)
        if source is not None and number is not None:
            body = {**body, "sources": {**body["sources"], source: number}}
        if staged is not None or source is not None:
            self._commit(body, version)
        return staged["entries"] if staged else 0

    def take_records(self, records: DataFrame, heads: list[dict] | None = None) -> int:
        """Adds a record stream (sources.records): all of it, in its order, or nothing where it is truncated.

        heads are the fields of stream-start records: their selection and stages go to the manifest.
        """
        version, body = self._last()
        sid, now = body["facts"]["id"], int(time.time() * 1000)
        when = F.coalesce("wl_ms", "ts_ms", F.lit(now))
        rows = records.select(F.lit(sid).alias("store_id"), F.monotonically_increasing_id().alias("entry_no"), "ts_ms", F.coalesce("wf_ms", when).alias("wf_ms"), when.alias("wl_ms"), F.decode("payload", "UTF-8").alias("text"))
        # The whole stream is read before anything is staged: a truncated one fails here.
        rows = files.saved(rows, "records")
        staged, _ = self._stage(self._chunked(rows, body, 256 << 10).select(*[c.split()[0] for c in ENTRY_SCHEMA.split(", ")[:-1]]), body["chunks_per_file"])
        if staged is not None:
            body = self._added(body, staged)
        for h in heads or []:
            echo = {"window_from": h.get("from", [None])[0], "window_to": h.get("to", [None])[0], "stages": "; ".join(h.get("stage", [])) or None}
            body = {**body, "facts": {**body["facts"], **{k: v for k, v in echo.items() if v is not None}}}
        self._commit(body, version)
        return staged["entries"] if staged else 0

    def _drop(self, upto: int, version: int, body: dict) -> None:
        """Takes chunks up to and with number upto out of the store; files that hold no other chunk are deleted."""
        gone = self._table("chunks", CHUNK_SCHEMA, body).where(F.col("seq") <= upto).agg(F.count("*"), F.sum("uncomp_len")).first()
        left = [b for b in body["batches"] if b["last"] > upto]
        new = {**body, "batches": left, "first_seq": upto + 1, "dropped_chunks": body["dropped_chunks"] + gone[0], "dropped_bytes": body["dropped_bytes"] + (gone[1] or 0)}
        self._commit(new, version)
        for b in body["batches"]:
            if b["last"] <= upto:
                for name in ("entries", "chunks", "tokens"):
                    files.delete(self.spark, self._folder(name, b["name"]))
            elif b["first"] <= upto:
                for name, folder, *_ in files.listing(self.spark, self._folder("entries", b["name"])):
                    if folder and name.startswith("block=") and (int(name[6:]) + 1) * body["chunks_per_file"] - 1 <= upto:
                        files.delete(self.spark, f"{self._folder('entries', b['name'])}/{name}")

    def trim(self, now_ms: int | None = None, followers: DataFrame | None = None, dry_run: bool = False) -> dict:
        """Enforces retention once: the longest head that age, size or interest lets go. dry_run only tells what would go.

        followers: (name, store_id, retaining, seq). Gives {by_age, by_size, by_interest, drop}.
        """
        version, body = self._last()
        facts, now = body["facts"], int(time.time() * 1000) if now_ms is None else now_ms
        chunks = self._table("chunks", CHUNK_SCHEMA, body)
        ids = self.spark.createDataFrame([(facts["id"], body["next_seq"])], "store_id string, next_seq long")
        floors = S.interest_floor(followers, ids) if followers is not None else ids.select("store_id", F.lit(None).cast("long").alias("floor"))
        cutoff = now - parse_duration(facts["retain"]) if "retain" in facts else 0
        budget = parse_size(facts["retain_size"]) if "retain_size" in facts else 1 << 62
        found = S.retention_drop(chunks, floors, cutoff, budget).first()
        out = {k: int(found[k]) if found else 0 for k in ("by_age", "by_size", "by_interest", "drop")}
        if out["drop"] and not dry_run:
            upto = chunks.orderBy("seq").limit(out["drop"]).agg(F.max("seq")).first()[0]
            self._drop(upto, version, body)
        return out

    def rotate(self, cutoff_ms: int, dest: Store | None = None) -> int:
        """Moves the chunks at the front that all end before cutoff_ms to dest, or deletes them; returns how many.

        dest takes them on from its last number, and must hold nothing that was written later.
        """
        version, body = self._last()
        run = files.saved(C.leading_run(self._table("chunks", CHUNK_SCHEMA, body), cutoff_ms), "run")
        n, upto, first = run.agg(F.count("*"), F.max("seq"), F.min("first_write_ms")).first()
        if not n:
            return 0
        if dest is not None:
            there, theirs = dest._last()
            newest = dest.chunks().agg(F.max("last_write_ms")).first()[0]
            if newest is not None and newest > first:
                raise ValueError(f"{dest.path} holds entries written after the first that would be moved")
            shift, base = theirs["next_seq"] - body["first_seq"], theirs["next_entry"]
            low = self._read(run, body).agg(F.min("entry_no")).first()[0] or 0
            moved = self._read(run, body).withColumns({"store_id": F.lit(theirs["facts"]["id"]), "chunk_seq": F.col("chunk_seq") + shift, "entry_no": F.col("entry_no") - low + base})
            staged, _ = dest._stage(moved, theirs["chunks_per_file"])
            dest._commit(dest._added(theirs, staged), there)
        self._drop(upto, version, body)
        return n

    def reindex(self) -> int:
        """Adds token rows for chunks that the index does not cover; returns how many."""
        version, body = self._last()
        todo = C.uncovered(self._table("chunks", CHUNK_SCHEMA, body), self._table("tokens", TOKEN_SCHEMA, body))
        todo = files.saved(todo, "uncovered")
        n = todo.count()
        if n:
            # Rows for the last batch's table; a chunk has one row whichever batch holds it.
            C.chunk_tokens(self._read(todo, body)).write.mode("append").parquet(self._folder("tokens", body["batches"][-1]["name"]))
        return n

    # ---- verbs that read -------------------------------------------------------------------------

    def selected(self, start: int | None = None, end: int | None = None, predicates: Predicates | None = None, widen_ms: int = C.WIDEN_MS, body: dict | None = None) -> DataFrame:
        """The chunks that may hold what is asked for. Index and chunks are of one manifest, and chunks without tokens may hold anything."""
        body = body or self.manifest()
        chunks = self._table("chunks", CHUNK_SCHEMA, body).where(C.overlaps(start, end, widen_ms))
        if predicates is not None and any(predicates.required()):
            chunks = chunks.join(self._table("tokens", TOKEN_SCHEMA, body), ["store_id", "seq"], "left").where(predicates.chunk(F.col("tokens"))).drop("tokens")
        return chunks

    def query(self, start: int | None = None, end: int | None = None, predicates: Predicates | None = None, max_n: int | None = None, tail: int | None = None, ordered: bool = True) -> DataFrame:
        """Entries of the window that match, in order. Only the folders of selected chunks are read."""
        validate(start, end, tail=tail, max_n=max_n)
        body = self.manifest()
        chunks = self.selected(start, end, predicates, body=body)
        if tail is not None:
            chunks = C.tail(chunks, tail)
        out = self._read(files.saved(chunks.select("store_id", "seq"), "selected"), body).where(in_window(F.col("ts_ms"), start, end))
        if predicates is not None:
            out = out.where(predicates.entry(F.col("text")))
        if max_n is not None:
            return out.orderBy("chunk_seq", "entry_no").limit(max_n)
        return out.orderBy("chunk_seq", "entry_no") if ordered else out

    def read_cost(self, start: int | None = None, end: int | None = None, predicates: Predicates | None = None) -> DataFrame:
        """(chunks_read, chunks_total, entries_read): what a query reads of the store."""
        body = self.manifest()
        chunks = self.selected(start, end, predicates, body=body)
        total = self._table("chunks", CHUNK_SCHEMA, body).agg(F.count("*").alias("chunks_total"))
        return chunks.agg(F.count("*").alias("chunks_read"), F.coalesce(F.sum("n_entries"), F.lit(0)).alias("entries_read")).join(total).select("chunks_read", "chunks_total", "entries_read")

    def info(self) -> dict:
        """What a store is: declared facts, vital signs, what was dropped."""
        body = self.manifest()
        chunks, tokens = self._table("chunks", CHUNK_SCHEMA, body), self._table("tokens", TOKEN_SCHEMA, body)
        row = chunks.agg(F.count("*").alias("chunks"), F.sum("n_entries").alias("entries"), F.sum("uncomp_len").alias("bytes"), F.sum("comp_len").alias("stored_bytes"), F.min("first_write_ms").alias("first_ms"), F.max("last_write_ms").alias("last_ms")).first().asDict()
        row = {k: v if v is not None or k.endswith("_ms") else 0 for k, v in row.items()}
        ratio = round(row["bytes"] / row["stored_bytes"], 1) if row["stored_bytes"] else None
        covered = row["chunks"] - C.uncovered(chunks, tokens).count()
        return {"facts": body["facts"], **row, "ratio": ratio, "first_seq": body["first_seq"], "next_seq": body["next_seq"], "indexed_chunks": covered, "dropped_chunks": body["dropped_chunks"], "dropped_bytes": body["dropped_bytes"]}

    def export(self, path: str, start: int | None = None, end: int | None = None) -> Store:
        """A new store of the whole chunks that meet the window, with its lineage; an empty one is a store too."""
        body = self.manifest()
        other = Store(self.spark, path.rstrip("/"))
        made = {"id": str(uuid.uuid4()), **derived_facts(body["facts"], "export", start, end)}
        fresh = {**body, "facts": made, "batches": [], "next_seq": 0, "next_entry": 0, "first_seq": 0, "dropped_chunks": 0, "dropped_bytes": 0, "sources": {}}
        keep = files.saved(self.selected(start, end, widen_ms=0, body=body), "kept")
        first = keep.agg(F.min("seq")).first()[0] or 0
        out = self._read(keep, body).withColumns({"store_id": F.lit(made["id"]), "chunk_seq": F.col("chunk_seq") - first})
        staged, _ = other._stage(out, body["chunks_per_file"])
        other._commit(other._added(fresh, staged) if staged else fresh, 0)
        return other


def fleet(stores: list[Store], max_n: int | None = None, **query) -> DataFrame:
    """Entries of several stores in the order of a head-of-queue merge, each with its store as src_idx; max_n is shared by all."""
    ids = [s.facts["id"] for s in stores]
    entries = chunks = None
    for s in stores:
        e, c = s.query(**query, ordered=False), s.chunks()
        entries, chunks = (e, c) if entries is None else (entries.unionByName(e), chunks.unionByName(c))
    merged = O.fleet_merge(entries, chunks, ids)
    return O.first_n(merged, max_n) if max_n is not None else merged.orderBy(*O.order_of())
