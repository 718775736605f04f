"""The record stream: typed records between NUL bytes, as a codec and as a Spark data source.

A stream without its stream-end record is truncated and refused; nothing of it is shown.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# The framing of version 1.
RS, US, NUL = b"\x1e", b"\x1f", b"\x00"
VERSION = "1"
NUMBERS = ("ts", "wf", "wl", "chunk")
SCHEMA = "src string, ts_ms long, wf_ms long, wl_ms long, chunk_seq long, payload binary"


class StreamError(ValueError):
    pass


def is_record_stream(head: bytes) -> bool:
    return head.startswith(RS + b"stream-start")


def read_stream(data: bytes) -> Iterator[tuple[str, dict, bytes | None]]:
    """(kind, fields, payload of entries); unknown kinds and fields pass by, errors and truncation raise."""
    at, complete = 0, False
    while at < len(data):
        end = data.find(NUL, at)
        if end < 0:
            raise StreamError("record stream truncated inside a record")
        body, at = data[at:end], end + 1
        if body[:1] != RS:
            raise StreamError("not a record stream: a record without its mark")
        kind, *parts = body[1:].split(US)
        kind = kind.decode("utf-8", "replace")
        fields: dict[str, list[str]] = {}
        for p in parts:
            k, eq, v = p.decode("utf-8", "replace").partition("=")
            if eq:
                fields.setdefault(k, []).append(v)
        if kind == "stream-start" and fields.get("v", [""])[0] != VERSION:
            raise StreamError(f"record stream version {fields.get('v', [''])[0]!r} is not known")
        payload = None
        if kind == "entry":
            size = fields.get("len", ["x"])[0]
            if not size.isdigit():
                raise StreamError("an entry without its length")
            n = int(size)
            if at + n + 1 > len(data):
                raise StreamError("record stream truncated inside an entry")
            payload = data[at : at + n]
            if data[at + n : at + n + 1] != NUL:
                raise StreamError("framing error: a payload does not end where its length says")
            at += n + 1
        complete = complete or kind == "stream-end"
        if kind in ("stream-start", "source", "entry", "stream-end"):
            yield kind, fields, payload
    if not complete:
        raise StreamError("record stream truncated: no stream-end")


def _number(fields: dict, key: str) -> int | None:
    v = fields.get(key, [""])[0]
    return int(v) if v.isdigit() else None


def rows_of(data) -> Iterator[tuple]:
    """Rows of SCHEMA of bytes or a mapped file; the whole stream is checked before the first is shown."""
    for _ in read_stream(data):
        pass
    single = None
    for kind, f, payload in read_stream(data):
        if kind == "source":
            single = f.get("path", [None])[0] if single is None else ""
        elif kind == "entry":
            src = f.get("src", [None])[0] or single or None
            yield (src, *(_number(f, k) for k in NUMBERS), payload)


def entries_of(data: bytes) -> list[tuple]:
    return list(rows_of(data))


def head_of(data) -> dict:
    """The fields of a stream's first record: its version, selection, sources and stages."""
    return next(read_stream(data))[1]


def read_records(spark, path: str):
    """The rows of SCHEMA of record streams at path, in any store that Spark reads, a task for each file."""

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                rows = list(rows_of(bytes(data)))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({c: "Int64" for c in ("ts_ms", "wf_ms", "wl_ms", "chunk_seq")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def _record(kind: str, pairs: list[tuple[str, object]]) -> bytes:
    out = RS + kind.encode()
    for k, v in pairs:
        if v is None:
            continue
        b = str(v).encode()
        if NUL in b or US in b:
            raise StreamError(f"the value of {k} holds a separator")
        out += US + k.encode() + b"=" + b
    return out + NUL


def write_stream(rows: list[tuple], selection: list[tuple[str, object]] | None = None, sources: list[tuple[str, int | None, int | None]] | None = None, stages: list[str] | None = None, dropped: int = 0) -> bytes:
    """A whole stream of rows of SCHEMA. selection: from, to, has and any; sources: (path, kept, total); dropped: entries read and left out."""
    if sources is None:
        sources = [(s, None, None) for s in dict.fromkeys(r[0] for r in rows) if s is not None]
    out = [_record("stream-start", [("v", VERSION), *(selection or []), ("sources", len(sources)), *(("stage", s) for s in stages or [])])]
    out += [_record("source", [("path", p), ("kept", k), ("total", t)]) for p, k, t in sources]
    for src, ts, wf, wl, chunk, payload in rows:
        out += [_record("entry", [("len", len(payload)), ("ts", ts), ("wf", wf), ("wl", wl), ("chunk", chunk), ("src", src if len(sources) > 1 else None)]), payload, NUL]
    kept, total = [s[1] for s in sources], [s[2] for s in sources]
    read = [("chunks_read", sum(kept)), ("chunks_total", sum(total))] if sources and None not in kept + total else []
    out.append(_record("stream-end", [("entries", len(rows)), ("dropped", dropped), *read]))
    return b"".join(out)


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class RecordStreamSource(DataSource):
    """spark.read.format("tidelog-records").option("paths", "a,b"): one task per stream.

    Paths are local to the executors, or on a mount that all share; read_records() reads from any store.
    """

    @classmethod
    def name(cls) -> str:
        return "tidelog-records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader([p for p in self.options["paths"].split(",") if p])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_Part(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            yield from rows_of(data)


class _Written(WriterCommitMessage):
    def __init__(self, path: str, final: str):
        self.path, self.final = path, final


class _Writer(DataSourceWriter):
    """One stream per task, under a hidden name until all tasks are done."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows):
        import os
        import uuid

        os.makedirs(self.path, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.records"
        hidden = os.path.join(self.path, f".{name}")
        with open(hidden, "wb") as f:
            f.write(write_stream([tuple(r) for r in rows]))
        return _Written(hidden, os.path.join(self.path, name))

    def commit(self, messages):
        import os

        for m in messages:
            if m is not None:
                os.rename(m.path, m.final)

    def abort(self, messages):
        import contextlib
        import os

        for m in messages:
            if m is not None:
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(m.path)
