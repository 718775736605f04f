"""Fluentd Forward messages: a msgpack codec, the three modes, times and payloads."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Unsupported(ValueError):
    pass


class Ext(tuple):
    """(type, data) of a msgpack extension."""


def unpack(buf: bytes, at: int = 0):
    """(value, end) of the msgpack value at a place."""
    if at >= len(buf):
        raise ValueError("msgpack: truncated")
    b, at = buf[at], at + 1

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(buf):
            raise ValueError("msgpack: truncated")
        at += n
        return buf[at - n : at]

    def number(n: int, signed: bool = False) -> int:
        return int.from_bytes(take(n), "big", signed=signed)

    def items(n: int) -> list:
        nonlocal at
        out = []
        for _ in range(n):
            v, at = unpack(buf, at)
            out.append(v)
        return out

    def pairs(n: int) -> list[tuple]:
        flat = items(2 * n)
        return [("map", list(zip(flat[::2], flat[1::2])))]

    if b < 0x80:
        return b, at
    if b < 0x90:
        return pairs(b & 15)[0], at
    if b < 0xA0:
        return items(b & 15), at
    if b < 0xC0:
        return take(b & 31).decode("utf-8", "replace"), at
    if b >= 0xE0:
        return b - 256, at
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[b], at
    if 0xC4 <= b <= 0xC6:
        return take(number(1 << (b - 0xC4))), at
    if 0xC7 <= b <= 0xC9:
        n = number(1 << (b - 0xC7))
        return Ext((number(1, True), take(n))), at
    if b in (0xCA, 0xCB):
        return struct.unpack(">f" if b == 0xCA else ">d", take(4 if b == 0xCA else 8))[0], at
    if 0xCC <= b <= 0xCF:
        return number(1 << (b - 0xCC)), at
    if 0xD0 <= b <= 0xD3:
        return number(1 << (b - 0xD0), True), at
    if 0xD4 <= b <= 0xD8:
        n = 1 << (b - 0xD4)
        return Ext((number(1, True), take(n))), at
    if 0xD9 <= b <= 0xDB:
        return take(number(1 << (b - 0xD9))).decode("utf-8", "replace"), at
    if b in (0xDC, 0xDD):
        return items(number(2 if b == 0xDC else 4)), at
    if b in (0xDE, 0xDF):
        return pairs(number(2 if b == 0xDE else 4))[0], at
    raise ValueError(f"msgpack: byte {b:#x} begins no value")


def time_millis(v, now_ms: int) -> int:
    """Seconds, a float or an event time to milliseconds; what is no time is now."""
    if isinstance(v, bool) or v is None:
        return now_ms
    if isinstance(v, int):
        return v * 1000 if v > 0 else now_ms
    if isinstance(v, float):
        return int(v * 1000) if v > 0 else now_ms
    if isinstance(v, Ext) and v[0] == 0 and len(v[1]) == 8:
        s, ns = struct.unpack(">II", v[1])
        return s * 1000 + ns // 1_000_000 if s or ns else now_ms
    return now_ms


def _is_map(v) -> bool:
    return isinstance(v, tuple) and not isinstance(v, Ext) and len(v) == 2 and v[0] == "map"


def plain(v):
    """A msgpack value as JSON would have it."""
    if _is_map(v):
        return {k if isinstance(k, str) else k.decode("utf-8", "replace") if isinstance(k, bytes) else str(k): plain(x) for k, x in v[1]}
    if isinstance(v, Ext):
        return {"ext_type": v[0], "ext_data_len": len(v[1])}
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, bytes):
        return v.decode("utf-8", "replace")
    if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
        return None
    return v


def payload(record, key: str) -> str:
    """The text under key, or the whole record as compact JSON; one newline at its end is dropped."""
    p = plain(record)
    text = p[key] if isinstance(p, dict) and isinstance(p.get(key), str) else json.dumps(p, separators=(",", ":"), ensure_ascii=False)
    return text.removesuffix("\n")


def decode_message(buf: bytes, now_ms: int) -> tuple[str, list[tuple[int, object]], str | None]:
    """(tag, [(time, record)], chunk to acknowledge) of a message in any mode."""
    msg, _ = unpack(buf)
    if not isinstance(msg, list) or len(msg) < 2:
        raise ValueError("a message is an array of a tag and more")
    tag, second = msg[0], msg[1]
    if not isinstance(tag, str):
        raise ValueError("a tag is a string")

    def pair(p) -> tuple[int, object]:
        if not isinstance(p, list) or len(p) < 2:
            raise ValueError("an entry is [time, record]")
        return time_millis(p[0], now_ms), p[1]

    if isinstance(second, (int, float, Ext)) and not isinstance(second, bool):
        if len(msg) < 3:
            raise ValueError("a message of one record needs [tag, time, record]")
        entries, option = [(time_millis(second, now_ms), msg[2])], msg[3] if len(msg) > 3 else None
    elif isinstance(second, list):
        entries, option = [pair(p) for p in second], msg[2] if len(msg) > 2 else None
    elif isinstance(second, (str, bytes)):
        option = msg[2] if len(msg) > 2 else None
        if _is_map(option) and plain(option).get("compressed") == "gzip":
            raise Unsupported("compressed packed messages")
        blob, at, entries = second.encode() if isinstance(second, str) else second, 0, []
        while at < len(blob):
            p, at = unpack(blob, at)
            entries.append(pair(p))
    else:
        raise ValueError("element 1 is no time, array or string")
    chunk = plain(option).get("chunk") if _is_map(option) else None
    return tag, entries, chunk if isinstance(chunk, str) else None


def decoded(messages: DataFrame, now_ms: int, key: str = "log", column: str = "value") -> DataFrame:
    """(tag, ts_ms, text, record) of messages in a binary column; a message that cannot be read fails the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(tag, t, payload(r, key), json.dumps(plain(r), separators=(",", ":"), ensure_ascii=False)) for v in pdf[column] for tag, es, _ in [decode_message(bytes(v), now_ms)] for t, r in es]
            yield pd.DataFrame(rows, columns=["tag", "ts_ms", "text", "record"])

    return messages.select(column).mapInPandas(run, "tag string, ts_ms long, text string, record string")


def time_column(seconds: Column, number: Column, now_ms: Column) -> Column:
    """The same times from typed columns: whole seconds, else a float, else now."""
    return F.when(seconds > 0, seconds * 1000).when(number > 0, (number * 1000).cast("long")).otherwise(now_ms)


def payload_column(record_json: Column, key: str) -> Column:
    """The same payload from a record given as a map of strings in JSON."""
    return F.regexp_replace(F.coalesce(F.get_json_object(record_json, f"$.{key}"), record_json), r"\n\z", "")
