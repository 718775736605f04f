"""OpenTelemetry logs: decode (JSON in columns, protobuf in a codec), lines out of records, records out of entries.

What a sender did not say stays null. A record without a body is left out.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import severity_number, severity_text, without_newline
from ..functions.times import rfc3339

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string,bytesValue:string,arrayValue:string,kvlistValue:string>"
_PAIRS = "array<struct<key:string,value:string>>"
REQUEST = f"struct<resourceLogs:array<struct<resource:struct<attributes:{_PAIRS}>,scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityText:string,body:string,attributes:{_PAIRS},traceId:string,spanId:string>>>>>>>"
RECORD_SCHEMA = "request_no long, resource map<string,string>, time_ms long, observed_ms long, severity string, body string, attrs array<struct<key:string,value:string>>"


def any_value(value: Column) -> Column:
    """The text of an AnyValue given as JSON: a scalar as itself, arrays and lists as compact JSON of texts.

    For values without arrays inside arrays; nested() and nested_pairs() read any depth.
    """

    def scalar(v: Column) -> Column:
        p = F.from_json(v, _VALUE)
        return F.coalesce(p["stringValue"], p["intValue"], p["doubleValue"], p["boolValue"], p["bytesValue"])

    p = F.from_json(value, _VALUE)
    items = F.from_json(p["arrayValue"], "struct<values:array<string>>")["values"]
    pairs = F.from_json(p["kvlistValue"], f"struct<values:{_PAIRS}>")["values"]
    as_list = F.when(p["arrayValue"].isNotNull(), F.to_json(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.coalesce(scalar(x), x))))
    as_map = F.when(p["kvlistValue"].isNotNull(), F.to_json(F.map_from_entries(F.transform(F.coalesce(pairs, F.array().cast(_PAIRS)), lambda x: F.struct(x["key"], F.coalesce(scalar(x["value"]), x["value"]))))))
    return F.coalesce(scalar(value), as_list, as_map, value)


def _deep(v) -> str:
    """any_value() of a parsed value, at any depth, as the binary form gives it."""
    if not isinstance(v, dict):
        return v if isinstance(v, str) else _compact(v)
    for name in ("stringValue", "intValue", "doubleValue", "boolValue", "bytesValue"):
        if v.get(name) is not None:
            x = v[name]
            return ("true" if x else "false") if isinstance(x, bool) else str(x)
    if v.get("arrayValue") is not None:
        return _compact([_deep(x) for x in v["arrayValue"].get("values") or []])
    if v.get("kvlistValue") is not None:
        return _compact({x.get("key"): _deep(x.get("value")) for x in v["kvlistValue"].get("values") or []})
    return _compact(v)


#: A value that holds an array or list inside another one.
_NESTED = r'(?s)(arrayValue|kvlistValue).*(arrayValue|kvlistValue)'


def _deep_texts(value: Column) -> Column:
    @F.pandas_udf("string")
    def texts(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else _deep(json.loads(v)))

    return texts(value)


def _deep_pairs(value: Column) -> Column:
    @F.pandas_udf(_PAIRS)
    def texts(pairs: pd.Series) -> pd.Series:
        text = lambda v: "" if v is None else _deep(json.loads(v) if v[:1] in "{[" else v)
        return pairs.map(lambda ps: None if ps is None else [{"key": p["key"], "value": text(p["value"])} for p in ps])

    return texts(value)


def nested(value: Column) -> Column:
    """any_value() at any depth; only values with arrays in arrays leave the JVM."""
    deep = F.regexp_like(value, F.lit(_NESTED))
    return F.when(deep, _deep_texts(F.when(deep, value))).otherwise(any_value(value))


def nested_pairs(pairs: Column) -> Column:
    """(key, text) of attributes, their values at any depth."""
    pairs = F.filter(F.coalesce(pairs, F.array().cast(_PAIRS)), lambda x: x["key"].isNotNull())
    deep = F.exists(pairs, lambda x: F.regexp_like(F.coalesce(x["value"], F.lit("")), F.lit(_NESTED)))
    plain = F.transform(pairs, lambda x: F.struct(x["key"].alias("key"), F.coalesce(any_value(x["value"]), F.lit("")).alias("value")))
    return F.when(deep, _deep_pairs(F.when(deep, pairs))).otherwise(plain)


def nanos_to_millis(ns: Column) -> Column:
    """Nanoseconds as text or number to milliseconds; 0 and what is no number are null."""
    n = ns.cast("string").try_cast("decimal(20,0)")
    return F.when(n > 0, F.floor(n / F.lit(1_000_000).cast("decimal(20,0)")).cast("long"))


def decode_json(requests: DataFrame, column: str = "value") -> DataFrame:
    """(resource, time_ms, observed_ms, severity, body, attrs) of export requests given as JSON text; values of any depth."""
    req = F.from_json(column, REQUEST)
    logs = requests.select("*", F.explode(req["resourceLogs"]).alias("__rl"))
    # A resource is read before its records part: a record's row holds nothing of the other records.
    logs = logs.select(*requests.columns, F.map_from_entries(nested_pairs(F.col("__rl.resource.attributes"))).alias("__resource"), F.col("__rl.scopeLogs").alias("__sls"))
    logs = logs.select(*requests.columns, "__resource", F.explode("__sls").alias("__sl")).select(*requests.columns, "__resource", F.explode("__sl.logRecords").alias("__r")).where("__r.body is not null")
    ident = lambda c, k: F.when(F.regexp_like(c, F.lit("[^0]")), F.array(F.struct(F.lit(k).alias("key"), c.alias("value")))).otherwise(F.array().cast(_PAIRS))
    return logs.select(
        *requests.columns, F.col("__resource").alias("resource"), nanos_to_millis(F.col("__r.timeUnixNano")).alias("time_ms"), nanos_to_millis(F.col("__r.observedTimeUnixNano")).alias("observed_ms"),
        F.nullif(F.col("__r.severityText"), F.lit("")).alias("severity"), nested(F.col("__r.body")).alias("body"),
        F.concat(nested_pairs(F.col("__r.attributes")), ident(F.coalesce("__r.traceId", F.lit("")), "trace_id"), ident(F.coalesce("__r.spanId", F.lit("")), "span_id")).alias("attrs"),
    )


def route(resource: Column, key: str = "service.name") -> Column:
    """The stream of a resource; without a name, unknown_service."""
    return F.coalesce(F.nullif(F.trim(F.element_at(resource, key)), F.lit("")), F.lit("unknown_service"))


def record_line(ts: Column, severity: Column, body: Column, attrs: Column, stamped: Column) -> Column:
    """The log line of a record: a stamp and level only where the body lacks a stamp, attributes after it."""
    head = F.when(stamped, F.lit("")).otherwise(F.concat(rfc3339(ts), F.lit(" "), F.coalesce(F.concat(severity, F.lit(" ")), F.lit(""))))
    tail = F.array_join(F.transform(attrs, lambda a: F.concat(F.lit(" "), a["key"], F.lit("="), a["value"])), "")
    return F.concat(head, body, tail)


def rendered(entries: DataFrame) -> DataFrame:
    """entries with record, the LogRecord of each as JSON; the time is the stamp, or the first write."""
    level = severity_text(F.col("text"))
    nanos = lambda ms: F.concat(ms.cast("string"), F.lit("000000"))
    number = F.nullif(severity_number(level), F.lit(0))
    rec = F.struct(
        nanos(F.coalesce("ts_ms", "wf_ms")).alias("timeUnixNano"), nanos(F.col("wf_ms")).alias("observedTimeUnixNano"), level.alias("severityText"), number.alias("severityNumber"),
        F.struct(without_newline(F.col("text")).alias("stringValue")).alias("body"),
    )
    return entries.withColumn("record", F.to_json(rec))


def export_requests(batched: DataFrame, resource: dict[str, str]) -> DataFrame:
    """(store_id, batch_no, request): an export request per batch of rendered entries, in order."""
    attrs = json.dumps([{"key": k, "value": {"stringValue": v}} for k, v in sorted(resource.items())], separators=(",", ":"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_seq", "entry_no", "record"))), lambda r: r["record"]), ",")
    head, tail = f'{{"resourceLogs":[{{"resource":{{"attributes":{attrs}}},"scopeLogs":[{{"scope":{{"name":"tidelog"}},"logRecords":[', "]}]}]}"
    return batched.groupBy("store_id", "batch_no").agg(F.concat(F.lit(head), ordered, F.lit(tail)).alias("request"))


def delivery(status: int) -> str:
    """What an answer means to a shipper."""
    return "delivered" if 200 <= status < 300 else "retry" if status in (429, 502, 503, 504) else "permanent"


def classify(status: int, headers: dict[str, str] | None = None, body: bytes = b"") -> dict:
    """{what, rejected, message, after} of an answer: records a partial success refused, and the seconds that Retry-After asks for."""
    named = {k.lower(): v for k, v in (headers or {}).items()}
    wait = named.get("retry-after", "").strip()
    out = {"what": delivery(status), "rejected": 0, "message": None, "after": int(wait) if wait.isdigit() else None}
    if out["what"] != "delivered" or not body:
        return out
    if named.get("content-type", "").startswith(("application/x-protobuf", "application/protobuf")):
        for n, wire, v in _fields(body):
            if (n, wire) == (1, 2):
                for k, w, x in _fields(v):
                    if (k, w) == (1, 0):
                        out["rejected"] = x
                    elif (k, w) == (2, 2):
                        out["message"] = x.decode("utf-8", "replace") or None
        return out
    try:
        partial = json.loads(body).get("partialSuccess") or {}
    except (ValueError, AttributeError):
        return out
    count = str(partial.get("rejectedLogRecords", 0))
    return {**out, "rejected": int(count) if count.isdigit() else 0, "message": partial.get("errorMessage") or None}


def post(url: str, request: bytes, headers: dict[str, str] | None = None, timeout: float = 10.0, compress: bool = True) -> dict:
    """Posts a JSON export request; classify()'s answer. A connection that fails is to be tried again."""
    import gzip
    import urllib.error
    import urllib.request

    named = {"Content-Type": "application/json", **({"Content-Encoding": "gzip"} if compress else {}), **(headers or {})}
    call = urllib.request.Request(endpoint(url), gzip.compress(request) if compress else request, named, method="POST")
    try:
        with urllib.request.urlopen(call, timeout=timeout) as r:
            return classify(r.status, dict(r.headers), r.read())
    except urllib.error.HTTPError as e:
        return classify(e.code, dict(e.headers), e.read())
    except OSError as e:
        return {"what": "retry", "rejected": 0, "message": str(e), "after": None}


# The paths and kinds of body of log export over HTTP.
LOGS_PATH, JSON_KINDS, PROTOBUF_KINDS = "/v1/logs", ("application/json",), ("application/x-protobuf", "application/protobuf")
#: How many times its size a compressed body may grow.
INFLATED = 8


def intake_status(method: str, path: str, kind: str, encoding: str | None = None, length: int | None = 0, most: int = 16 << 20, inflated: int | None = None, whole: bool = True, ready: bool = True) -> int:
    """The status of an export request to a log intake, by its head, its lengths and whether it parses."""
    if method != "POST":
        return 405
    if not path.partition("?")[0].rstrip("/").endswith(LOGS_PATH):
        return 404
    if (encoding or "identity").lower() not in ("identity", "gzip") or not kind.lower().startswith(JSON_KINDS + PROTOBUF_KINDS):
        return 415
    if length is None:
        return 411
    if length > most or (inflated or 0) > most * INFLATED:
        return 413
    if not whole:
        return 400
    return 200 if ready else 503


def endpoint(url: str) -> str:
    """An endpoint with its scheme and the path of logs."""
    url = url.strip().rstrip("/")
    if "://" not in url:
        url = "http://" + url
    scheme, _, rest = url.partition("://")
    return url if "/" in rest else f"{scheme}://{rest}/v1/logs"


# ---- protobuf -------------------------------------------------------------------------------


def _fields(buf: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            if at >= len(buf) or shift > 63:
                raise ValueError("protobuf: a truncated varint")
            b = buf[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n & (1 << 64) - 1

    while at < len(buf):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            value: int | bytes = varint()
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, at = buf[at : at + n], at + n
            if len(value) < n:
                raise ValueError("protobuf: a truncated number")
        elif wire == 2:
            n = varint()
            value, at = buf[at : at + n], at + n
            if len(value) < n:
                raise ValueError("protobuf: a truncated field")
        else:
            raise ValueError(f"protobuf: wire type {wire} is not known")
        yield number, wire, value


def _compact(x) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def _any(buf: bytes) -> str:
    for n, wire, v in _fields(buf):
        if (n, wire) == (1, 2):
            return v.decode("utf-8", "replace")
        if (n, wire) == (2, 0):
            return "true" if v else "false"
        if (n, wire) == (3, 0):
            return str(v - (1 << 64) if v >> 63 else v)
        if (n, wire) == (4, 1):
            return repr(struct.unpack("<d", v)[0])
        if (n, wire) == (5, 2):
            return _compact([_any(x) for k, w, x in _fields(v) if (k, w) == (1, 2)])
        if (n, wire) == (6, 2):
            return _compact(dict(_pair(x) for k, w, x in _fields(v) if (k, w) == (1, 2)))
        if (n, wire) == (7, 2):
            return base64.b64encode(v).decode()
    return ""


def _pair(buf: bytes) -> tuple[str, str]:
    key = value = ""
    for n, wire, v in _fields(buf):
        if (n, wire) == (1, 2):
            key = v.decode("utf-8", "replace")
        elif (n, wire) == (2, 2):
            value = _any(v)
    return key, value


def _log_record(buf: bytes) -> tuple | None:
    time = seen = severity = body = None
    attrs, ids = [], []
    for n, wire, v in _fields(buf):
        if wire == 1 and n in (1, 11):
            ms = int.from_bytes(v, "little") // 1_000_000 if any(v) else None
            time, seen = (ms, seen) if n == 1 else (time, ms)
        elif (n, wire) == (3, 2):
            severity = v.decode("utf-8", "replace") or None
        elif (n, wire) == (5, 2):
            body = _any(v)
        elif (n, wire) == (6, 2):
            attrs.append(_pair(v))
        elif wire == 2 and n in (9, 10) and any(v):
            ids.append(("trace_id" if n == 9 else "span_id", v.hex()))
    return None if body is None else (time, seen, severity, body, attrs + ids)


def decode_request(buf: bytes) -> list[tuple[dict[str, str], list[tuple]]]:
    """(resource, records) of each resource of a binary export request."""
    out = []
    for n, wire, rl in _fields(buf):
        if (n, wire) != (1, 2):
            continue
        resource, records = {}, []
        for k, w, v in _fields(rl):
            if (k, w) == (1, 2):
                resource |= dict(_pair(x) for a, b, x in _fields(v) if (a, b) == (1, 2))
            elif (k, w) == (2, 2):
                records += [r for a, b, x in _fields(v) if (a, b) == (2, 2) and (r := _log_record(x)) is not None]
        out.append((resource, records))
    if not out:
        raise ValueError("not an export request: no resource logs")
    return out


def decode_protobuf(requests: DataFrame, column: str = "value") -> DataFrame:
    """The records of binary export requests, as decode_json() gives them; request_no is one request's alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = TaskContext.get().partitionId() << 33
        for pdf in batches:
            rows = [(done + k, res, t, o, s, b, [{"key": x, "value": y} for x, y in a]) for k, v in enumerate(pdf[column]) for res, recs in decode_request(bytes(v)) for t, o, s, b, a in recs]
            out = pd.DataFrame(rows, columns=["request_no", "resource", "time_ms", "observed_ms", "severity", "body", "attrs"])
            done += len(pdf)
            yield out.astype({"time_ms": "Int64", "observed_ms": "Int64"})

    return requests.select(column).mapInPandas(run, RECORD_SCHEMA)
