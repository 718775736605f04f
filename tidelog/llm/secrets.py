"""Secret scan with structural confirmation.

Base spans come from the fixed patterns. Beside them, encoded candidates are decoded and must have
the structure of a secret before they are reported: a signed token's header and payload must decode to
JSON with an algorithm, key material (PEM, base64 or hex) must parse as nested DER whose lengths fill
it exactly and whose elements are those of a private key, an SSH key as an openssh-key-v1 container with
its private section, and base64 or hex text must itself hold a secret, at any depth of encoding.
Public keys, certificates and signatures are none. Candidates have 24 characters or more; tokens are
three base64url parts joined by dots, whatever their header begins with.

Defined results: null text is empty; an empty text has no spans, and base_sha256 is that of the empty
string; a repeated row is scanned again; an empty table gives an empty result; extra columns are ignored.
Spans are of code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

BASE = ("assign", "access", "hex")
#: Base kinds first, then those of the method; the order of spans that start together.
KINDS = (*BASE, "jwt", "pem", "der", "ssh", "encoded")
_RANK = {k: i for i, k in enumerate(KINDS)}

_any_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_KEYS = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile("(" + "|".join(map(_any_case, _KEYS[:4])) + "|" + _any_case("api") + "_?" + _any_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_HEX = re.compile("[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
_HEXES = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{24,}|[0-9A-F]{24,})(?![0-9A-Za-z])")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return out


def unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, int, int, int]] | None:
    """(depth, tag, start, end) of the elements that fill data exactly, nested ones after theirs; None if they don't."""
    out: list[tuple[int, int, int, int]] = []
    todo = [(0, 0, len(data))]
    while todo:
        depth, at, end = todo.pop()
        if at == end:
            continue
        if at + 2 > end:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 0x80:
                return None
        if at + n > end:
            return None
        out.append((depth, tag, at, at + n))
        todo.append((depth, at + n, end))
        if tag & 0x20:
            todo.append((depth + 1, at, at + n))
    return out


# DER tags.
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def is_der_key(data: bytes) -> bool:
    """One sequence that fills data and is a private key: PKCS#1 or DSA (a version and numbers), PKCS#8 (version, algorithm,
    octets), SEC 1 (version, octets) or an encrypted PKCS#8 key (algorithm, octets)."""
    if len(data) < 16 or data[0] != SEQUENCE:
        return False
    items = der_items(data)
    if not items or [x for x in items if x[0] == 0] != items[:1]:
        return False
    top = [x for x in items if x[0] == 1]
    tags = [t for _, t, _, _ in top]
    named = lambda x: any(d == 2 and t == OID and x[2] <= p < x[3] for d, t, p, _ in items)
    long = lambda x, n: x[3] - x[2] >= n
    if tags == [SEQUENCE, OCTETS]:
        return named(top[0]) and long(top[1], 16)
    if tags[:1] != [INTEGER] or data[top[0][2] : top[0][3]] not in (b"\0", b"\1"):
        return False
    if tags[1:3] == [SEQUENCE, OCTETS]:
        return named(top[1]) and long(top[2], 16)
    if tags[1:2] == [OCTETS]:
        return long(top[1], 16)
    return len(tags) >= 6 and set(tags[:6]) == {INTEGER} and long(top[1], 16)


def is_ssh_key(data: bytes) -> bool:
    """An openssh-key-v1 container whose lengths fill it: cipher, KDF and its options, public keys, and a private section."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields, keys = len(magic), [], None
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if len(fields) == 3 and keys is None:
            keys = n
            continue
        if at + n > len(data):
            return False
        fields.append(n)
        at += n
    return at == len(data) and keys is not None and 0 < keys == len(fields) - 4 and fields[-1] >= 16


def is_signed_token(s: str) -> bool:
    head, body, _ = s.split(".")[:3]
    try:
        h, b = json.loads(unbase64(head) or b""), json.loads(unbase64(body) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(b, dict)


def readable(data: bytes) -> str | None:
    """data as text, if it is UTF-8 without control characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if all(c >= " " or c in "\t\n\r" for c in text) and "\x7f" not in text else None


def confirmed(text: str) -> list[Span]:
    """Spans that decoding proves to be secrets. What decodes to text is searched in turn; it is shorter each time."""
    out: list[Span] = []
    if text.count(".") >= 2:
        out += [("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if is_signed_token(m.group())]
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = unbase64("".join(m[2].split()))
            if data and (is_der_key(data) or is_ssh_key(data)):
                out.append(("pem", m.start(), m.end()))
    covered = [(a, b) for _, a, b in out]
    for pattern, decode in ((_B64, unbase64), (_HEXES, lambda s: bytes.fromhex(s) if len(s) % 2 == 0 else None)):
        for m in pattern.finditer(text):
            if any(a <= m.start() < b for a, b in covered):
                continue
            data = decode(m.group())
            if not data:
                continue
            if is_der_key(data):
                out.append(("der", m.start(), m.end()))
            elif is_ssh_key(data):
                out.append(("ssh", m.start(), m.end()))
            elif len(data) >= 16 and (inner := readable(data)) is not None and (base_spans(inner) or confirmed(inner)):
                out.append(("encoded", m.start(), m.end()))
    return out


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind."""
    text = text or ""
    base, more = base_spans(text), []
    # A candidate has at least 24 characters without white space.
    if text and max(map(len, text.split()), default=0) >= 24:
        base += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
        more = confirmed(text)
    elif "-----BEGIN " in text:
        more = confirmed(text)
    order = lambda s: (s[1], _RANK[s[0]], s[2])
    return sorted(base, key=order), sorted(base + more, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_confirmed, base_sha256, spans."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["text"].array:
                base, spans = scan(t)
                n = [sum(s[0] == k for s in base) for k in BASE]
                out.append((*n, len(spans) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")[1:]]).assign(doc_id=pdf["doc_id"].astype("Int64").to_numpy())[[c.split()[0] for c in schema.split(", ")]]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(run, schema)
