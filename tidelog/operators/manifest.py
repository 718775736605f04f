"""Manifests: the declared facts of a store, and what a derived store takes over."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys with a meaning of their own.
BOOLEANS = ("index", "wal", "timestamp_utc", "retain_unconsumed")
SETTINGS = ("retain", "retain_size", "retain_unconsumed", "index", "wal")
CONTENT = ("timestamp_regex", "timestamp_format", "timestamp_utc")
LINEAGE = ("derived_from", "derived_op", "window_from", "window_to", "stages")
RESERVED = ("id", "created", *SETTINGS, *CONTENT, *LINEAGE)
MAX_ATTRS, MAX_KEY, MAX_VALUE = 32, 64, 256
SHORT_NAMES = {"service.name": "service", "host.name": "host"}


def provenance(facts: Column) -> Column:
    """The facts that are neither identity, settings, format nor lineage."""
    return F.map_filter(facts, lambda k, _: ~k.isin(*RESERVED))


def derived(facts: Column, op: str, start: Column | None = None, end: Column | None = None) -> Column:
    """The manifest of a store made from another: all but identity and settings, and how it was made."""
    kept = F.map_filter(facts, lambda k, _: ~k.isin("id", "created", *SETTINGS, *LINEAGE))
    pairs = [F.lit("derived_from"), F.element_at(facts, F.lit("id")), F.lit("derived_op"), F.lit(op)]
    for name, value in (("window_from", start), ("window_to", end)):
        if value is not None:
            pairs += [F.lit(name), value.cast("string")]
    return F.map_concat(kept, F.create_map(*pairs))


def derived_facts(facts: dict, op: str, start: int | None = None, end: int | None = None) -> dict:
    """derived() for one store's facts; an open end of the window is left out."""
    kept = {k: v for k, v in facts.items() if k not in ("id", "created", *SETTINGS, *LINEAGE)}
    window = {"window_from": start, "window_to": end}
    return {**kept, "derived_from": facts["id"], "derived_op": op, **{k: str(v) for k, v in window.items() if v is not None}}


def seeded(attrs: Column) -> Column:
    """Facts from stream attributes: the first MAX_ATTRS by name of fitting length, common names shortened."""
    fit = F.map_filter(attrs, lambda k, v: (F.length(k) <= MAX_KEY) & (F.length(v) <= MAX_VALUE) & ~k.isin(*RESERVED))
    pairs = F.slice(F.array_sort(F.map_entries(fit)), 1, MAX_ATTRS)
    short = lambda k: F.coalesce(*[F.when(k == a, F.lit(b)) for a, b in SHORT_NAMES.items()], k)
    return F.map_from_entries(F.transform(pairs, lambda e: F.struct(short(e["key"]), e["value"])))


def checked(facts: dict) -> dict:
    """facts with their types tested; the text "true" is no boolean."""
    for k, v in facts.items():
        if not k or any(c in k for c in "=\0\x1f"):
            raise ValueError(f"{k!r} is no name for a fact")
        want = bool if k in BOOLEANS else str
        if not isinstance(v, want):
            raise ValueError(f"{k} is to be {'true or false' if want is bool else 'a text'}, not {v!r}")
    if facts.get("retain_unconsumed") and not facts.get("retain_size"):
        raise ValueError("retain_unconsumed needs retain_size, so that a stalled follower cannot fill the disk")
    if ("timestamp_regex" in facts) != ("timestamp_format" in facts):
        raise ValueError("timestamp_regex and timestamp_format go together")
    return facts
