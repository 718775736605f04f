"""Text functions: tokens, search patterns, severity, names, payloads."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a whole run of ASCII letters and digits of this many characters; longer runs are none.
TOKEN_MIN, TOKEN_MAX = 3, 64


def tokens(text: Column) -> Column:
    """Distinct tokens of text."""
    runs = F.regexp_extract_all(text, F.lit("[0-9A-Za-z]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda t: F.length(t).between(TOKEN_MIN, TOKEN_MAX)))


def tokens_of(literal: str) -> list[str]:
    """The same for a literal, in order."""
    return list(dict.fromkeys(t for t in re.findall("[0-9A-Za-z]+", literal) if TOKEN_MIN <= len(t) <= TOKEN_MAX))


def interior_tokens(literal: str) -> list[str]:
    """Tokens of a literal bounded inside it: whole tokens of any text that contains it."""
    runs = [(m.start(), m.end()) for m in re.finditer("[0-9A-Za-z]+", literal)]
    inside = [literal[a:b] for a, b in runs if a > 0 and b < len(literal)]
    return list(dict.fromkeys(t for t in inside if TOKEN_MIN <= len(t) <= TOKEN_MAX))


def quoted(literal: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&~#])", r"\\\1", literal)


def word_pattern(literal: str) -> str:
    """A literal between non-alphanumerics or the edges of the text."""
    return rf"(?:\A|[^0-9A-Za-z]){quoted(literal)}(?:[^0-9A-Za-z]|\z)"


def checked_regex(pattern: str) -> str:
    """Patterns run in linear time elsewhere; look-around and back-references have no place here."""
    if re.search(r"\(\?<?[=!]|\\[1-9]|\\k<", pattern):
        raise ValueError(f"look-around and back-references are not supported: {pattern!r}")
    re.compile(pattern.replace(r"\z", r"\Z"))
    return pattern


# Level names and their numbers.
LEVELS = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "NOTICE": 10, "WARN": 13, "WARNING": 13, "ERROR": 17, "ERR": 17, "SEVERE": 17, "FATAL": 21, "PANIC": 21, "CRITICAL": 22, "CRIT": 22}
LEVEL_PATTERN = r"\b(TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|ERR|SEVERE|FATAL|PANIC|CRITICAL|CRIT)\b"


def severity_text(text: Column, pattern: str = LEVEL_PATTERN) -> Column:
    """The level named in the first line (its first 512 characters), null if none: group 1 of pattern, or all of it."""
    head = F.substring(F.substring_index(text, "\n", 1), 1, 512)
    group = 1 if re.compile(pattern).groups else 0
    return F.when(F.regexp_like(head, F.lit(pattern)), F.regexp_extract(head, pattern, group))


def severity_number(level: Column) -> Column:
    out = F.when(level.isNull(), F.lit(None).cast("int"))
    for number in sorted(set(LEVELS.values())):
        out = out.when(F.upper(level).isin([k for k, v in LEVELS.items() if v == number]), number)
    return out.otherwise(0)


def store_name(stream: Column) -> Column:
    """A file name for a stream: other characters become _, leading dots go, an empty name is untagged."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(stream, F.lit("")), "[^A-Za-z0-9._-]", "_"), r"^\.+", "")
    return F.concat(F.when(clean == "", F.lit("untagged")).otherwise(clean), F.lit(".log"))


def without_newline(text: Column) -> Column:
    return F.regexp_replace(text, r"\n\z", "")


def ratio(raw: Column, packed: Column) -> Column:
    return F.round(raw / packed, 1)


def signed_distance(ts: Column, first: Column, last: Column) -> Column:
    """Milliseconds by which ts lies before (negative) or after the write window; 0 inside."""
    return F.when(ts < first, ts - first).when(ts > last, ts - last).otherwise(F.lit(0))
