"""Stamps: the time that a log line states, in epoch milliseconds, null if it states none.

The first form that matches decides; a match whose value is no time leaves the line unstamped, with
no further try. Times without a zone are those of the session (UTC). Times before 1970 are none. A second
of 60 is the one after 59; a weekday that is not the date's is no time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters at the head of a line in which a stamp may stand.
HEAD = 256
# The forms.
ISO = r"^(\d{4})[.-](\d{2})[.-](\d{2})[T ](\d{2}:\d{2}:\d{2})(?:[.,:](\d{1,9}))?(Z|[+-]\d{2}:?\d{2})?"
CLF = r"\[(\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})\]"
CTIME = r"\[([A-Z][a-z]{2}) ([A-Z][a-z]{2}) ([ 0-9]\d) (\d{2}:\d{2}:\d{2})(?:\.(\d+))? (\d{4})\]"
EPOCH = r"^(\d{13}|\d{10})\b"


def _millis(ts: Column) -> Column:
    ms = F.unix_millis(ts)
    return F.when(ms >= 0, ms)


def _leap(clock: Column) -> tuple[Column, Column]:
    """(clock with a second of 60 made 59, milliseconds to add for it)."""
    last = r":60(?![0-9:])"
    return F.regexp_replace(clock, last, ":59"), F.when(F.regexp_like(clock, F.lit(last)), F.lit(1000)).otherwise(F.lit(0))


def iso_millis(head: Column) -> Column:
    g = lambda k: F.regexp_extract(head, ISO, k)
    fraction = F.when(g(5) == "", F.lit("")).otherwise(F.concat(F.lit("."), g(5)))
    zone = F.regexp_replace(g(6), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    clock, more = _leap(g(4))
    return _millis(F.concat(g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit("T"), clock, fraction, zone).try_cast("timestamp")) + more


def clf_millis(head: Column) -> Column:
    clock, more = _leap(F.regexp_extract(head, CLF, 1))
    return _millis(F.try_to_timestamp(clock, F.lit("dd/MMM/yyyy:HH:mm:ss xx"))) + more


def ctime_millis(head: Column) -> Column:
    g = lambda k: F.regexp_extract(head, CTIME, k)
    clock, more = _leap(g(4))
    second = F.try_to_timestamp(F.concat_ws(" ", g(6), g(2), F.lpad(F.trim(g(3)), 2, "0"), clock), F.lit("yyyy MMM dd HH:mm:ss"))
    second = F.when(F.date_format(second, "EEE") == g(1), second)
    return _millis(second) + more + F.when(g(5) == "", F.lit(0)).otherwise(F.rpad(F.substring(g(5), 1, 3), 3, "0").cast("int"))


def epoch_millis(head: Column) -> Column:
    n = F.regexp_extract(head, EPOCH, 1)
    return F.when(F.length(n) == 13, n.try_cast("long")).otherwise(n.try_cast("long") * 1000)


def stamp_millis(line: Column, regex: str | None = None, pattern: str | None = None) -> Column:
    """The stamp of line. A regex with one group and the pattern of that group replace the built-in forms."""
    if (regex is None) != (pattern is None):
        raise ValueError("a stamp regex and its pattern go together")
    head = F.substring(line, 1, HEAD)
    if regex is not None:
        return F.when(F.regexp_like(head, F.lit(regex)), _millis(F.try_to_timestamp(F.regexp_extract(head, regex, 1), F.lit(pattern))))
    forms = ((ISO, iso_millis), (CLF, clf_millis), (CTIME, ctime_millis), (EPOCH, epoch_millis))
    out = None
    for rx, value in forms:
        hit = F.regexp_like(head, F.lit(rx))
        out = F.when(hit, value(head)) if out is None else out.when(hit, value(head))
    return out
