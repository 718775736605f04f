"""Predicates on entries, and what they imply for the chunks that hold them.

A predicate mix is one Column on entries. From the same mix comes a Column on the chunk index (an array of
distinct tokens per chunk) that is true for every chunk that can hold a match: chunks it excludes are
never read, and the answer is the same. Caseless terms, excludes and regexes imply nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import checked_regex, interior_tokens, quoted, tokens_of, word_pattern


def has(text: Column, term: str, caseless: bool = False) -> Column:
    """term between non-alphanumerics or the edges."""
    return text.rlike(("(?iu)" if caseless else "") + word_pattern(term))


def contains(text: Column, term: str, caseless: bool = False) -> Column:
    return text.rlike("(?iu)" + quoted(term)) if caseless else text.contains(term)


def matches(text: Column, pattern: str) -> Column:
    """A regex whose ^ and $ are those of lines, parted by line feeds alone; classes such as \\w and \\d are those of Unicode."""
    return text.rlike("(?mdU)" + checked_regex(pattern))


def in_window(ts: Column, start: int | None = None, end: int | None = None) -> Column:
    """Both ends inclusive; what has no stamp stays."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (ts >= start)
    if end is not None:
        ok = ok & (ts <= end)
    return ts.isNull() | ok


def _all(cols: list[Column], empty: bool = True) -> Column:
    return reduce(lambda a, b: a & b, cols, F.lit(True)) if cols else F.lit(empty)


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


@dataclass
class Predicates:
    """All selecting terms, one of the any-terms if there are some, and none of the excludes."""

    has: list[str] = field(default_factory=list)
    has_caseless: list[str] = field(default_factory=list)
    substring: list[str] = field(default_factory=list)
    substring_caseless: list[str] = field(default_factory=list)
    regex: list[str] = field(default_factory=list)
    any: list[str] = field(default_factory=list)
    any_caseless: list[str] = field(default_factory=list)
    not_has: list[str] = field(default_factory=list)
    not_has_caseless: list[str] = field(default_factory=list)
    not_substring: list[str] = field(default_factory=list)
    not_substring_caseless: list[str] = field(default_factory=list)
    not_regex: list[str] = field(default_factory=list)

    def entry(self, text: Column) -> Column:
        once = lambda xs: list(dict.fromkeys(xs))
        select = [has(text, t) for t in once(self.has)] + [has(text, t, True) for t in once(self.has_caseless)]
        select += [contains(text, t) for t in once(self.substring)] + [contains(text, t, True) for t in once(self.substring_caseless)]
        select += [matches(text, p) for p in once(self.regex)]
        some = [has(text, t) for t in once(self.any)] + [has(text, t, True) for t in once(self.any_caseless)]
        if some:
            select.append(_any(some))
        drop = [has(text, t) for t in once(self.not_has)] + [has(text, t, True) for t in once(self.not_has_caseless)]
        drop += [contains(text, t) for t in once(self.not_substring)] + [contains(text, t, True) for t in once(self.not_substring_caseless)]
        drop += [matches(text, p) for p in once(self.not_regex)]
        return _all(select + [~d for d in drop])

    def required(self) -> tuple[list[str], list[list[str]]]:
        """(tokens that every match has, alternatives of which one has all its tokens; none: no such rule)."""
        every = [t for x in self.has for t in tokens_of(x)] + [t for x in self.substring for t in interior_tokens(x)]
        groups = [tokens_of(x) for x in self.any] if self.any and not self.any_caseless else []
        if not all(groups):  # an alternative without tokens can be anywhere
            groups = []
        return list(dict.fromkeys(every)), groups

    def chunk(self, tokens: Column) -> Column:
        """True for each chunk that may hold a match; chunks without an index may."""
        every, groups = self.required()
        ok = _all([F.array_contains(tokens, t) for t in every])
        if groups:
            ok = ok & _any([_all([F.array_contains(tokens, t) for t in g]) for g in groups])
        return F.coalesce(ok, F.lit(True))


def chunk_has(tokens: Column, *terms: str) -> Column:
    """The chunk-level has: every token of every term is in the chunk; a term without tokens is an error."""
    for t in terms:
        if not tokens_of(t):
            raise ValueError(f"no token in {t!r}: it cannot be looked up")
    return Predicates(has=list(terms)).chunk(tokens)


def chunk_any(tokens: Column, *terms: str) -> Column:
    for t in terms:
        if not tokens_of(t):
            raise ValueError(f"no token in {t!r}: it cannot be looked up")
    return Predicates(any=list(terms)).chunk(tokens)
