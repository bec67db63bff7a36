"""Query trees."""

from __future__ import annotations

from dataclasses import dataclass, field

SHOULD, MUST, MUST_NOT = "SHOULD", "MUST", "MUST_NOT"


class UnsupportedQuery(ValueError):
    """Raised in strict mode for a query outside the core set, and for invalid arguments."""


@dataclass(frozen=True)
class Query:
    pass


@dataclass(frozen=True)
class MatchAll(Query):
    boost: float = 1.0


@dataclass(frozen=True)
class Term(Query):
    field: str
    text: str
    boost: float = 1.0
    #: Frequencies aren't used: a hit counts as one occurrence.
    docs_only: bool = False


@dataclass(frozen=True)
class Clause:
    occur: str
    query: Query


@dataclass(frozen=True)
class Boolean(Query):
    clauses: tuple[Clause, ...] = ()
    min_should_match: int = 0
    disable_coord: bool = False
    boost: float = 1.0

    @staticmethod
    def of(*clauses: tuple[str, Query], **options) -> Boolean:
        return Boolean(tuple(Clause(o, q) for o, q in clauses), **options)


@dataclass(frozen=True)
class Phrase(Query):
    field: str
    terms: tuple[str, ...]
    #: Offset of each term; consecutive if not given.
    positions: tuple[int, ...] | None = None
    slop: int = 0
    boost: float = 1.0

    def offsets(self) -> tuple[int, ...]:
        return self.positions if self.positions is not None else tuple(range(len(self.terms)))


@dataclass(frozen=True)
class ConstantScore(Query):
    query: Query
    boost: float = 1.0


@dataclass(frozen=True)
class MultiTerm(Query):
    """All terms of a field that a predicate accepts; constant score."""

    field: str
    boost: float = field(default=1.0, kw_only=True)


@dataclass(frozen=True)
class Prefix(MultiTerm):
    prefix: str = ""


@dataclass(frozen=True)
class Wildcard(MultiTerm):
    """``*`` any run, ``?`` any one character, ``\\`` escapes the next."""

    pattern: str = ""


@dataclass(frozen=True)
class Regexp(MultiTerm):
    pattern: str = ""


@dataclass(frozen=True)
class TermRange(MultiTerm):
    low: str | None = None
    high: str | None = None
    include_low: bool = True
    include_high: bool = True


@dataclass(frozen=True)
class NumericRange(Query):
    column: str
    low: float | None = None
    high: float | None = None
    include_low: bool = True
    include_high: bool = True
    boost: float = 1.0


@dataclass(frozen=True)
class Fuzzy(Query):
    """Scored union of the closest terms within ``max_edits`` (insert, delete, replace, swap of neighbours)."""

    field: str
    text: str
    max_edits: int = 2
    max_expansions: int = 50
    boost: float = 1.0
