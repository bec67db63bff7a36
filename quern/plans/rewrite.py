"""Rewrites done on the query tree before there is a plan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.literals import text_sql
from quern.plans.query import MUST, MUST_NOT, SHOULD, Boolean, Clause, ConstantScore, Fuzzy, MultiTerm, Phrase, Prefix, Query, Regexp, Term, TermRange, UnsupportedQuery, Wildcard
from quern.plans.regexp import regexp_sql
from quern.sources.index import SearchIndex

_PLAIN = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ")


def _quoted(ch: str) -> str:
    return ch if ch in _PLAIN or ord(ch) > 127 else "\\" + ch


def wildcard_regex(pattern: str) -> tuple[str, str]:
    """(anchored regex, literal prefix)."""
    out, prefix, at, literal = "", "", 0, True
    while at < len(pattern):
        ch = pattern[at]
        if ch in "*?":
            out += "(?s:.*)" if ch == "*" else "(?s:.)"
            literal = False
        else:
            if ch == "\\" and at + 1 < len(pattern):
                at += 1
                ch = pattern[at]
            out += _quoted(ch)
            prefix += ch if literal else ""
        at += 1
    return f"^{out}\\z", prefix


def term_predicate(query: MultiTerm, term: Column) -> Column:
    """What a multi-term query asks of a term; literal prefixes are plain ones, which reach the scan."""
    if isinstance(query, Prefix):
        return term.startswith(query.prefix)
    if isinstance(query, Wildcard):
        regex, prefix = wildcard_regex(query.pattern)
        return (term.startswith(prefix) & term.rlike(regex)) if prefix else term.rlike(regex)
    if isinstance(query, Regexp):
        return F.expr(regexp_sql(query.pattern))
    if isinstance(query, TermRange):
        out = F.lit(True)
        if query.low is not None:
            out = out & (term >= query.low if query.include_low else term > query.low)
        if query.high is not None:
            out = out & (term <= query.high if query.include_high else term < query.high)
        return out
    raise UnsupportedQuery(f"not a multi-term query: {query}")


def swapped(text: str) -> list[str]:
    """``text`` with one pair of neighbours swapped."""
    return sorted({text[:i] + text[i + 1] + text[i] + text[i + 2 :] for i in range(len(text) - 1)} - {text})


def edit_distance(text: str, most: int) -> str:
    """SQL of the edits between ``term`` and ``text`` where a swap of neighbours is one edit, exact up to ``most`` (<= 2) and
    null or more beyond."""
    forms = {text: 0}
    for _ in range(most):
        for form, cost in list(forms.items()):
            for other in swapped(form):
                forms.setdefault(other, cost + 1)
    # an edit is two plain ones at most: the bounded distance rules most terms out before any other is taken
    distances = ", ".join(f"levenshtein(term, {text_sql(form)}) + {cost}" for form, cost in forms.items() if cost <= most)
    least = f"least({distances})" if len(forms) > 1 else distances
    return f"CASE WHEN levenshtein(term, {text_sql(text)}, {2 * most}) >= 0 THEN {least} END"


def expand_fuzzy(index: SearchIndex, query: Fuzzy) -> Query:
    """The closest terms as optional clauses, boosted by similarity; at most ``max_expansions`` rows reach the driver."""
    if query.max_edits not in (0, 1, 2):
        raise UnsupportedQuery("fuzzy: max_edits must be 0, 1 or 2")
    n = len(query.text)
    terms = index.term_stats.where(f"field = {text_sql(query.field)} AND length(term) BETWEEN {n - query.max_edits} AND {n + query.max_edits}")
    near = terms.selectExpr("term", f"{edit_distance(query.text, query.max_edits)} AS edits").where(f"edits <= {query.max_edits}")
    near = near.selectExpr("term", f"1 - edits / least(length(term), {n}) AS boost").where("boost > 0")
    best = near.orderBy(F.desc("boost"), F.asc("term")).limit(query.max_expansions).collect()
    return Boolean(tuple(Clause(SHOULD, Term(query.field, r.term, r.boost)) for r in best), disable_coord=True, boost=query.boost)


def rewrite(index: SearchIndex, query: Query) -> Query:
    """Fuzzy queries become unions; a phrase of one term becomes the term; the rest stays."""
    if isinstance(query, Fuzzy):
        return expand_fuzzy(index, query)
    if isinstance(query, Boolean):
        return replace(query, clauses=tuple(Clause(c.occur, rewrite(index, c.query)) for c in query.clauses))
    if isinstance(query, ConstantScore):
        return replace(query, query=rewrite(index, query.query))
    if isinstance(query, Phrase) and len(query.terms) == 1 and query.offsets()[0] >= 0:
        return Term(query.field, query.terms[0], query.boost)
    return query


def unscored(query: Boolean) -> Boolean:
    """Without scores, optional clauses beside required ones change nothing."""
    if any(c.occur == MUST for c in query.clauses) and query.min_should_match == 0:
        return replace(query, clauses=tuple(c for c in query.clauses if c.occur != SHOULD))
    return query


def check_strict(query: Query) -> None:
    """The core set: terms, exact phrases, Booleans of terms of one field, constant scores of these, multi-term queries."""
    if isinstance(query, ConstantScore):
        return check_strict(query.query)
    if isinstance(query, Phrase) and query.slop:
        raise UnsupportedQuery("phrase: slop must be 0")
    if isinstance(query, Boolean):
        if query.min_should_match > 1:
            raise UnsupportedQuery("boolean: min_should_match must be 0 or 1")
        if any(not isinstance(c.query, Term) for c in query.clauses):
            raise UnsupportedQuery("boolean: clauses must be terms")
        if len({c.query.field for c in query.clauses}) > 1:
            raise UnsupportedQuery("boolean: clauses must be of one field")
        if query.clauses and all(c.occur == MUST_NOT for c in query.clauses):
            raise UnsupportedQuery("boolean: all clauses are prohibited")
    return None
