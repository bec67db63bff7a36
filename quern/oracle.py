"""The same results in SQL, from per-document counts instead of postings, for checks in DuckDB."""

from __future__ import annotations

TOP = 100
TOXIC = "(SELECT doc_id FROM labels WHERE toxic = 1)"


def norm_sql(n: str) -> str:
    """1/sqrt(n) cut to two bits behind the leading one: the next lower of 1, 1.25, 1.5 and 1.75 times a power of two."""
    root = f"(1 / sqrt({n}::DOUBLE))"
    power = f"(2::DOUBLE ** floor(log2({root})))"
    return f"CASE WHEN {n} > 0 THEN {power} * (1 + floor(({root} / {power} - 1) * 4) / 4) ELSE 0 END"


def transposed(text: str) -> set[str]:
    """The forms of ``text`` with two neighbouring characters in the other order."""
    pairs = zip(text, text[1:])
    return {text[:at] + b + a + text[at + 2 :] for at, (a, b) in enumerate(pairs) if a != b}


def toks(column: str = "text") -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '\s+'), lambda x: x <> '')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def docs_cte(source: str = "documents", ident: str = "doc_id", column: str = "text") -> str:
    return f"t AS (SELECT *, {norm_sql('len(toks)')} AS norm FROM (SELECT {ident} AS doc_id, {toks(column)} AS toks FROM {source}) x)"


def ranked_sql(body: str, top: int = TOP) -> str:
    """``body``: a query with doc_id and score."""
    return f"SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM ({body}) b QUALIFY rank <= {top}"


def live_sql(deletes: bool) -> str:
    return f" AND doc_id NOT IN {TOXIC}" if deletes else ""


def bool_rows(clauses, msm=0, coord=True, constant=None, deletes=False, source="documents", ident="doc_id", column="text", with_head=True) -> str:
    """(doc_id, score) of a Boolean over one field. clauses: (occur, term) or (occur, term, boost)."""
    clauses = [(c[0], c[1], c[2] if len(c) > 2 else 1.0) for c in clauses]
    tfs = ", ".join(f"len(list_filter(toks, lambda x: x = {quoted(t)}))::BIGINT AS f{i}" for i, (_, t, _) in enumerate(clauses))
    stats = ", ".join(f"1 + ln(count(*)::DOUBLE / (sum((f{i} > 0)::INT)::DOUBLE + 1)) AS idf{i}" for i in range(len(clauses)))
    scored = [i for i, c in enumerate(clauses) if c[0] != "MUST_NOT"]
    square = " + ".join(f"(s.idf{i} * {clauses[i][2]}::DOUBLE) ** 2" for i in scored) or "1"
    total = " + ".join(f"sqrt(f{i}::DOUBLE) * s.idf{i} * s.idf{i} * {clauses[i][2]}::DOUBLE" for i in scored) or "0"
    matched = " + ".join(f"(f{i} > 0)::INT" for i in scored) or "0"
    musts = [f"f{i} > 0" for i, c in enumerate(clauses) if c[0] == "MUST"]
    nots = [f"f{i} = 0" for i, c in enumerate(clauses) if c[0] == "MUST_NOT"]
    should = " + ".join(f"(f{i} > 0)::INT" for i, c in enumerate(clauses) if c[0] == "SHOULD") or "0"
    where = " AND ".join([*musts, *nots, f"({matched}) > 0", f"({should}) >= {msm}"])
    factor = f"({matched})::DOUBLE / {len(scored)}" if coord and len(scored) > 1 else "1"
    score = f"{constant}::DOUBLE" if constant is not None else f"round(({total}) / sqrt({square}) * norm * ({factor}), 6)"
    head = f"WITH {docs_cte(source, ident, column)}, " if with_head else ""
    return f"{head}f AS (SELECT doc_id, norm, {tfs} FROM t), s AS (SELECT {stats} FROM f) SELECT doc_id, {score} AS score FROM f, s WHERE {where}{live_sql(deletes)}"


def term_rows(term, docs_only=False, constant=None, deletes=False, **where) -> str:
    body = bool_rows([("MUST", term)], constant=constant, deletes=deletes, **where)
    return body.replace("sqrt(f0::DOUBLE)", "1") if docs_only else body


def phrase_rows(terms, offsets=None, constant=None, deletes=False) -> str:
    offsets = offsets or list(range(len(terms)))
    at = " AND ".join(f"toks[i + {o}] = {quoted(t)}" for t, o in zip(terms, offsets))
    distinct = list(dict.fromkeys(terms))
    freqs = ", ".join(f"1 + ln(count(*)::DOUBLE / (sum(list_contains(toks, {quoted(t)})::INT)::DOUBLE + 1)) AS idf{i}" for i, t in enumerate(distinct))
    total = " + ".join(f"s.idf{distinct.index(t)}" for t in terms)
    score = f"{constant}::DOUBLE" if constant is not None else f"round(sqrt(freq::DOUBLE) * ({total}) * norm, 6)"
    return (
        f"WITH {docs_cte()}, s AS (SELECT {freqs} FROM t), "
        f"p AS (SELECT doc_id, norm, len(list_filter(range(1, len(toks) + 1), lambda i: coalesce({at}, false))) AS freq FROM t) "
        f"SELECT doc_id, {score} AS score FROM p, s WHERE freq > 0{live_sql(deletes)}"
    )


def set_rows(predicate: str, boost: float = 1.0, source="documents", ident="doc_id", column="text") -> str:
    """Documents with a term ``x`` that fulfils the predicate."""
    return f"SELECT {ident} AS doc_id, {boost}::DOUBLE AS score FROM {source} WHERE len(list_filter({toks(column)}, lambda x: {predicate})) > 0"


def fuzzy_rows(text: str, most: int, expansions: int = 50) -> str:
    forms = {text: 0}
    for _ in range(most):
        for form, cost in list(forms.items()):
            for other in sorted(transposed(form)):
                forms.setdefault(other, cost + 1)
    edits = "least(" + ", ".join(f"levenshtein(term, {quoted(f)}) + {c}" for f, c in forms.items() if c <= most) + ")"
    n = len(text)
    return (
        f"WITH {docs_cte()}, w AS (SELECT doc_id, norm, unnest(toks) AS term FROM t), "
        f"p AS (SELECT doc_id, norm, term, count(*) AS tf FROM w GROUP BY ALL), "
        f"v AS (SELECT term, count(*) AS df, {edits} AS edits FROM p GROUP BY term HAVING abs(length(term) - {n}) <= {most}), "
        f"e AS (SELECT term, 1 + ln((SELECT count(*) FROM t)::DOUBLE / (df + 1)) AS idf, 1 - edits::DOUBLE / least(length(term), {n}) AS boost FROM v "
        f"WHERE edits <= {most} AND edits < least(length(term), {n}) ORDER BY boost DESC, term LIMIT {expansions}), "
        f"q AS (SELECT 1 / sqrt(sum((idf * boost) ** 2)) AS qn FROM e) "
        f"SELECT doc_id, round(sum(sqrt(tf::DOUBLE) * idf * idf * boost) * any_value(qn) * any_value(norm), 6) AS score FROM p JOIN e USING (term), q GROUP BY doc_id"
    )


def facet_base(base: str, drills: dict[str, list[str]], columns=("lang", "source"), source="documents", ident="doc_id") -> str:
    """CTEs b(doc_id, score, columns, missing, missed_<dim>); a dimension is named like its column."""
    inside = {d: f"coalesce({d} IN ({', '.join(quoted(v) for v in vs)}), false)" for d, vs in drills.items()}
    missing = " + ".join(f"(NOT {x})::INT" for x in inside.values()) or "0"
    flags = "".join(f", NOT {x} AS missed_{d}" for d, x in inside.items())
    return f"b AS (SELECT h.doc_id, h.score, {', '.join(columns)}, {missing} AS missing{flags} FROM ({base}) h JOIN {source} d ON h.doc_id = d.{ident})"


def sideways_facets(base: str, drills: dict[str, list[str]], requests: list[tuple], labels: dict[str, str] | None = None, **where) -> str:
    """``requests``: (dim, k) or (dim, k, parent); ``labels``: the SQL of a request's category by its place, a column of the table being the default."""
    source, ident = where.get("source", "documents"), where.get("ident", "doc_id")
    parts = []
    for at, (dim, k, *rest) in enumerate(requests):
        label = (labels or {}).get(at, dim)
        hit = f"(missing = 0 OR (missing = 1 AND missed_{dim}))" if dim in drills else "missing = 0"
        under = f" AND starts_with({label}, {quoted(rest[0] + '/')})" if rest else ""
        depth = rest[0].count("/") + 2 if rest else 1
        parts.append(
            f"SELECT {at} AS request_idx, '{dim}' AS dim, {depth} AS depth, label, count, row_number() OVER (ORDER BY count DESC, first DESC) AS rank FROM "
            f"(SELECT {label} AS label, count(*) AS count, any_value(first) AS first FROM b JOIN (SELECT {label} AS l, min({ident}) AS first FROM {source} GROUP BY 1) o ON o.l = {label} "
            f"WHERE {hit}{under} GROUP BY 1) QUALIFY rank <= {k}"
        )
    return f"WITH {facet_base(base, drills, **where)} " + " UNION ALL ".join(f"({p})" for p in parts)
