"""Every query of the search engine by name: what runs on Spark, and SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import oracle as o
from quern.functions.analysis import norm, tokens
from quern.operators.facets import drill_down, drill_sideways, facet_counts, top_children
from quern.operators.search import match, search, search_many
from quern.plans.query import MUST, MUST_NOT, SHOULD, Boolean, Clause, ConstantScore, Fuzzy, MatchAll, NumericRange, Phrase, Prefix, Query, Regexp, Term, TermRange, UnsupportedQuery, Wildcard
from quern.sources.shared import index_of, table, toxic

TOP = o.TOP
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _hits(name: str, query: Query, rows_sql: str, index: str = "documents", deletes: bool = False, **options) -> None:
    """A ranked search: the first TOP hits."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = index_of(spark, sf_dir, index)
        if deletes:
            at = at.with_deletes(toxic(spark, sf_dir))
        return search(at, query, TOP, **options).hits

    _add(name, run, o.ranked_sql(rows_sql))


def _bool(clauses, **options) -> Boolean:
    return Boolean(tuple(Clause(c[0], Term("text", c[1], c[2] if len(c) > 2 else 1.0)) for c in clauses), **options)


S, M, N = SHOULD, MUST, MUST_NOT

# terms
_hits("term_scored", Term("text", "the"), o.term_rows("the"), strict=True)
_hits("term_docs_only", Term("text", "the", docs_only=True), o.term_rows("the", docs_only=True), strict=True)
_hits("term_constant", ConstantScore(Term("text", "and"), 2.0), o.term_rows("and", constant=2.0), strict=True)
_hits("term_singleton", Term("text", "thretionnd"), o.term_rows("thretionnd"), strict=True)
_hits("term_deletes", Term("text", "onou"), o.term_rows("onou", deletes=True), deletes=True, strict=True)
_hits("term_missing_field", Term("nosuchfield", "the"), "SELECT doc_id, 0::DOUBLE AS score FROM documents WHERE false", strict=True)
_hits("term_no_norms", Term("p_name", "widget"), o.term_rows("widget", source="part", ident="p_partkey", column="p_name").replace(" * norm *", " *"), "parts_flat", strict=True)
_hits("term_missing", Term("text", "nosuchterm"), o.term_rows("nosuchterm"), strict=True)
_hits(
    "term_keyword",
    ConstantScore(Term("source", "src1")),
    "SELECT doc_id, 1::DOUBLE AS score FROM documents WHERE source = 'src1'",
    strict=True,
)

# Booleans of one field
_BOOLEANS = {
    "bool_should_2": [(S, "the"), (S, "onou")],
    "bool_should_3": [(S, "the"), (S, "der"), (S, "les")],
    "bool_should_4": [(S, "the"), (S, "are"), (S, "by"), (S, "and")],
    "bool_should_duplicate": [(S, "onou"), (S, "onou"), (S, "the")],
    "bool_must": [(M, "the"), (M, "onou")],
    "bool_must_rare": [(M, "the"), (M, "heoron")],
    "bool_must_should": [(M, "the"), (S, "are"), (S, "by")],
    "bool_should_not": [(S, "the"), (S, "are"), (N, "by")],
    "bool_must_should_not": [(M, "the"), (S, "are"), (N, "by")],
    "bool_boosted": [(S, "the", 3.0), (S, "are", 0.5), (M, "of", 2.0)],
    "bool_missing_must": [(M, "nosuchterm"), (S, "the")],
    "bool_missing_should": [(S, "nosuchterm"), (S, "the")],
}
for _name, _clauses in _BOOLEANS.items():
    _hits(_name, _bool(_clauses), o.bool_rows(_clauses), strict=True)
for _name in ("bool_should_4", "bool_must", "bool_should_not", "bool_must_should_not"):
    _short = _name.removesuffix("_4")
    _hits(f"{_short}_constant", ConstantScore(_bool(_BOOLEANS[_name])), o.bool_rows(_BOOLEANS[_name], constant=1.0), strict=True)
    _hits(f"{_short}_deletes", _bool(_BOOLEANS[_name]), o.bool_rows(_BOOLEANS[_name], deletes=True), deletes=True, strict=True)
_hits("bool_coord_disabled", _bool(_BOOLEANS["bool_should_4"], disable_coord=True), o.bool_rows(_BOOLEANS["bool_should_4"], coord=False), strict=True)
_hits("msm", _bool(_BOOLEANS["bool_should_4"], min_should_match=3), o.bool_rows(_BOOLEANS["bool_should_4"], msm=3))
_hits("bool_all_prohibited", _bool([(N, "the")]), "SELECT doc_id, 0::DOUBLE AS score FROM documents WHERE false")

# phrases
_hits("phrase_2", Phrase("text", ("of", "the")), o.phrase_rows(["of", "the"]), strict=True)
_hits("phrase_3", Phrase("text", ("and", "attion", "to")), o.phrase_rows(["and", "attion", "to"]), strict=True)
_hits("phrase_gap", Phrase("text", ("the", "of"), (0, 2)), o.phrase_rows(["the", "of"], [0, 2]), strict=True)
_hits("phrase_constant", ConstantScore(Phrase("text", ("of", "the"))), o.phrase_rows(["of", "the"], constant=1.0), strict=True)
_hits("phrase_deletes", Phrase("text", ("the", "and")), o.phrase_rows(["the", "and"], deletes=True), deletes=True, strict=True)
_hits("phrase_repeated", Phrase("text", ("the", "the")), o.phrase_rows(["the", "the"]), strict=True)
_hits(
    "sloppy_phrase",
    Phrase("text", ("of", "the"), slop=2),
    f"""WITH {o.docs_cte()}, s AS (SELECT 1 + ln(count(*)::DOUBLE / (sum(list_contains(toks, 'of')::INT)::DOUBLE + 1)) + 1 + ln(count(*)::DOUBLE / (sum(list_contains(toks, 'the')::INT)::DOUBLE + 1)) AS w FROM t),
    a AS (SELECT doc_id, norm, unnest(list_filter(range(1, len(toks) + 1), lambda i: toks[i] = 'of')) AS p FROM t),
    c AS (SELECT doc_id, unnest(list_filter(range(1, len(toks) + 1), lambda i: toks[i] = 'the')) AS q FROM t),
    m AS (SELECT a.doc_id, any_value(norm) AS norm, p, min(abs(q - 1 - p)) AS moves FROM a JOIN c ON a.doc_id = c.doc_id AND abs(q - 1 - p) <= 2 GROUP BY a.doc_id, p),
    f AS (SELECT doc_id, any_value(norm) AS norm, sum(1::DOUBLE / (1 + moves)) AS freq FROM m GROUP BY doc_id)
    SELECT doc_id, round(sqrt(freq) * w * norm, 6) AS score FROM f, s""",
)

# multi-term
_hits("prefix", Prefix("text", "thesh"), o.set_rows("starts_with(x, 'thesh')"), strict=True)
_hits("prefix_url", Prefix("url", "https://blog."), "SELECT page_id AS doc_id, 1::DOUBLE AS score FROM pages WHERE starts_with(url, 'https://blog.')", "pages", strict=True)
_hits("wildcard", Wildcard("text", "th*ou?d"), o.set_rows("regexp_full_match(x, 'th.*ou.d')"), strict=True)
_hits("wildcard_url", Wildcard("url", "*/en/7*"), "SELECT page_id AS doc_id, 1::DOUBLE AS score FROM pages WHERE contains(url, '/en/7')", "pages", strict=True)
_hits("regexp", Regexp("text", "(on|er)(the|and)[a-z]?"), o.set_rows("regexp_full_match(x, '(on|er)(the|and)[a-z]?')"), strict=True)
_hits("regexp_without", Regexp("text", "@an@&~(@the@|d@)&.{3,6}"), o.set_rows("contains(x, 'an') AND NOT contains(x, 'the') AND NOT starts_with(x, 'd') AND length(x) BETWEEN 3 AND 6"), strict=True)
_hits("term_range", TermRange("text", "uea", "ueb"), o.set_rows("x >= 'uea' AND x <= 'ueb'"), strict=True)
_hits(
    "numeric_range",
    NumericRange("n_chars", 500, 2000, include_high=False),
    "SELECT doc_id, 1::DOUBLE AS score FROM documents WHERE n_chars >= 500 AND n_chars < 2000",
    strict=True,
)
_hits("numeric_range_parts", NumericRange("p_size", 10, 20), "SELECT p_partkey AS doc_id, 1::DOUBLE AS score FROM part WHERE p_size BETWEEN 10 AND 20", "parts", strict=True)
_hits("prefix_deletes", Prefix("text", "onth"), o.set_rows("starts_with(x, 'onth')") + f" AND doc_id NOT IN {o.TOXIC}", deletes=True, strict=True)
_hits("fuzzy1", Fuzzy("text", "heoron", 1), o.fuzzy_rows("heoron", 1), strict=True)
_hits("fuzzy2", Fuzzy("text", "thention", 2), o.fuzzy_rows("thention", 2), strict=True)

# beyond one field or one level
_hits(
    "multi_field",
    Boolean.of((M, Term("text", "the")), (M, ConstantScore(Term("source", "src0")))),
    f"""WITH {o.docs_cte()}, f AS (SELECT t.doc_id, norm, len(list_filter(toks, lambda x: x = 'the')) AS tf, source FROM t JOIN documents d ON d.doc_id = t.doc_id),
    s AS (SELECT 1 + ln(count(*)::DOUBLE / (sum((tf > 0)::INT)::DOUBLE + 1)) AS i FROM f)
    SELECT doc_id, round((sqrt(tf::DOUBLE) * i * i * norm + 1) / sqrt(i * i + 1), 6) AS score FROM f, s WHERE tf > 0 AND source = 'src0'""",
)
_hits(
    "nested_bool",
    Boolean.of((M, Term("text", "the")), (S, Boolean.of((M, Term("text", "are")), (M, Term("text", "by"))))),
    f"""WITH {o.docs_cte()}, f AS (SELECT doc_id, norm, len(list_filter(toks, lambda x: x = 'the')) AS a, len(list_filter(toks, lambda x: x = 'are')) AS b, len(list_filter(toks, lambda x: x = 'by')) AS c FROM t),
    s AS (SELECT 1 + ln(count(*)::DOUBLE / (sum((a > 0)::INT)::DOUBLE + 1)) AS ia, 1 + ln(count(*)::DOUBLE / (sum((b > 0)::INT)::DOUBLE + 1)) AS ib, 1 + ln(count(*)::DOUBLE / (sum((c > 0)::INT)::DOUBLE + 1)) AS ic FROM f)
    SELECT doc_id, round((sqrt(a::DOUBLE) * ia * ia + CASE WHEN b > 0 AND c > 0 THEN sqrt(b::DOUBLE) * ib * ib + sqrt(c::DOUBLE) * ic * ic ELSE 0 END) * norm
      * (CASE WHEN b > 0 AND c > 0 THEN 2 ELSE 1 END)::DOUBLE / 2 / sqrt(ia * ia + ib * ib + ic * ic), 6) AS score
    FROM f, s WHERE a > 0""",
)
_hits(
    "filtered",
    Boolean.of((M, ConstantScore(NumericRange("n_chars", None, 1000))), (M, ConstantScore(Prefix("text", "ther")))),
    "SELECT doc_id, round(2 / sqrt(2::DOUBLE), 6) AS score FROM (" + o.set_rows("starts_with(x, 'ther')") + " AND n_chars <= 1000)",
)
_hits("parts_term", Term("p_name", "widget"), o.term_rows("widget", source="part", ident="p_partkey", column="p_name"), "parts", strict=True)

_add(
    "sorted_by_field",
    lambda spark, sf: search(index_of(spark, sf), Term("text", "onou"), TOP, sort_by="n_chars").hits.select("rank", "doc_id", "n_chars"),
    f"SELECT row_number() OVER (ORDER BY n_chars, doc_id) AS rank, doc_id, n_chars FROM documents WHERE list_contains({o.toks()}, 'onou') QUALIFY rank <= {TOP}",
)
_add(
    "search_after",
    lambda spark, sf: search(index_of(spark, sf), ConstantScore(Term("text", "the")), TOP, after=(1.0, 200)).hits,
    o.ranked_sql(o.term_rows("the", constant=1.0) + " AND doc_id > 200"),
)
_add(
    "total_hits_max_score",
    lambda spark, sf: search(index_of(spark, sf), _bool(_BOOLEANS["bool_should_4"]), 10).totals,
    f"SELECT count(*) AS total_hits, max(score) AS max_score FROM ({o.bool_rows(_BOOLEANS['bool_should_4'])}) b",
)
_add(
    "total_hits_empty",
    lambda spark, sf: search(index_of(spark, sf), Term("text", "nosuchterm"), 10).totals,
    "SELECT 0 AS total_hits, NULL::DOUBLE AS max_score",
)
_add(
    "all_matches",
    lambda spark, sf: match(index_of(spark, sf), _bool(_BOOLEANS["bool_must_should_not"])),
    o.bool_rows(_BOOLEANS["bool_must_should_not"]),
)
_BATCH = {"one": [(S, "the"), (S, "are")], "two": [(M, "onou"), (S, "by")], "three": [(S, "der"), (N, "die")]}
_add(
    "search_batch",
    lambda spark, sf: search_many(index_of(spark, sf), {k: _bool(v) for k, v in _BATCH.items()}, 20),
    " UNION ALL ".join(f"SELECT '{k}' AS query, r.* FROM ({o.ranked_sql(o.bool_rows(v), 20)}) r" for k, v in _BATCH.items()),
)

# the index itself
_add(
    "term_stats",
    lambda spark, sf: index_of(spark, sf).term_stats.where("field = 'text'").select("term", "doc_freq", "total_term_freq"),
    f"SELECT term, count(DISTINCT doc_id) AS doc_freq, count(*) AS total_term_freq FROM (SELECT doc_id, unnest({o.toks()}) AS term FROM documents) w GROUP BY term",
)
_add(
    "doc_norms",
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.size(tokens(F.col("text"))).alias("length")).select("doc_id", "length", norm(F.col("length")).alias("norm")),
    f"SELECT doc_id, len(toks) AS length, norm FROM (WITH {o.docs_cte()} SELECT * FROM t)",
)
_add(
    "postings_positions",
    lambda spark, sf: index_of(spark, sf).postings.where("field = 'text' and term in ('the', 'onou')").select("term", "doc_id", "tf", F.array_join("positions", ",").alias("positions")),
    f"""SELECT term, doc_id, len(pos) AS tf, array_to_string(list_transform(pos, lambda i: i - 1), ',') AS positions FROM (
    SELECT doc_id, term, list_filter(range(1, len(toks) + 1), lambda i: toks[i] = term) AS pos FROM (SELECT doc_id, {o.toks()} AS toks FROM documents) d, (VALUES ('the'), ('onou')) v(term)) x WHERE len(pos) > 0""",
)
_add(
    "vocabulary_range",
    lambda spark, sf: index_of(spark, sf).term_stats.where("field = 'text' and term >= 'thea' and term < 'theb'").select("term", "doc_freq"),
    f"SELECT term, count(DISTINCT doc_id) AS doc_freq FROM (SELECT doc_id, unnest({o.toks()}) AS term FROM documents) w WHERE term >= 'thea' AND term < 'theb' GROUP BY term",
)

# sets of documents
_a, _b = Term("text", "onou"), Term("text", "onat")


def _ids(spark: SparkSession, sf: str, q: Query) -> DataFrame:
    return match(index_of(spark, sf), ConstantScore(q)).select("doc_id")


_has = lambda t: f"SELECT doc_id FROM documents WHERE list_contains({o.toks()}, '{t}')"
_add("set_union", lambda spark, sf: _ids(spark, sf, Boolean.of((S, _a), (S, _b))), f"{_has('onou')} UNION {_has('onat')}")
_add("set_intersect", lambda spark, sf: _ids(spark, sf, Boolean.of((M, _a), (M, _b))), f"{_has('onou')} INTERSECT {_has('onat')}")
_add("set_except", lambda spark, sf: _ids(spark, sf, Boolean.of((M, _a), (N, _b))), f"{_has('onou')} EXCEPT {_has('onat')}")
_add("match_all", lambda spark, sf: _ids(spark, sf, MatchAll()), "SELECT doc_id FROM documents")

# facets
for _dim in ("lang", "source"):
    _add(
        f"facet_count_{_dim}",
        lambda spark, sf, d=_dim: facet_counts(index_of(spark, sf)).where(F.col("dim") == d).select("label", "count"),
        f"SELECT {_dim} AS label, count(*) AS count FROM documents WHERE {_dim} IS NOT NULL GROUP BY 1",
    )
_add(
    "facet_count_hits",
    lambda spark, sf: facet_counts(index_of(spark, sf), match(index_of(spark, sf), Term("text", "onou"))).select("dim", "label", "count"),
    " UNION ALL ".join(f"SELECT '{d}' AS dim, {d} AS label, count(*) AS count FROM documents WHERE list_contains({o.toks()}, 'onou') GROUP BY 2" for d in ("lang", "source")),
)
_add(
    "facet_count_role",
    lambda spark, sf: facet_counts(index_of(spark, sf, "turns")).select("label", "count"),
    "SELECT role AS label, count(*) AS count FROM conversations GROUP BY 1",
)
_add(
    "facet_count_event_type",
    lambda spark, sf: facet_counts(index_of(spark, sf, "events")).select("label", "count"),
    "SELECT event_type AS label, count(DISTINCT event_id) AS count FROM events GROUP BY 1",
)
_add(
    "facet_topk",
    lambda spark, sf: top_children(index_of(spark, sf), facet_counts(index_of(spark, sf)), 5).select("dim", "label", "count", "rank"),
    " UNION ALL ".join(
        f"(SELECT '{d}' AS dim, {d} AS label, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, min(doc_id) DESC) AS rank FROM documents GROUP BY 2 QUALIFY rank <= 5)" for d in ("lang", "source")
    ),
)
_add(
    "facet_rollup",
    lambda spark, sf: facet_counts(index_of(spark, sf, "parts")).select("depth", "label", "count"),
    "SELECT 1 AS depth, p_type AS label, count(*) AS count FROM part GROUP BY 2 UNION ALL SELECT 2 AS depth, p_type || '/' || p_brand AS label, count(*) AS count FROM part GROUP BY 2",
)
_add(
    "facet_children",
    lambda spark, sf: _children(spark, sf).select("label", "count", "rank"),
    """SELECT p_type || '/' || p_brand AS label, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, min(p_partkey) DESC) AS rank
    FROM part WHERE p_type = (SELECT min(p_type) FROM part) GROUP BY 1 QUALIFY rank <= 10""",
)


def _children(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "part").agg(F.min("p_type")).first()[0]
    at = index_of(spark, sf, "parts")
    return top_children(at, facet_counts(at), 10, parent=first)


def _drill(name: str, query: Query, base: str, drills: dict[str, list[str]]) -> None:
    _add(
        name,
        lambda spark, sf: drill_down(index_of(spark, sf), query, drills),
        f"WITH {o.facet_base(base, drills)} SELECT doc_id, score FROM b WHERE missing = 0",
    )


_drill("drilldown_single", Term("text", "the"), o.term_rows("the"), {"lang": ["en"]})
_drill("drilldown_multi", Term("text", "the"), o.term_rows("the"), {"lang": ["en", "de"], "source": ["src0", "src1", "src2"]})

_REQUESTS = [("source", 10), ("lang", 10)]
_SIDEWAYS: dict[str, tuple[Query | None, str, dict[str, list[str]]]] = {
    "sideways_single": (_bool([(S, "the"), (S, "are")]), o.bool_rows([(S, "the"), (S, "are")]), {"lang": ["en"]}),
    "sideways_multi": (_bool([(S, "the"), (S, "are")]), o.bool_rows([(S, "the"), (S, "are")]), {"source": ["src0", "src3"]}),
    "sideways_two_dims": (_bool([(S, "de"), (S, "the")]), o.bool_rows([(S, "de"), (S, "the")]), {"lang": ["en"], "source": ["src0", "src1"]}),
    "sideways_term": (Term("text", "the"), o.term_rows("the"), {"source": ["src2"]}),
    "sideways_must": (_bool([(S, "the"), (M, "are")]), o.bool_rows([(S, "the"), (M, "are")]), {"lang": ["en"]}),
    "sideways_not": (_bool([(S, "the"), (N, "are")]), o.bool_rows([(S, "the"), (N, "are")]), {"lang": ["de", "fr"]}),
    "sideways_must_not": (_bool([(S, "the"), (M, "of"), (N, "are")]), o.bool_rows([(S, "the"), (M, "of"), (N, "are")]), {"lang": ["en"]}),
    "sideways_phrase": (Phrase("text", ("of", "the")), o.phrase_rows(["of", "the"]), {"lang": ["en"]}),
    "sideways_unscored": (ConstantScore(Term("text", "the")), o.term_rows("the", constant=1.0), {"lang": ["en"]}),
    "browse_only": (None, "SELECT doc_id, 1::DOUBLE AS score FROM documents", {"lang": ["es"]}),
    "sideways_no_dims": (Term("text", "the"), o.term_rows("the"), {}),
}


def _sideways(name: str, query: Query | None, base: str, drills: dict[str, list[str]]) -> None:
    _add(f"{name}_facets", lambda spark, sf: drill_sideways(index_of(spark, sf), query, drills, _REQUESTS, TOP).facets, o.sideways_facets(base, drills, _REQUESTS))
    _add(
        f"{name}_hits",
        lambda spark, sf: drill_sideways(index_of(spark, sf), query, drills, _REQUESTS, TOP).hits,
        f"WITH {o.facet_base(base, drills)} " + o.ranked_sql("SELECT doc_id, score FROM b WHERE missing = 0"),
    )


for _name, _spec in _SIDEWAYS.items():
    _sideways(_name, *_spec)
_add(
    "sideways_strict_facets",
    lambda spark, sf: drill_sideways(index_of(spark, sf), _SIDEWAYS["sideways_must"][0], {"lang": ["en"]}, _REQUESTS, TOP, strict=True, reuse=True).facets,
    o.sideways_facets(_SIDEWAYS["sideways_must"][1], {"lang": ["en"]}, _REQUESTS),
)
for _kind in ("facets", "hits"):
    _live = o.bool_rows([(S, "the"), (S, "are")], deletes=True)
    _add(
        f"sideways_deletes_{_kind}",
        lambda spark, sf, k=_kind: getattr(drill_sideways(index_of(spark, sf).with_deletes(toxic(spark, sf)), _bool([(S, "the"), (S, "are")]), {"lang": ["en"]}, _REQUESTS, TOP), k),
        o.sideways_facets(_live, {"lang": ["en"]}, _REQUESTS) if _kind == "facets" else f"WITH {o.facet_base(_live, {'lang': ['en']})} " + o.ranked_sql("SELECT doc_id, score FROM b WHERE missing = 0"),
    )
_PATHS = [("category", 10), ("category", 10, "ECONOMY"), ("p_brand", 10)]
_add(
    "sideways_children",
    lambda spark, sf: drill_sideways(index_of(spark, sf, "parts_flat"), Term("p_name", "widget"), {"p_brand": ["Brand#11", "Brand#13"]}, _PATHS, TOP).facets,
    o.sideways_facets(
        o.term_rows("widget", source="part", ident="p_partkey", column="p_name").replace(" * norm *", " *"),
        {"p_brand": ["Brand#11", "Brand#13"]},
        _PATHS,
        {0: "p_type", 1: "p_type || '/' || p_brand"},
        columns=("p_type", "p_brand"),
        source="part",
        ident="p_partkey",
    ),
)
_REFUSED = {
    "nested": (Boolean.of((M, Term("text", "the")), (M, _bool([(S, "of")]))), True),
    "two fields": (Boolean.of((M, Term("text", "the")), (M, Term("lang", "en"))), True),
    "sloppy phrase": (Phrase("text", ("of", "the"), slop=1), True),
    "only prohibited": (_bool([(N, "the")]), True),
    "minimum of two": (_bool([(S, "the"), (S, "of")], min_should_match=2), True),
    "term": (Term("text", "the"), False),
    "boolean": (_bool([(S, "the"), (M, "of"), (N, "are")]), False),
    "phrase": (Phrase("text", ("of", "the")), False),
    "fuzzy": (Fuzzy("text", "the", 1), False),
}


def _refused(spark: SparkSession, sf: str) -> DataFrame:
    rows = []
    for name, (query, _) in _REFUSED.items():
        try:
            match(index_of(spark, sf), query, strict=True)
            rows.append((name, False))
        except UnsupportedQuery:
            rows.append((name, True))
    return spark.createDataFrame(rows, "query string, refused boolean")


_add("strict_refusals", _refused, "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(r).lower()})" for n, (_, r) in _REFUSED.items()) + ") v(query, refused)")
_add(
    "sideways_near_misses",
    lambda spark, sf: drill_sideways(index_of(spark, sf), Term("text", "the"), {"lang": ["en"], "source": ["src0", "src1"]}, _REQUESTS, 10).sideways,
    f"""WITH {o.facet_base(o.term_rows('the'), {'lang': ['en'], 'source': ['src0', 'src1']})}
    SELECT 'lang' AS dim, count(*) FILTER (missing = 0) AS hits, count(*) FILTER (missing = 1 AND missed_lang) AS near_misses FROM b
    UNION ALL SELECT 'source', count(*) FILTER (missing = 0), count(*) FILTER (missing = 1 AND missed_source) FROM b""",
)
