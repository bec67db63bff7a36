"""Queries over random corpora against plain search, alive and with deletes, and the odd cases by hand."""

import random
from dataclasses import replace

import plain
import pytest
from plain import Plain, pool

from quern.functions.analysis import NORM_STEPS
from quern.operators.search import match, search, search_many
from quern.plans.query import MUST, MUST_NOT, SHOULD, Boolean, Clause, ConstantScore, Fuzzy, MatchAll, NumericRange, Phrase, Prefix, Regexp, Term, TermRange, UnsupportedQuery, Wildcard
from quern.sources.index import IndexSpec, SearchIndex

S, M, N = SHOULD, MUST, MUST_NOT
TEXTS, VOCABULARY = pool(31)
DEAD = tuple(random.Random(32).sample(range(len(TEXTS)), 20))


def corpus(spark, texts, **extra):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, field string")
    index = SearchIndex.build(df.coalesce(1), IndexSpec(text_fields=("field",), **extra)).counted()
    return replace(index, postings=index.postings.cache(), term_stats=index.term_stats.cache())


@pytest.fixture(scope="module")
def index(spark):
    return corpus(spark, TEXTS)


def deleted(spark, index, ids=DEAD):
    return index.with_deletes(spark.createDataFrame([(d,) for d in ids], "doc_id long"))


def query(q):
    """The engine's query of a plain one."""
    if q[0] == "term":
        return Term("field", q[1])
    if q[0] == "phrase":
        return Phrase("field", tuple(q[1]), tuple(q[2]))
    return Boolean(tuple(Clause(o, query(c)) for o, c in q[1]))


def run(index, q, top_n=1000):
    top = search(index, q, top_n)
    hits = [(r.doc_id, r.score) for r in top.hits.orderBy("rank").collect()]
    totals = top.totals.first()
    assert totals.max_score == (hits[0][1] if hits else None)
    return totals.total_hits, hits


def same(found, want):
    total, hits = found
    assert total == len(want) and [d for d, _ in hits] == [d for d, _ in want]
    assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(hits, want))


def draws():
    """Shapes of every combination of clauses, with terms drawn from frequent to absent ones."""
    draw = random.Random(33)
    term = lambda: ("term", draw.choice(VOCABULARY + ["absent"]))
    shapes = [(S,), (M,), (N,), (S, S), (S, M), (M, M), (S, N), (N, M), (N, N), (S, S, S, S, S), (M, S, N), (M, M, S, S, N), ()]
    out = [("bool", [(o, term()) for o in shape]) for shape in shapes]
    out += [term(), ("term", VOCABULARY[0]), ("bool", [(S, ("term", VOCABULARY[1]))] * 3)]
    out += [("phrase", [draw.choice(VOCABULARY[:3]) for _ in range(n)], list(range(n))) for n in (2, 2, 3)]
    out += [("phrase", [VOCABULARY[0], VOCABULARY[1]], [0, 2]), ("phrase", [VOCABULARY[0]] * 2, [0, 1]), ("phrase", [VOCABULARY[0], "absent"], [0, 1])]
    return out + [("bool", [(M, ("phrase", [VOCABULARY[0], VOCABULARY[1]], [0, 1])), (S, ("bool", [(M, ("term", VOCABULARY[2])), (S, ("term", VOCABULARY[0]))]))])]


@pytest.mark.parametrize("at", range(len(draws())))
def test_against_plain_search(spark, index, at):
    q = draws()[at]
    for gone in ((), DEAD):
        found = deleted(spark, index) if gone else index
        want = Plain(TEXTS, gone).hits(q)
        same(run(found, query(q)), want)
        assert run(found, ConstantScore(query(q), 2.0)) == (len(want), sorted((d, 2.0) for d, _ in want))
    assert run(index, query(q), 5)[1] == run(index, query(q))[1][:5]


def test_norms_by_rule():
    steps = lambda n: max((s for s in NORM_STEPS if s[0] <= n), default=(0, 0.0))[1]
    for n in [*range(3000), 4096, 4097, 5349, 5350, 7281, 7282, 10485, 10486, 16384, 16385]:
        assert steps(n) == plain.norm(n), n


def test_equal_documents_keep_their_order(spark):
    index = corpus(spark, ["ka mi ro"] * 300)
    for q in (("bool", [(S, ("term", "ka")), (S, ("term", "ro"))]), ("phrase", ["ka", "mi"], [0, 1])):
        want = Plain(["ka mi ro"] * 300).hits(q)
        assert [d for d, _ in want] == list(range(300))
        same(run(index, query(q)), want)


def test_phrase_shapes(spark):
    index = corpus(spark, ["ko ko ko", "x ko y mar", "mar ko", "ko mar"])
    ids = lambda q: [d for d, _ in run(index, ConstantScore(q))[1]]
    assert ids(Phrase("field", ("ko", "mar"), slop=1)) == [1, 3]
    assert ids(Phrase("field", ("ko",))) == [0, 1, 2, 3]
    # a start before the text's begin is none
    assert ids(Phrase("field", ("mar", "ko"), (1, 2))) == []


PATTERNS = [
    (Prefix("field", prefix="k"), lambda w: w.startswith("k")),
    (Prefix("field", prefix=""), lambda w: True),
    (Wildcard("field", pattern="?m*"), plain.matches(".m.*")),
    (Wildcard("field", pattern="*n"), plain.matches(".*n")),
    (Wildcard("field", pattern="?"), plain.matches(".")),
    (Wildcard("field", pattern="k\\*"), lambda w: w == "k*"),
    (Regexp("field", pattern="km|n[kn]?"), plain.matches("km|n[kn]?")),
    (TermRange("field", low="km", high="n", include_high=False), lambda w: "km" <= w < "n"),
    (TermRange("field", low="mk", include_low=False), lambda w: w > "mk"),
]


@pytest.mark.parametrize("at", range(len(PATTERNS)))
def test_multi_term_against_plain_search(spark, index, at):
    q, accept = PATTERNS[at]
    for gone in ((), DEAD):
        want = Plain(TEXTS, gone).holding(accept)
        assert run(deleted(spark, index) if gone else index, q) == (len(want), [(d, 1.0) for d in want])


def test_patterns_and_line_ends(spark):
    df = spark.createDataFrame([(0, "ab"), (1, "ab\n"), (2, "a*b")], "doc_id long, tag string")
    index = SearchIndex.build(df, IndexSpec(text_fields=(), keyword_fields=("tag",))).counted()
    ids = lambda q: [d for d, _ in run(index, q)[1]]
    assert ids(Regexp("tag", pattern="a.?b")) == [0, 2]
    assert ids(Wildcard("tag", pattern="ab")) == [0] and ids(Wildcard("tag", pattern="ab*")) == [0, 1]
    assert ids(Wildcard("tag", pattern="a\\*b")) == [2]
    assert ids(MatchAll()) == [0, 1, 2]


def test_numeric_range(spark):
    draw = random.Random(34)
    rows = [(i, "x", draw.choice([None, draw.randint(-50, 50)])) for i in range(400)]
    index = SearchIndex.build(spark.createDataFrame(rows, "doc_id long, field string, n int"), IndexSpec(text_fields=("field",), numeric_fields=("n",))).counted()
    for low, high, below, above in ((-7, 22, True, True), (-7, 22, False, False), (None, 0, True, False), (13, None, False, True), (9, -9, True, True)):
        fits = lambda n: n is not None and (low is None or n > low or (below and n == low)) and (high is None or n < high or (above and n == high))
        want = [(i, 1.0) for i, _, n in rows if fits(n)]
        assert run(index, NumericRange("n", low, high, below, above)) == (len(want), want)
    top = search(index, Term("field", "x"), 7, sort_by="n").hits.orderBy("rank").collect()
    assert [r.doc_id for r in top] == [i for i, _, n in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))[:7]]


def test_fuzzy_against_plain_edits(spark):
    draw = random.Random(35)
    words = sorted({"".join(draw.choices("aeml", k=draw.randint(2, 6))) for _ in range(150)})
    index = corpus(spark, words)
    for text in words[::30] + ["mela", "aemlae", "xy"]:
        for most in (0, 1, 2):
            near = {w: plain.edits(w, text) for w in words if abs(len(w) - len(text)) <= most}
            best = sorted(((-(1 - n / min(len(w), len(text))), w) for w, n in near.items() if n <= most and n < min(len(w), len(text))))[:50]
            assert sorted(d for d, _ in run(index, Fuzzy("field", text, most))[1]) == sorted(words.index(w) for _, w in best), (text, most)
    only = run(index, Fuzzy("field", words[0], 2, max_expansions=1))[1]
    assert [d for d, _ in only] == [0]


def test_batch_is_the_single_queries(index):
    a, b, c = VOCABULARY[:3]
    boolean = lambda *clauses, **options: Boolean(tuple(Clause(o, Term("field", t)) for o, t in clauses), **options)
    queries = {
        "q1": boolean((S, a), (S, b)),
        "q2": Term("field", b),
        "q3": Phrase("field", (a, b)),
        "q4": boolean((M, a), (S, c), (N, b)),
        "q5": boolean((S, a), (S, a), (S, c), disable_coord=True),
        "q6": Fuzzy("field", a + b, 1),
        "q7": boolean((N, a)),
        "q8": boolean((M, "absent"), (S, a)),
        "q9": Term("field", a, docs_only=True),
        "q10": boolean((S, a), (S, b), (S, c), min_should_match=2),
        "q11": ConstantScore(Term("field", a), 3.0),
    }
    got = {}
    for r in search_many(index, queries, 10).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.doc_id, r.score))
    for name, q in queries.items():
        assert [(d, s) for _, d, s in sorted(got.get(name, []))] == run(index, q, 10)[1]
    assert search_many(index, {}, 10).count() == 0


def test_strict_and_arguments(index):
    a, b = VOCABULARY[:2]
    term = lambda t, name="field": Term(name, t)
    for q in (
        Phrase("field", (a, b), slop=1),
        Boolean.of((S, term(a)), (S, term(b)), min_should_match=2),
        Boolean.of((M, term(a)), (M, Boolean.of((S, term(b))))),
        Boolean.of((M, term(a)), (M, term(a, "other"))),
        Boolean.of((N, term(a))),
    ):
        with pytest.raises(UnsupportedQuery):
            search(index, q, 10, strict=True)
        search(index, q, 10).hits.collect()
    with pytest.raises(UnsupportedQuery):
        search(index, term(a), 0)


def test_minimum_should_match_beside_required(index):
    a, b, c = VOCABULARY[:3]
    q = Boolean.of((M, Term("field", a)), (S, Term("field", b)), (S, Term("field", c)), min_should_match=1)
    want = [i for i, d in enumerate(Plain(TEXTS).docs) if a in d and (b in d or c in d)]
    assert sorted(d for d, _ in run(index, q)[1]) == want
    assert [d for d, _ in run(index, ConstantScore(q))[1]] == want
    assert sorted(r.doc_id for r in match(index, q).collect()) == want
