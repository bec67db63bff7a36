import random
import re

import plain
import pytest
from plain import Plain

from quern.functions import folding
from quern.operators.facets import drill_down, drill_sideways, facet_counts, top_children
from quern.operators.search import match, search
from quern.plans.query import MUST, MUST_NOT, SHOULD, Boolean, Clause, Phrase, Term, UnsupportedQuery
from quern.sources import index as tables
from quern.sources.index import IndexSpec, SearchIndex
from quern.streaming.incremental import index_stream, merge_segments, snapshot

S, M, N = SHOULD, MUST, MUST_NOT
DIMS = ("shelf", "tongue", "decade")


def boolean(*clauses):
    return Boolean(tuple(Clause(o, Term("field", t)) for o, t in clauses))


def library(seed=41, n=80):
    """Texts, and of each its paths by dimension: several shelves of up to three levels, at most one tongue, one decade."""
    draw = random.Random(seed)
    texts = [" ".join(draw.choices(["oak", "elm", "yew", "ash"], [8, 4, 2, 1], k=draw.randint(0, 6))) for _ in range(n)]
    rooms = ["art", "art/film", "art/film/mute", "law", "law/tax", "sea", "sea/ice"]
    shelf = {
        i: {"shelf": draw.choices(rooms, k=draw.randint(0, 3)), "tongue": [draw.choice(["it", "nl", "pl"])] if draw.random() < 0.9 else [], "decade": [draw.choice(["50s", "60s", "70s", "80s"])]}
        for i in range(n)
    }
    return texts, shelf


@pytest.fixture(scope="module")
def books(spark):
    texts, shelf = library()
    rows = [(i, t, shelf[i]["shelf"] or None, (shelf[i]["tongue"] or [None])[0], shelf[i]["decade"][0]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, field string, shelf array<string>, tongue string, decade string")
    return SearchIndex.build(df, IndexSpec(text_fields=("field",), facets=tuple((d, d) for d in DIMS))).counted()


CASES = [
    (Term("field", "oak"), lambda d: "oak" in d, {"tongue": ["nl"]}),
    (boolean((S, "elm"), (S, "yew")), lambda d: "elm" in d or "yew" in d, {"shelf": ["art/film", "sea"]}),
    (boolean((M, "oak"), (N, "elm")), lambda d: "oak" in d and "elm" not in d, {"shelf": ["law"], "decade": ["50s", "70s"]}),
    (boolean((M, "oak"), (S, "ash")), lambda d: "oak" in d, {"shelf": ["art"], "tongue": ["it", "pl"], "decade": ["60s", "70s", "80s"]}),
    (Phrase("field", ("oak", "elm")), lambda d: any(p == ("oak", "elm") for p in zip(d, d[1:])), {"decade": ["80s"]}),
    (Term("field", "absent"), lambda d: False, {"tongue": ["it"]}),
    (Term("field", "elm"), lambda d: "elm" in d, {"tongue": ["xx"]}),
    (None, lambda d: True, {"tongue": ["nl"], "shelf": ["sea/ice"]}),
    (Term("field", "yew"), lambda d: "yew" in d, {}),
]


@pytest.mark.parametrize("at", range(len(CASES)))
def test_drill_sideways_against_plain_counts(spark, books, at):
    query, accept, drills = CASES[at]
    texts, shelf = library()
    requests = [("shelf", 10), ("tongue", 2), ("shelf", 10, "art"), ("decade", 3), ("shelf", 1, "art/film"), ("shelf", 2)]
    for gone in ((), (0, 3, 8, 21, 34, 55)):
        index = books.with_deletes(spark.createDataFrame([(i,) for i in gone], "doc_id long")) if gone else books
        live = [i for i, t in enumerate(texts) if accept(t.split()) and i not in gone]
        hits, counts = plain.sideways(shelf, live, drills, requests)
        got = drill_sideways(index, query, drills, requests, 100, reuse=bool(gone))
        assert sorted(r.doc_id for r in got.hits.collect()) == hits
        assert got.totals.first().total_hits == len(hits)
        rows = got.facets.orderBy("request_idx", "rank").collect()
        assert [[(r.label, r["count"]) for r in rows if r.request_idx == n] for n in range(len(requests))] == counts
        missed = {d: [i for i in live if i not in hits and i in plain.sideways(shelf, live, {k: v for k, v in drills.items() if k != d}, [])[0]] for d in drills}
        assert {r.dim: (r.hits, r.near_misses) for r in got.sideways.collect()} == {d: (len(hits), len(x)) for d, x in missed.items()}
        got.release()
    if query is not None and drills:
        assert sorted(r.doc_id for r in drill_down(books, query, drills).collect()) == plain.sideways(shelf, [i for i, t in enumerate(texts) if accept(t.split())], drills, [])[0]


def test_sideways_arguments(books):
    for query, drills in ((None, {"tongue": ["nl"]}), (Term("field", "oak"), {})):
        with pytest.raises(UnsupportedQuery):
            drill_sideways(books, query, drills, [("tongue", 1)], 10, strict=True)
    with pytest.raises(UnsupportedQuery):
        drill_sideways(books, Term("field", "oak"), {"tongue": ["nl"]}, [], 0)
    assert drill_sideways(books, Term("field", "oak"), {"tongue": ["nl"]}, [("tongue", 1)], 10, strict=True).hits.count() > 0


def test_facet_counts_against_plain_counts(spark, books):
    texts, shelf = library()
    for gone in ((), (1, 2, 3)):
        index = books.with_deletes(spark.createDataFrame([(i,) for i in gone], "doc_id long")) if gone else books
        want = {}
        for i in shelf:
            for dim, paths in shelf[i].items():
                for label in {"/".join(p.split("/")[: n + 1]) for p in paths for n in range(p.count("/") + 1)}:
                    if i not in gone:
                        want[dim, label] = want.get((dim, label), 0) + 1
        assert {(r.dim, r.label): r["count"] for r in facet_counts(index).collect()} == want
    top = top_children(books, facet_counts(books), 2, "art").where("dim = 'shelf'").collect()
    assert [r.label for r in top] == ["art/film"]


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame([(0, "a b c", "k"), (1, "a a", None), (2, None, "k")], "doc_id long, field string, tag string")
    spec = IndexSpec(text_fields=("field",), keyword_fields=("tag",))
    SearchIndex.build(df, spec).save(str(tmp_path))
    index = SearchIndex.load(spark, str(tmp_path))
    assert index.n_docs == 3 and index.spec == spec
    a = match(index, Term("field", "a"))
    assert index.doc_freqs({("field", "a"), ("field", "b"), ("tag", "k"), ("field", "z")}) == {("field", "a"): 2, ("field", "b"): 1, ("tag", "k"): 2}
    assert sorted(r.doc_id for r in a.collect()) == [0, 1]
    assert "PushedFilters: [" in a._jdf.queryExecution().toString() and "EqualTo(term,a)" in a._jdf.queryExecution().toString()
    assert "positions" not in a._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in match(index, Term("tag", "k")).collect()) == [0, 2]


def test_snapshots(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a")], "doc_id long, field string")
    index = SearchIndex.build(df, IndexSpec(text_fields=("field",))).counted()
    later = index.with_deletes(spark.createDataFrame([(0,)], "doc_id long"))
    assert match(index, Term("field", "a")).count() == 2
    assert search(later, Term("field", "a"), 5).hits.collect() == [(1, 1, match(index, Term("field", "a")).first().score)]


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "index"
    schema = "doc_id long, field string"
    segments = []
    for batch, rows in enumerate(([(0, "a b"), (1, "b")], [(2, "a")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        index_stream(stream, IndexSpec(text_fields=("field",)), str(out), str(tmp_path / "state")).awaitTermination()
        segments.append(batch)
        index = snapshot(spark, str(out), segments)
    whole = SearchIndex.build(spark.createDataFrame([(0, "a b"), (1, "b"), (2, "a")], schema), IndexSpec(text_fields=("field",))).counted()
    query = boolean((S, "a"), (S, "b"))
    assert sorted(match(index, query).collect()) == sorted(match(whole, query).collect())
    assert index.n_docs == 3
    merged = merge_segments(spark, str(out), segments, 100)
    assert merged.n_docs == 3 and sorted(match(merged, query).collect()) == sorted(match(whole, query).collect())


def test_written_postings_are_not_shuffled(spark, tmp_path):
    """Booleans and phrases are answered bucket by bucket; results are those of the index in memory."""
    texts, _ = library(42, 200)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, field string")
    built = SearchIndex.build(df, IndexSpec(text_fields=("field",)))
    built.save(str(tmp_path), buckets=3)
    index = SearchIndex.load(spark, str(tmp_path))
    for query in (boolean((M, "oak"), (M, "elm")), boolean((S, "oak"), (S, "yew"), (N, "ash")), Phrase("field", ("oak", "elm"))):
        found = match(index, query)
        assert sorted(found.collect()) == sorted(match(built.counted(), query).collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan, plan


@pytest.mark.parametrize("ids", [(1, 1, 2), (1, None, 2)])
def test_repeated_and_null_ids_are_refused(spark, tmp_path, ids):
    df = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, field string")
    with pytest.raises(ValueError):
        SearchIndex.build(df, IndexSpec(text_fields=("field",))).save(str(tmp_path))


def test_fields_without_norms(spark):
    df = spark.createDataFrame([(0, "oak oak elm", "oak"), (1, "oak", "oak oak oak oak")], "doc_id long, field string, other string")
    index = SearchIndex.build(df, IndexSpec(text_fields=("field", "other"), no_norms=("other",))).counted()
    score = {r.doc_id: r.score for r in match(index, Term("other", "oak")).collect()}
    assert abs(score[1] - 2 * score[0]) < 1e-5
    plainly = dict(Plain(["oak oak elm", "oak"]).hits(("term", "oak")))
    assert all(abs(r.score - plainly[r.doc_id]) < 1e-5 for r in match(index, Term("field", "oak")).collect())
    assert match(index, Term("nosuchfield", "oak")).count() == 0


@pytest.mark.parametrize("run_bytes, rows", [(16 << 20, 20_000), (40, 3)])
def test_folded_texts_against_plain_ones(spark, monkeypatch, run_bytes, rows):
    """Runs of all texts and of few, one longer than a run; white space of every kind, none, nulls, ids out of order."""
    monkeypatch.setattr(folding, "FOLDED_BYTES", run_bytes)
    monkeypatch.setattr(folding, "FOLDED_ROWS", rows)
    texts = {9: "  a b\ta ", 2: None, 7: "", 4: " \n", 5: "\u00c9 x\u00a0y \x0bzz\x0c\x85q \x1c", 1: "a", 3: "a b " * 40, 8: "B a"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, field string").coalesce(1)
    postings = SearchIndex.build(df, IndexSpec(text_fields=("field",))).postings
    got = {(r.doc_id, r.term): (r.tf, list(r.positions)) for r in postings.collect()}
    want = {}
    for i, text in texts.items():
        for at, w in enumerate(w for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w):
            want.setdefault((i, w), []).append(at)
    assert got == {k: (len(v), v) for k, v in want.items()}
    assert "MapInArrow" in postings._jdf.queryExecution().executedPlan().toString()


def test_buckets_follow_the_input(spark, tmp_path, monkeypatch):
    spark.range(4000).selectExpr("id AS doc_id", "concat('w', id, ' oak') AS field").write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(tables, "BUCKET_BYTES", 2000)
    assert tables._buckets(df) > 8 > 4 == tables._buckets(spark.createDataFrame([(1, "a")], "doc_id long, field string"))
    SearchIndex.build(df, IndexSpec(text_fields=("field",))).save(f"{tmp_path}/out")
    index = SearchIndex.load(spark, f"{tmp_path}/out")
    assert index.n_docs == match(index, Term("field", "oak")).count() == 4000
