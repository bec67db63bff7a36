"""Ranked search: the best documents, all hits counted."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scoring import DIGITS
from quern.plans.compile import Compiler
from quern.plans.query import Query, UnsupportedQuery
from quern.plans.rewrite import check_strict, rewrite
from quern.sources.index import SearchIndex


@dataclass
class TopDocs:
    """hits(rank, doc_id, score); totals(total_hits, max_score), max_score null when nothing matches."""

    hits: DataFrame
    matches: DataFrame

    @cached_property
    def totals(self) -> DataFrame:
        return self.matches.agg(F.count(F.lit(1)).alias("total_hits"), F.max("score").alias("max_score"))


def ranked(matches: DataFrame, top_n: int, order=None) -> DataFrame:
    """The first ``top_n`` by score descending, then doc_id; only those rows are numbered."""
    order = order or ["score DESC", "doc_id ASC"]
    best = matches.orderBy(*[F.expr(x.removesuffix(" DESC")).desc() if x.endswith(" DESC") else F.expr(x.removesuffix(" ASC")) for x in order]).limit(top_n)
    return best.selectExpr(f"row_number() OVER (ORDER BY {', '.join(order)}) AS rank", "*")


def match(index: SearchIndex, query: Query, strict: bool = False) -> DataFrame:
    """All live matches (doc_id, score), score rounded."""
    if strict:
        check_strict(query)
    query = rewrite(index, query)
    found = Compiler.of(index, query).matches(query)
    return index.live(found).selectExpr("doc_id", f"round(score, {DIGITS}) AS score")


def search(index: SearchIndex, query: Query, top_n: int, strict: bool = False, sort_by: str | None = None, after: tuple[float, int] | None = None) -> TopDocs:
    """``strict`` raises on queries outside the core set. ``sort_by`` orders by a numeric field of docs instead of the
    score, ``after`` continues behind a (score, doc_id) already seen."""
    if top_n <= 0:
        raise UnsupportedQuery("top_n must be positive")
    matches = match(index, query, strict)
    page = matches
    if after is not None:
        page = matches.where((F.col("score") < after[0]) | ((F.col("score") == after[0]) & (F.col("doc_id") > after[1])))
    if sort_by is not None:
        page = page.join(index.docs.select("doc_id", sort_by), "doc_id")
        return TopDocs(ranked(page, top_n, [f"`{sort_by}` ASC", "doc_id ASC"]), matches)
    return TopDocs(ranked(page, top_n), matches)


def search_many(index: SearchIndex, queries: dict[str, Query], top_n: int) -> DataFrame:
    """(query, rank, doc_id, score) for a batch: statistics in one lookup, all queries in one job.

    Term and Boolean queries share one scan of the postings; others add their own matches.
    """
    rewritten = {name: rewrite(index, q) for name, q in queries.items()}
    compiler = Compiler.of(index, *rewritten.values())
    names = list(rewritten)
    together = [n for n in names if compiler.batchable(rewritten[n])]
    spark = index.docs.sparkSession
    found = None
    if together:
        named = F.broadcast(spark.createDataFrame(list(enumerate(together)), "query_no int, query string"))
        found = compiler.batch([rewritten[n] for n in together]).join(named, "query_no").select("query", "doc_id", "score")
    for name in names:
        if name not in together:
            part = compiler.matches(rewritten[name]).select(F.lit(name).alias("query"), "doc_id", "score")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query string, rank int, doc_id long, score double")
    scored = index.live(found).select("query", "doc_id", F.round("score", DIGITS).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_n).select("query", "rank", "doc_id", "score")
