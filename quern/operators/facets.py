"""Facet counts, drill-down and drill-sideways."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.search import match, ranked
from quern.plans.query import MatchAll, Query, UnsupportedQuery
from quern.sources.index import SearchIndex


@dataclass
class DrillSideways:
    """hits(rank, doc_id, score), totals(total_hits, max_score), facets(request_idx, dim, depth, label, count, rank)."""

    hits: DataFrame
    totals: DataFrame
    facets: DataFrame
    #: (dim, hits, near_misses) of each drilled dimension.
    sideways: DataFrame
    kept: DataFrame | None = None

    def release(self) -> None:
        """Let go of the matches that ``reuse`` kept."""
        if self.kept is not None:
            self.kept.unpersist()


def facet_counts(index: SearchIndex, docs: DataFrame | None = None) -> DataFrame:
    """(dim, depth, label, count) over ``docs`` (doc_id), or over all live documents; a document counts once per category."""
    rows = index.facets if docs is None else index.facets.join(docs.select("doc_id"), "doc_id", "left_semi")
    rows = index.live(rows)
    return rows.groupBy("dim", "depth", "label").agg(F.count(F.lit(1)).alias("count"))  # a row per document and category


def top_children(index: SearchIndex, counts: DataFrame, k: int, parent: str | None = None) -> DataFrame:
    """The k children of ``parent`` (of the dimension, if null) with the highest counts; of equal ones the one added later."""
    if parent is None:
        counts = counts.where("depth = 1")
    else:
        counts = counts.where((F.col("depth") == parent.count("/") + 2) & F.col("label").startswith(parent + "/"))
    placed = counts.join(index.taxonomy.select("dim", "label", "ordinal"), ["dim", "label"])
    order = Window.partitionBy("dim").orderBy(F.desc("count"), F.desc("ordinal"))
    return placed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("ordinal")


def drill_down(index: SearchIndex, query: Query, drills: dict[str, list[str]]) -> DataFrame:
    """Matches of the query that hold, in every dimension, one of its values."""
    return _flagged(index, match(index, query), drills).where("missing = 0").select("doc_id", "score")


def _flagged(index: SearchIndex, base: DataFrame, drills: dict[str, list[str]]) -> DataFrame:
    """``base`` with the number of drilled dimensions missed, and, if it is one, which: one aggregation over the facets."""
    if not drills:
        return base.withColumns({"missing": F.lit(0), "missed": F.lit(None).cast("string")})
    wanted = None
    for dim, values in drills.items():
        one = (F.col("dim") == dim) & F.col("label").isin(values)
        wanted = one if wanted is None else wanted | one
    dims = sorted(drills)
    held = index.facets.where(wanted).groupBy("doc_id").agg(F.collect_set("dim").alias("held"))
    joined = base.join(held, "doc_id", "left")
    missed = F.array_except(F.array(*[F.lit(d) for d in dims]), F.coalesce("held", F.array().cast("array<string>")))
    return joined.select(*base.columns, F.size(missed).alias("missing"), F.when(F.size(missed) == 1, missed[0]).alias("missed"))


def _asked(requests: list[tuple]) -> list[tuple[int, str, int, int, str]]:
    """(request_idx, dim, k, depth, prefix) of requests (dim, k) for a dimension's values, or (dim, k, parent) for a category's children."""
    out = []
    for at, (dim, k, *rest) in enumerate(requests):
        parent = rest[0] if rest and rest[0] else None
        out.append((at, dim, k, parent.count("/") + 2 if parent else 1, f"{parent}/" if parent else ""))
    return out


def drill_sideways(
    index: SearchIndex, query: Query | None, drills: dict[str, list[str]], requests: list[tuple], top_n: int, strict: bool = False, reuse: bool = False
) -> DrillSideways:
    """Hits hold every drilled dimension. A drilled dimension is counted over the hits and the documents that miss only
    it; any other over the hits. ``requests``: (dim, k) or (dim, k, parent), answered in this order. Without a query all
    documents match. ``reuse`` keeps the matches for all four results, until ``release``; else each compiles its own."""
    if top_n <= 0:
        raise UnsupportedQuery("top_n must be positive")
    if strict and (query is None or not drills):
        raise UnsupportedQuery("drill-sideways: a query and one dimension at least")
    base = _flagged(index, match(index, query or MatchAll(), strict), drills).where("missing <= 1")
    if reuse:
        base = base.persist()
    hits = base.where("missing = 0").select("doc_id", "score")
    totals = hits.agg(F.count(F.lit(1)).alias("total_hits"), F.max("score").alias("max_score"))
    asked = index.facets.sparkSession.createDataFrame(_asked(requests), "request_idx int, dim string, k int, depth int, prefix string")
    wanted = index.facets.where(F.col("dim").isin([r[0] for r in requests])).join(F.broadcast(asked), ["dim", "depth"]).where(F.col("label").startswith(F.col("prefix")))
    rows = wanted.join(base, "doc_id").where("missing = 0 or missed = dim")
    counted = rows.groupBy("request_idx", "dim", "depth", "label", "k").agg(F.count(F.lit(1)).alias("count"))
    placed = counted.join(index.taxonomy.select("dim", "label", "ordinal"), ["dim", "label"])
    order = Window.partitionBy("request_idx").orderBy(F.desc("count"), F.desc("ordinal"))
    # the literal bound lets each task drop what can't be among the first before rows meet
    facets = placed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max([r[1] for r in requests], default=0)).where("rank <= k")
    near = base.agg(
        F.count_if(F.col("missing") == 0).alias("hits"),
        *[F.count_if(F.coalesce(F.col("missed") == d, F.lit(False))).alias(f"near_{i}") for i, d in enumerate(sorted(drills))],
    )
    entries = [F.struct(F.lit(d).alias("dim"), F.col("hits"), F.col(f"near_{i}").alias("near_misses")) for i, d in enumerate(sorted(drills))]
    sideways = near.select(F.explode(F.array(*entries))).select("col.*") if entries else near.select(F.lit("").alias("dim"), "hits", F.lit(0).alias("near_misses")).where("false")
    return DrillSideways(ranked(hits, top_n), totals, facets.select("request_idx", "dim", "depth", "label", "count", "rank"), sideways, base if reuse else None)
