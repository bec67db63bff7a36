"""Index batches of a document stream: each micro-batch adds a segment of postings; readers see written segments only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.index import IndexSpec, SearchIndex


def index_stream(stream: DataFrame, spec: IndexSpec, path: str, checkpoint: str, **trigger):
    """Start a query that appends every micro-batch as ``path/segment=<batch>``; a batch that runs again overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            SearchIndex.build(batch, spec).save(f"{path}/segment={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def snapshot(spark: SparkSession, path: str, segments: list[int]) -> SearchIndex:
    """One index over finished segments: postings side by side, statistics added up."""
    parts = [SearchIndex.load(spark, f"{path}/segment={n}") for n in segments]
    union = lambda name: reduce(DataFrame.unionByName, [getattr(p, name) for p in parts])
    stats = union("term_stats").groupBy("field", "term").agg(F.sum("doc_freq").alias("doc_freq"), F.sum("total_term_freq").alias("total_term_freq"))
    taxonomy = union("taxonomy").groupBy("dim", "label", "depth").agg(F.min("ordinal").alias("ordinal"))
    return SearchIndex(parts[0].spec, sum(p.n_docs for p in parts), union("docs"), union("postings"), stats, union("facets"), taxonomy)


def merge_segments(spark: SparkSession, path: str, segments: list[int], into: int) -> SearchIndex:
    """Write finished segments as the one segment ``into``, and load it: a snapshot of it has one part instead of many."""
    snapshot(spark, path, segments).save(f"{path}/segment={into}")
    return SearchIndex.load(spark, f"{path}/segment={into}")
