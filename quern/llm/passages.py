"""Substring dedup over words: difference-cover anchors.

A difference cover D modulo a period p holds, for every shift, two members that far apart.
Words are hashed in anchors of ``window - p + 1`` words that start at positions in D modulo
p. Wherever two equal windows stand in their documents, some offset below p puts both on
cover positions, so they share an anchor, at the cost of |D|/p anchors per word.

Anchors that occur in two documents or more are shared. Around those, and only there, the
match is extended: every window that holds a shared anchor is hashed in full and resolved to
the smallest document it starts in. This settles all partners of a window at once, and a
passage in a third of all documents costs a row per place, never a row per pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import read_table, stage
from quern.llm.hashing import digest, mix, prefix_sums, window_hashes, word_hashes, words_of

WINDOW = 50
#: Perfect difference covers: every non-zero residue is one difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
PERIOD = 31
#: Keys of involved documents are broadcast up to this many rows of 16 bytes.
BROADCAST_KEYS = 1_000_000
#: Rows with a null id come after all others.
LAST = 2**63 - 1


def period_for(window: int) -> int:
    """The longest period whose anchors keep at least a third of the window."""
    return max(p for p in COVERS if window - p + 1 >= max(2, window // 3))


def cover_positions(n_words: int, anchor: int, period: int) -> np.ndarray:
    """Positions on the cover at which an anchor fits, ascending."""
    n = n_words - anchor + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = (np.arange(0, n, period)[:, None] + np.array(COVERS[period])[None, :]).ravel()
    return at[at < n]


def _rows(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[int, bytes]]:
    texts = batch.column(text_at).cast(pa.binary())
    for i in range(batch.num_rows):
        yield i, texts[i].as_py() or b""


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: number of words, digest and sha256 of the words joined by one space."""
    for batch in batches:
        n, d, s = [], [], []
        for _, data in _rows(batch, 2):
            words = words_of(data)
            joined = b" ".join(words)
            n.append(len(words))
            d.append(digest(joined))
            s.append(hashlib.sha256(joined).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(s, pa.string())], names=["key", "mark", "n_words", "digest", "sha"])


def _anchorer(window: int, period: int):
    anchor = window - period + 1

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, data in _rows(batch, 2):
                words = words_of(data)
                if len(words) < window:
                    out.append(np.zeros(0, np.int64))
                    continue
                prefix = prefix_sums(word_hashes(words))
                out.append(window_hashes(prefix, anchor, cover_positions(len(words), anchor, period)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["key", "mark", "anchors"])

    return anchors


def _extender(window: int, period: int):
    anchor = window - period + 1

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, first, second = [], [], []
            for i, data in _rows(batch, 2):
                words = words_of(data)
                n = len(words) - window + 1
                at = cover_positions(len(words), anchor, period)[np.array(batch.column(3)[i].as_py(), dtype=np.int64)]
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.minimum(np.maximum(at - (window - anchor), 0), n), 1)
                np.add.at(edge, np.minimum(at + 1, n), -1)
                s = np.flatnonzero(np.cumsum(edge[:n]) > 0)
                x = word_hashes(words)
                starts.append(s.astype(np.int32))
                first.append(window_hashes(prefix_sums(x), window, s).view(np.int64))
                second.append((window_hashes(prefix_sums(mix(x)), window, s) >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(starts, pa.list_(pa.int32())), pa.array(first, pa.list_(pa.int64())), pa.array(second, pa.list_(pa.int32()))],
                names=["key", "mark", "starts", "h", "g"],
            )

    return extend


def _cutter(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, spans = [], [], []
            for i, data in _rows(batch, 2):
                words = words_of(data)
                at = np.array(batch.column(3)[i].as_py(), dtype=np.int64)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist()) if not g)).hexdigest())
                turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                spans.append([{"first": int(a), "last": int(b)} for a, b in zip(turns[::2], turns[1::2])])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, kind)], names=["key", "mark", "n_removed", "kept", "spans"])

    return cut


def _only(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``rows`` with staged ``keys`` on key and mark."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, ["key", "mark"], how)


def repeated_passages(
    spark: SparkSession, df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, period: int | None = None
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_removed, kept_sha256, spans (of removed words, end exclusive).

    Null and empty texts have no words. A document with fewer words than a window loses
    none. Equal ids aren't smaller than each other, so repeated rows don't remove one
    another; a null id is larger than all others. An empty table gives an empty table.
    Other columns of ``df`` are not looked at.
    """
    period = period or period_for(window)
    texts = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("key"),
        F.xxhash64(text_col).alias("mark"),  # with the key, names a text even where ids repeat
        F.col(text_col).alias("text"),
    )
    told = stage(spark, texts.mapInArrow(_describe, "key long, mark long, n_words long, digest binary, sha string"), "passages")

    # a whole copy of an earlier document is removed at once and offers no passage that the earlier one doesn't
    same = told.where(F.col("n_words") >= window).groupBy("digest", "n_words").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    copied = told.join(same.select("digest", "first"), "digest").where("first < key")
    copied = stage(spark, copied.select("key", "mark").distinct(), "passages-copies")

    originals = _only(texts, copied, "left_anti")
    anchored = originals.mapInArrow(_anchorer(window, period), "key long, mark long, anchors array<long>").where(F.size("anchors") > 0)
    anchored = stage(spark, anchored.withColumn("row_no", F.monotonically_increasing_id()), "passages-anchors")

    # grouped with a second column and joined without it, so that a hot anchor's rows have an exchange that can be split
    shared = anchored.select("key", F.explode("anchors").alias("h")).groupBy("h", F.pmod("h", F.lit(3)).alias("third"))
    shared = shared.agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("h")
    places = anchored.select("row_no", F.posexplode("anchors").alias("at", "h")).join(shared, "h")
    places = places.groupBy("row_no").agg(F.collect_list("at").alias("at"))
    places = stage(spark, places.join(anchored.select("row_no", "key", "mark"), "row_no").drop("row_no").dropDuplicates(["key", "mark"]), "passages-places")

    involved = _only(texts, places.select("key", "mark"), "left_semi").dropDuplicates(["key", "mark"])
    held = involved.join(places, ["key", "mark"]).select("key", "mark", "text", "at")
    windows = stage(spark, held.mapInArrow(_extender(window, period), "key long, mark long, starts array<int>, h array<long>, g array<int>"), "passages-windows")

    rows = windows.select("key", "mark", F.inline(F.arrays_zip("starts", "h", "g"))).select("key", "mark", F.col("starts").alias("start"), "h", "g")
    firsts = rows.groupBy("h", "g").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    firsts = firsts.select("h", F.col("g").alias("g1"), "first")
    gone = rows.join(firsts, "h").where(((F.col("g") - F.col("g1")) == 0) & (F.col("first") < F.col("key")))
    gone = stage(spark, gone.groupBy("key", "mark").agg(F.collect_list("start").alias("starts")), "passages-gone")

    losing = _only(texts, gone.select("key", "mark"), "left_semi").dropDuplicates(["key", "mark"])
    losing = losing.join(gone, ["key", "mark"]).select("key", "mark", "text", "starts")
    cut = losing.mapInArrow(_cutter(window), "key long, mark long, n_removed long, kept string, spans array<struct<first:int,last:int>>")

    out = told.join(cut, ["key", "mark"], "left").join(copied.withColumn("copy", F.lit(True)), ["key", "mark"], "left")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("last")))
    return out.select(
        F.when(F.col("key") < LAST, F.col("key")).alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<first:int,last:int>>)"))).alias("spans"),
    )


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_words, n_removed, kept_sha256."""
    return repeated_passages(spark, read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS pos, w FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 49], ' ')) AS h FROM s),
d AS (SELECT doc_id, pos FROM h QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM d),
k AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
