"""MinHash near-dedup: SuperMinHash, banding, verification on full sets, grouping.

Signatures: every shingle draws one rank for each slot of the signature along its own
permutation, level by level: level j offers a value in [j, j+1) to the j-th slot of the
permutation. Once every slot holds a value, later levels can't lower any, and the shingles
stop early; long texts stop after the first level or two.

Documents with equal sets are one node from the start. 32 bands of 4 rows make candidates:
a pair at the threshold is missed with probability (1 - 0.75^4)^32, about 5e-6. In each
bucket every member is compared with the bucket's smallest; links that hold on the full sets
are grouped. In buckets whose members aren't one group by then, members are dealt by hash
into chunks and compared with their chunk's first, in ``ROUNDS`` deals: in a large group of
texts around the threshold each member meets a member of many buckets, and what is linked at
all is soon one group. A last pass settles the rest exactly. It looks for links between groups
only, and on one side only for members that don't belong to their bucket's largest group:
shingles are ordered from rare to frequent, and two sets are compared only if they share one
so early that the overlap they need can still follow. That loses no link; copies edited beyond
the threshold, and texts that share a passage, have rare shingles of their own in those
places. Its candidates are the pairs between small groups and others of a bucket, so they
grow with the square of a bucket only if its members are near the threshold and yet
unlinked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import UPPER, read_table, stage
from quern.llm.components import connected_components
from quern.llm.hashing import U64, digest, mix, word_hashes, words_of

SHINGLE = 5
THRESHOLD = 75
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Ids of candidate documents are broadcast up to this many rows; more meet the texts in a shuffled join.
BROADCAST_IDS = 1_000_000
#: Deals of unsettled buckets into chunks of about so many members, before the last pass.
ROUNDS, CHUNK = 2, 16

_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=U64)
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def shingle_set(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of lower-cased words; of a shorter text, the whole sequence."""
    w = word_hashes(words_of(data.lower()))
    n = len(w)
    if n == 0:
        return w
    weights = np.resize(_WEIGHTS, size) if size > len(_WEIGHTS) else _WEIGHTS[:size]
    if n < size:
        return mix(np.array([np.sum(w * weights[:n]) + U64(n)], dtype=U64))
    x = w[: n - size + 1] * weights[0]
    for k in range(1, size):
        x = x + w[k : n - size + 1 + k] * weights[k]
    return np.unique(mix(x))


def super_minhash(items: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature of a non-empty set of 64-bit hashes."""
    out = np.full(slots, _EMPTY, dtype=U64)
    swaps: list[np.ndarray] = []
    table = np.tile(np.arange(slots), (len(items), 1)) if len(items) <= 64 else None
    rows = np.arange(len(items))
    for level in range(slots):
        drawn = mix(items + U64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = (level + (((drawn & U64(0xFFFFFFFF)) * U64(slots - level)) >> U64(32)).astype(np.int64)).astype(np.int64)
        if table is not None:
            slot = table[rows, at]
            table[rows, at] = table[:, level]
            table[:, level] = slot
        else:
            slot = at
            for back in range(level - 1, -1, -1):
                slot = np.where(slot == back, swaps[back], np.where(slot == swaps[back], back, slot))
            swaps.append(at)
        np.minimum.at(out, slot, (U64(level) << U64(32)) | (drawn >> U64(32)))
        if not (out == _EMPTY).any():
            break
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    x = np.arange(1, bands + 1, dtype=U64) * U64(0xD1342543DE82EF95)
    for row in signature.reshape(bands, rows).T:
        x = mix(x + row)
    return x.view(np.int64)


_SCAN = "id long, n_shingles long, digest binary, bands array<long>"
_SETS = "id long, shingles array<long>"


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
    for i in range(batch.num_rows):  # one text at a time, so that a batch is never held twice
        yield ids[i].as_py(), texts[i].as_py() or b""


def _scanner(shingle: int, bands: int, rows: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for ident, data in _texts(batch):
                s = shingle_set(data, shingle)
                out[0].append(ident)
                out[1].append(len(s))
                out[2].append(digest(s.tobytes()))
                out[3].append(band_hashes(super_minhash(s, bands * rows), bands, rows) if len(s) and ident is not None else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))],
                names=["id", "n_shingles", "digest", "bands"],
            )

    return scan


def _set_maker(shingle: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, made, held = [], [], 0
            for ident, data in _texts(batch):
                ids.append(ident)
                made.append(shingle_set(data, shingle).view(np.int64))
                held += len(made[-1])
                if held > 1_000_000:
                    yield _set_batch(ids, made)
                    ids, made, held = [], [], 0
            yield _set_batch(ids, made)

    return sets


def _set_batch(ids: list, made: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.list_(pa.int64()))], names=["id", "shingles"])


def only_ids(rows: DataFrame, ids: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``rows`` whose id is in ``ids`` (staged, distinct)."""
    return rows.join(F.broadcast(ids) if ids.count() <= bound else ids, "id", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs, rows of (a, b, ...), whose sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    low, high = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    # sizes alone rule a pair out before its sets are met
    common = F.when(100 * low >= threshold * high, F.size(F.array_intersect("sa", "sb"))).otherwise(0)
    return both.withColumn("common", common).where(100 * F.col("common") >= threshold * (F.size("sa") + F.size("sb") - F.col("common"))).select(*pairs.columns)


def _prefixes(sets: DataFrame, threshold: int) -> DataFrame:
    """(id, n, head) of each set that may link at all: its size, and its rarest shingles with their places.

    Shingles are ordered by the number of sets that hold them, then by value. An overlap of
    ``needed`` has its first shingle at place ``n - needed`` or before in either set, and
    needed is at least ``threshold`` percent of n, so only the places up to there are told.
    Shingles that no other id holds come first and can't be shared; they only take places.
    """
    rows = sets.select("row_no", "id", F.explode("shingles").alias("s"))
    # grouped with a second column, joined without it: the join gets exchanges of its own
    shared = rows.groupBy("s", F.pmod("s", F.lit(3)).alias("third")).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("held")).where("low < high").select("s", "held")
    ordered = rows.join(shared, "s").groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("held", "s"))).alias("common"))
    n, common = F.size("shingles"), F.size("common")
    whole = sets.join(ordered, "row_no").select("id", n.alias("n"), (n - common).alias("alone"), "common")
    told = F.col("n") - F.ceil(F.col("n") * threshold / 100).cast("int") + 1 - F.col("alone")
    head = F.transform(F.slice("common", F.lit(1), F.greatest(told, F.lit(0))), lambda x, k: F.struct((k + F.col("alone")).alias("place"), x["s"].alias("s")))
    return whole.where(told > 0).select("id", F.col("n").cast("long").alias("n"), head.alias("head"))


def _unsettled(grouped: DataFrame) -> DataFrame:
    """Of rows of (bucket, node, group) those in buckets of several groups, with the largest group and the number of members."""
    sizes = grouped.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
    sizes = sizes.agg(F.max(F.struct("n", "group")).alias("main"), F.sum("n").alias("held"), F.count(F.lit(1)).alias("n_groups")).where("n_groups > 1")
    return grouped.select("bucket", "node", "group").join(sizes.select("bucket", F.col("main.group").alias("main_group"), "held"), "bucket")


def _joined(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) of the groups that links, rows of (ga, gb), join."""
    return stage(spark, connected_components(spark, links.select(F.col("ga").alias("a"), F.col("gb").alias("b"))), "minhash-moves")


def _moved(rows: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    """``rows`` with the groups in ``column`` replaced by those that they were joined to, (node, component)."""
    to = moves.select(F.col("node").alias(column), F.col("component").alias("to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("to", column)).drop("to")


def near_duplicates(
    spark: SparkSession,
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    shingle: int = SHINGLE,
    threshold: int = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    seen: dict | None = None,
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, kept.

    Null and empty texts have the empty set and link with nothing. The id names a document:
    rows that repeat an id are one node, linked by any of their texts. A row with a null id links with nothing, has a null
    component and is kept. An empty table gives an empty table. Other columns of ``df`` are
    not looked at. ``seen`` is told the numbers of pairs compared: with their bucket's first,
    with the deals' as well, and in the last pass.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scan = stage(spark, texts.mapInArrow(_scanner(shingle, bands, rows), _SCAN), "minhash")

    # equal sets: one node. Grouped with n_shingles, joined without: the join gets exchanges of its own
    linkable = scan.where("id is not null and n_shingles > 0")
    same = linkable.groupBy("digest", "n_shingles").agg(F.min("id").alias("node"), F.max("id").alias("last")).where("node < last")
    same = same.select("digest", "node")
    nodes = stage(spark, linkable.join(same, "digest", "left").select("id", "n_shingles", F.coalesce("node", "id").alias("node"), "bands"), "minhash-nodes")

    spread = nodes.where("id = node").select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = spread.groupBy("bucket", "band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last")
    members = stage(spark, spread.join(shared.select("bucket", "lead"), "bucket").select("bucket", "lead", "node"), "minhash-members")
    pairs = stage(spark, members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "minhash-pairs")

    ids = stage(spark, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "minhash-ids")
    sets = only_ids(texts, ids).mapInArrow(_set_maker(shingle), _SETS)
    sets = stage(spark, sets.withColumn("row_no", F.monotonically_increasing_id()), "minhash-sets")
    # an id with different texts may be in several nodes; it links them
    several = nodes.groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("id")
    own = only_ids(nodes.select("id", "node"), stage(spark, several, "minhash-several")).select(F.col("id").alias("a"), F.col("node").alias("b")).distinct()
    links = stage(spark, _verified(pairs, sets, threshold).unionByName(own), "minhash-links")
    groups = stage(spark, connected_components(spark, links), "minhash-groups")

    of_node = groups.select("node", F.col("component").alias("group"))
    grouped = members.select("bucket", "node").join(of_node, "node", "left").select("bucket", "node", F.coalesce("group", "node").alias("group"))
    unsettled = stage(spark, _unsettled(grouped), "minhash-unsettled")
    met, moves = pairs, []
    for deal in range(ROUNDS):
        # members of large unsettled buckets against the first, by hash, of their chunk; small buckets wait for the last pass
        large = unsettled.where(F.col("held") > CHUNK)
        rank = F.xxhash64("node", "bucket", F.lit(deal))
        dealt = large.withColumns({"rank": rank, "chunk": F.pmod(F.xxhash64("node", F.lit(~deal)), F.ceil(F.col("held") / CHUNK))})
        first = dealt.groupBy("bucket", "chunk").agg(F.min(F.struct("rank", "node", "group")).alias("first"))
        drawn = dealt.join(first, ["bucket", "chunk"]).where(F.col("group") != F.col("first.group"))
        drawn = drawn.select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b"), F.col("group").alias("ga"), F.col("first.group").alias("gb"))
        drawn = stage(spark, drawn.dropDuplicates(["a", "b"]).join(met, ["a", "b"], "left_anti"), "minhash-drawn")
        if drawn.isEmpty():
            break
        met = met.unionByName(drawn.select("a", "b"))
        # groups are the nodes from here on
        moves.append(_joined(spark, _verified(drawn, sets, threshold)))
        unsettled = stage(spark, _unsettled(_moved(unsettled, moves[-1], "group")), "minhash-unsettled")

    # members outside their bucket's largest group, against all of other groups
    apart = unsettled.where("group <> main_group").select(F.col("node").alias("id")).distinct()
    unsettled = stage(spark, unsettled.select(F.col("node").alias("id"), "group").distinct(), "minhash-unsettled")
    heads = stage(spark, _prefixes(sets.join(unsettled.select("id"), "id", "left_semi"), threshold), "minhash-heads")
    heads = heads.join(unsettled, "id").select("id", "group", "n", F.inline("head"))
    x = heads.join(apart, "id", "left_semi").select("s", F.col("id").alias("x"), F.col("group").alias("gx"), F.col("n").alias("nx"), F.col("place").alias("px"))
    y = heads.select("s", F.col("id").alias("y"), F.col("group").alias("gy"), F.col("n").alias("ny"), F.col("place").alias("py"))
    # what both hold from their places on must reach threshold/(100 + threshold) of both sizes
    left = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    possible = ((100 + threshold) * left >= threshold * (F.col("nx") + F.col("ny"))) & (100 * F.least("nx", "ny") >= threshold * F.greatest("nx", "ny"))
    rest = x.join(y, "s").where((F.col("gx") != F.col("gy")) & possible).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("gx").alias("ga"), F.col("gy").alias("gb"))
    rest = stage(spark, rest.dropDuplicates(["a", "b"]).join(met, ["a", "b"], "left_anti"), "minhash-rest")
    if seen is not None:
        seen.update(first=pairs.count(), met=met.count(), rest=rest.count())
    if not rest.isEmpty():
        moves.append(_joined(spark, _verified(rest, sets, threshold)))

    named = groups.select("node", "component")
    of_id = nodes.select("id", "node").distinct().join(named, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    for move in moves:
        of_id = _moved(of_id, move, "component")
    of_id = of_id.groupBy("id").agg(F.min("component").alias("component_id"))
    out = scan.select(F.col("id").alias("doc_id"), "n_shingles").join(of_id.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(spark: SparkSession, df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` with one document of each group, the one with the smallest id; columns as they were."""
    gone = near_duplicates(spark, df, text_col, id_col, **options).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    gone = stage(spark, gone, "minhash-gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return df.join(side, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(spark, read_table(spark, sf_dir, "documents"))


OP5_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w),
e AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(node, other) AS (
  SELECT a, b FROM p
  UNION
  SELECT r.node, p.b FROM r JOIN p ON r.other = p.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
FROM s LEFT JOIN (SELECT node, min(other) AS m FROM r GROUP BY node) ON doc_id = node
"""
