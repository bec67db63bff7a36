"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when they are identical after each run of white space is replaced by
one space. A first scan keeps of every row only its length and the hash of its prefix; one
aggregation over (length, prefix hash) names the groups that survive, and only rows of
those are hashed, and in ``drop_exact_duplicates`` moved, in full.

Which rows survive is told by a bitmap over hashes of the surviving keys, of ``FILTER_BITS``
bits whatever the table holds. It is the only thing that is broadcast; a row whose bit is
clear passes without a shuffle, and the others meet the surviving keys themselves in a join.

Groups of any size: counts and keepers are partial aggregates, so a group that holds a
third of all rows sends one row per task. Joins back to the rows have an exchange of their
own on both sides, which lets the adaptive skew join split a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import SPACE_CLASS, read_table, stage

PREFIX_CHARS = 256
#: Bits of the broadcast filter: 2048 rows of 4 KB. With more than some ten million surviving keys it lets
#: more and more other rows into the join, which are told apart there.
FILTER_BITS = 1 << 26


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")


def _keyed(df: DataFrame, text_col: str, *keep: Column, digest: bool) -> DataFrame:
    rows = df.select(*keep, normalised(F.col(text_col)).alias("__norm"))
    full = [F.sha2("__norm", 256).alias("text_sha256")] if digest else []
    return rows.select(
        *[c for c in rows.columns if c != "__norm"],
        F.octet_length("__norm").alias("n_bytes"),
        F.xxhash64(F.substring("__norm", 1, PREFIX_CHARS)).alias("head"),
        *full,
    )


def _surviving(keyed: DataFrame) -> DataFrame:
    """(key) of each (length, prefix hash) group with two rows or more."""
    groups = keyed.groupBy("n_bytes", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.select(F.xxhash64("n_bytes", "head").alias("key"))


def exact_duplicates(spark: SparkSession, df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and all empty texts are equal. The row with the smallest id
    stays; null ids come last; of repeated rows with one id and equal texts one stays. An
    empty table gives an empty table. Other columns of ``df`` are not looked at.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = stage(spark, _keyed(rows, "text", F.col("doc_id"), F.monotonically_increasing_id().alias("row_no"), digest=True), "exact")
    rows = keyed.withColumn("key", F.xxhash64("n_bytes", "head"))
    survivors = rows.join(_surviving(keyed), "key", "left_semi")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_no"))
    groups = (
        survivors.groupBy("text_sha256", "n_bytes")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("text_sha256").alias("sha"), "n", F.col("first.doc_id").alias("first_id"), F.col("first.row_no").alias("first_row"))
    )
    out = keyed.join(groups, keyed.text_sha256 == groups.sha, "left")
    return out.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_no") == F.col("first_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def _filter(survivors: DataFrame, bits: int) -> DataFrame:
    """(slot, bitmap) of the bits of all surviving keys; at most bits / 2^15 rows of 4 KB."""
    bit = F.pmod("key", F.lit(bits))
    return survivors.groupBy(F.bitmap_bucket_number(bit).alias("slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"))


def _is_set(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), place % 8)), F.lit(2)) == 1, F.lit(False))


def drop_exact_duplicates(spark: SparkSession, df: DataFrame, text_col: str = "text", id_col: str = "doc_id", filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``df`` without later copies, all columns as they were.

    Rows outside the surviving groups pass without a shuffle (but for those that share a bit
    of the filter), and only rows inside are hashed in full. Within a group the row with the
    smallest id stays (null ids last; equal ids: the row whose columns hash lowest). Null
    texts count as empty. An empty table gives an empty table.
    """
    columns = df.columns
    names = {c: f"__own_{i}" for i, c in enumerate(columns)}
    rows = df.withColumnsRenamed(names)
    text, ident = F.col(names[text_col]), F.col(names[id_col])
    survivors = stage(spark, _surviving(_keyed(df, text_col, digest=False)), "exact-keys")
    bits = stage(spark, _filter(survivors, filter_bits), "exact-filter")
    norm = normalised(text)
    keyed = rows.withColumn("key", F.xxhash64(F.octet_length(norm), F.xxhash64(F.substring(norm, 1, PREFIX_CHARS))))
    bit = F.pmod("key", F.lit(filter_bits))
    marked = keyed.withColumns({"slot": F.bitmap_bucket_number(bit), "place": F.bitmap_bit_position(bit)}).join(F.broadcast(bits), "slot", "left")
    marked = marked.withColumn("maybe", _is_set(F.col("bitmap"), F.col("place"))).drop("slot", "place", "bitmap")
    own = [F.col(c) for c in names.values()]
    passing = marked.where(~F.col("maybe")).select(*own)
    maybe = marked.where("maybe").join(survivors.withColumn("survives", F.lit(True)), "key", "left")
    maybe = stage(spark, maybe.select(*own, "survives"), "exact-maybe")
    order = F.struct(ident.isNull(), ident, F.xxhash64(*own))
    alone = maybe.where("survives is null").select(*own)
    kept = maybe.where("survives").groupBy(F.sha2(norm, 256).alias("sha")).agg(F.min_by(F.struct(*own), order).alias("row")).select("row.*")
    out = passing.unionByName(alone).unionByName(kept)
    return out.select(*[F.col(names[c]).alias(c) for c in columns])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_duplicates(spark, read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
