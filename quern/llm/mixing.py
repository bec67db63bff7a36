"""Mixing sources to target weights.

Words are counted per document and summed per source. Weights share a total of words;
targets stop at a multiple of their source's size and the excess is shared again by weight
until none is above: in each round the sources that their share would overfill are set to
their cap, which takes two sums over the table of sources. A source's repetition rate is
target/size; each document is emitted floor(rate) times, plus one Bernoulli copy where a
hash of seed and doc_id, read as a number in [0, 1), falls below a threshold. The threshold
is the fraction of the rate, moved to where the source's own draws give the fraction of its
words: words are summed by source and draw, in ``BINS`` steps of the draw, and the step is
taken at which their running sum comes nearest to what floor(rate) leaves of the target.

Sources are a distributed table: they are numbered by a range-partitioned sort and the
counts of its partitions, and only sums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD_CLASS, read_table, stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_RATE = 2.0
SEED = "mix-1"
#: Steps of the draw, in which a source's words are summed.
BINS = 4096
#: Source tables up to this many rows are broadcast; larger ones meet the documents in a shuffled join.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def _numbered(spark: SparkSession, per: DataFrame) -> DataFrame:
    """``per`` with ``turn``, the place of its source by code point, null last, from 0.

    The window runs over one row for each partition of the sort, not over the sources.
    """
    rows = per.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id())
    rows = stage(spark, rows.select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(parts), "part").select(*per.columns, (F.col("first") + F.col("place")).alias("turn"))


def source_targets(spark: SparkSession, sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    Sources are ordered by code point, null last, and take the weights in turn. A source of
    size 0 has target and rate 0. If every source is at its cap, the caps are the targets.
    """
    per = _numbered(spark, sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    per = stage(spark, per.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_rate))).alias("cap")), "mix-weights")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    # shares only grow from round to round, so a source that is at its cap stays there
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("cap")
        n, taken, free = per.agg(F.count_if(over), F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not free:
            break
        level, capped = (share * total - taken) / free, n
    target = F.least(F.col("cap"), F.col("weight") * level)
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def draw_bin(doc_id: Column, seed: str = SEED) -> Column:
    """The hash of seed and doc_id in [0, BINS)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.floor(F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48)) * BINS).cast("int")


def _thresholds(spark: SparkSession, binned: DataFrame, **options) -> DataFrame:
    """(source, source_size, target, base, below) from rows of (source, bin, size).

    ``base`` is floor(rate); documents of bins under ``below`` get one copy more. The window
    has BINS rows of a source at most.
    """
    summed = stage(spark, binned.groupBy("source", "bin").agg(F.sum("size").alias("size")), "mix-bins")
    targets = stage(spark, source_targets(spark, summed, **options), "mix-targets")
    targets = targets.withColumn("base", F.floor("rate"))
    targets = targets.withColumn("need", F.col("target") - F.col("base") * F.col("source_size"))
    running = F.sum("size").over(Window.partitionBy("source").orderBy("bin"))
    steps = _with_targets(summed.withColumn("got", running), targets.select("source", "need")).where("need > 0")
    nearest = steps.groupBy("source").agg(F.min(F.struct(F.abs(F.col("got") - F.col("need")).alias("off"), "bin", "need")).alias("x"))
    below = nearest.select(F.col("source").alias("__own"), F.when(F.col("x.off") < F.col("x.need"), F.col("x.bin") + 1).otherwise(0).alias("below"))
    found = targets.join(below, F.col("source").eqNullSafe(F.col("__own")), "left")
    return stage(spark, found.select("source", "source_size", "target", "base", F.coalesce("below", F.lit(0)).alias("below")), "mix-thresholds")


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    side = targets.withColumnRenamed("source", "__source")
    if targets.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    return rows.join(side, F.col("source").eqNullSafe(F.col("__source")), "inner").drop("__source")


def mixing_plan(spark: SparkSession, df: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (= size * copies) of every row.

    Null texts and texts without words have size 0. Null is a source of its own. Repeated
    rows with one doc_id draw alike. An empty table gives an empty table. A source's taken
    words differ from its target by half of the words in one step of the draw, a document
    in most sources.
    """
    seed = options.pop("seed", SEED)
    sizes = df.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw_bin(F.col("doc_id"), seed).alias("bin"))
    sizes = stage(spark, sizes, "mix-sizes")
    planned = _with_targets(sizes, _thresholds(spark, sizes, **options)).withColumn("copies", _copies())
    return planned.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _copies() -> Column:
    return (F.col("base") + (F.col("bin") < F.col("below")).cast("long")).cast("long")


def mix_documents(spark: SparkSession, df: DataFrame, **options) -> DataFrame:
    """The rows of ``df``, each as many times as the mix takes it; columns as they were.

    The draw needs only the row's id and its source's threshold, so texts aren't shuffled.
    """
    seed = options.pop("seed", SEED)
    columns = df.columns
    names = {c: f"__own_{i}" for i, c in enumerate(columns)}
    rows = df.withColumnsRenamed(names)
    rows = rows.withColumns({"source": F.col(names["source"]), "bin": draw_bin(F.col(names["doc_id"]), seed)})
    limits = _thresholds(spark, rows.select("source", "bin", word_count(F.col(names["text"])).alias("size")), **options)
    mixed = _with_targets(rows, limits).withColumn("copy", F.explode(F.array_repeat(F.lit(True), _copies().cast("int"))))
    return mixed.select(*[F.col(names[c]).alias(c) for c in columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, size, source_size, target, taken (and copies)."""
    return mixing_plan(spark, read_table(spark, sf_dir, "documents"))


OP4_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight,
         sum(size)::BIGINT * 2.0::DOUBLE AS cap
  FROM sizes GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM per)
             - coalesce((SELECT sum(b.cap) FROM per b WHERE b.cap / b.weight < a.cap / a.weight), 0))
            / (SELECT sum(b.weight) FROM per b WHERE b.cap / b.weight >= a.cap / a.weight) AS level
  FROM per a),
targets AS (
  SELECT source, source_size,
         least(cap, coalesce(weight * (SELECT max(level) FROM levels WHERE level <= cap / weight), cap)) AS target
  FROM levels),
rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base,
         target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size AS need
  FROM targets),
drawn AS (
  SELECT doc_id, source, size,
         floor(('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE / {2**48}::DOUBLE * {BINS})::INT AS bin
  FROM sizes),
bins AS (SELECT source, bin, sum(size)::BIGINT AS size FROM drawn GROUP BY source, bin),
steps AS (SELECT source, bin, sum(size) OVER (PARTITION BY source ORDER BY bin)::BIGINT AS got FROM bins),
nearest AS (
  SELECT s.source, s.bin, abs(got - need) AS off, need
  FROM steps s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
  WHERE need > 0
  QUALIFY row_number() OVER (PARTITION BY s.source ORDER BY abs(got - need), bin) = 1)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM (
  SELECT d.doc_id, d.size, r.source_size, r.target,
         r.base::BIGINT + (n.bin IS NOT NULL AND n.off < n.need AND d.bin <= n.bin)::BIGINT AS copies
  FROM drawn d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
  LEFT JOIN nearest n ON d.source IS NOT DISTINCT FROM n.source) x
"""
