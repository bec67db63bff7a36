"""The search index: tables made from a DataFrame of documents, kept as Parquet.

``postings``, ``facets`` and ``docs`` are bucketed by document, postings sorted by (field,
term) in each bucket and with the document's length norm. A bucket answers a query by itself: what a Boolean or phrase
needs of a document is in one place, so postings are never shuffled; statistics of row
groups and pages prune a term's scan to what holds it. Frequencies and positions are columns
that a query which doesn't use them never reads.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.analysis import norm
from quern.functions.folding import FOLDED, folded

#: Document frequencies kept on the driver: those of so many of the most frequent terms, and of terms asked for.
FREQUENT = 20_000
#: Bytes of what an index is made from, as its files have them, for each bucket: what a task sorts stays the same size.
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 4_096


@dataclass(frozen=True)
class IndexSpec:
    id_col: str = "doc_id"
    text_fields: tuple[str, ...] = ("text",)
    #: Fields of which a value is one term.
    keyword_fields: tuple[str, ...] = ()
    numeric_fields: tuple[str, ...] = ()
    #: Dimension -> column with a value, a "/"-separated path, or an array of either.
    facets: tuple[tuple[str, str], ...] = ()
    #: Fields without length norm.
    no_norms: tuple[str, ...] = ()


#: Tables dealt by document, with the order inside a bucket, and the others.
_DEALT = {"docs": ("doc_id",), "postings": ("field", "term", "doc_id"), "facets": ("dim", "label", "doc_id")}
_OTHER = ("term_stats", "taxonomy")


@dataclass(frozen=True)
class SearchIndex:
    """docs(doc_id, numeric fields), postings(field, term, doc_id, tf, positions, norm),
    term_stats(field, term, doc_freq, total_term_freq), facets(doc_id, dim, label, depth, at),
    taxonomy(dim, label, depth, ordinal); deletes(doc_id) is a snapshot's own."""

    spec: IndexSpec
    n_docs: int
    docs: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    facets: DataFrame
    taxonomy: DataFrame
    deletes: DataFrame | None = None
    #: What an index that isn't written yet is made from.
    source: DataFrame | None = field(default=None, compare=False, repr=False)
    #: (field, term) -> document frequency, as far as known; None -> whether all terms are.
    known: dict = field(default_factory=dict, compare=False, repr=False)

    @staticmethod
    def build(df: DataFrame, spec: IndexSpec) -> SearchIndex:
        postings = _postings(df, spec)
        facets = _facets(df, spec)
        return SearchIndex(spec, -1, _docs(df, spec), postings, _stats(postings), facets, _taxonomy(facets), source=df)

    def save(self, path: str, buckets: int | None = None) -> None:
        """Write all tables under ``path``; statistics are taken from the written postings.

        One shuffle deals the texts (of an index that was read: its postings) to buckets by
        document; each is split, folded and sorted where it is. An id that is null or repeats
        is refused, since its postings would be those of one document.
        """
        spark = self.docs.sparkSession
        buckets = buckets or _buckets(self.postings if self.source is None else self.source)
        if self.source is not None:
            dealt = self.source.repartition(buckets, F.col(self.spec.id_col).cast("long"))
            made = {"docs": _docs(dealt, self.spec), "postings": _postings(dealt, self.spec), "facets": _facets(dealt, self.spec)}
        else:
            made = {t: getattr(self, t).repartition(buckets, "doc_id") for t in _DEALT}
        for t, order in _DEALT.items():
            name = _table_name(path, t)
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            made[t].write.mode("overwrite").bucketBy(buckets, "doc_id").sortBy(*order).option("path", f"{path}/{t}").format("parquet").saveAsTable(name)
            if t == "docs":
                ids = spark.table(name).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("distinct")).first()
                if ids.distinct != ids.n:
                    raise ValueError("an index needs ids that are not null and don't repeat")
        n_docs = ids.n
        _written(_stats(spark.table(_table_name(path, "postings"))).sortWithinPartitions("field", "term"), f"{path}/term_stats")
        _written(_taxonomy(spark.table(_table_name(path, "facets"))), f"{path}/taxonomy")
        columns = {t: ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema) for t, rows in made.items()}
        about = json.dumps({"n_docs": n_docs, "spec": self.spec.__dict__, "buckets": buckets, "columns": columns})
        _written(spark.createDataFrame([(about,)], "about string").coalesce(1), f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SearchIndex:
        about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
        raw = about["spec"]
        spec = IndexSpec(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in raw.items()})
        dealt = {}
        for t, order in _DEALT.items():
            name = _table_name(path, t)
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({about['columns'][t]}) USING parquet CLUSTERED BY (doc_id) SORTED BY ({', '.join(order)}) "
                f"INTO {about['buckets']} BUCKETS LOCATION '{path}/{t}'"
            )
            spark.catalog.refreshTable(name)
            dealt[t] = spark.table(name)
        return SearchIndex(spec, about["n_docs"], **dealt, **{t: spark.read.parquet(f"{path}/{t}") for t in _OTHER})

    def counted(self) -> SearchIndex:
        """With the number of documents known."""
        return self if self.n_docs >= 0 else replace(self, n_docs=self.docs.count(), known={})

    def with_deletes(self, deletes: DataFrame | None) -> SearchIndex:
        """A later snapshot: documents in ``deletes`` (doc_id) no longer match, statistics still count them."""
        return replace(self, deletes=deletes)

    def live(self, matches: DataFrame) -> DataFrame:
        return matches if self.deletes is None else matches.join(self.deletes.select("doc_id"), "doc_id", "left_anti")

    def doc_freqs(self, terms: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Document frequencies of ``terms``, without those of no document; a job only if one isn't known yet."""
        if self.source is None and not self.known:
            rows = self.term_stats.orderBy(F.desc("doc_freq"), "field", "term").limit(FREQUENT + 1).select("field", "term", "doc_freq").collect()
            self.known[None] = len(rows) <= FREQUENT
            self.known.update({(r.field, r.term): r.doc_freq for r in rows[:FREQUENT]})
        unknown = sorted(t for t in terms if t not in self.known) if not self.known.get(None) else []
        by_field: dict[str, list[str]] = {}
        for name, text in unknown:
            by_field.setdefault(name, []).append(text)
        found: dict = {}
        if unknown:
            asked = F.lit(False)
            for name, texts in by_field.items():
                asked = asked | ((F.col("field") == name) & F.col("term").isin(texts))
            found = {(r.field, r.term): r.doc_freq for r in self.term_stats.where(asked).select("field", "term", "doc_freq").collect()}
            if len(self.known) < 2 * FREQUENT:
                self.known.update({t: found.get(t, 0) for t in unknown})
        return {t: n for t in terms if (n := found.get(t) or self.known.get(t))}


def _buckets(df: DataFrame) -> int:
    """As many as a shuffle has partitions, more where the files of ``df`` are larger; what isn't read from files has no known size."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(size // BUCKET_BYTES, MOST_BUCKETS)) if size < 1 << 50 else least


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _table_name(path: str, table: str) -> str:
    """The session's name of a table under ``path``: bucketing is known to the catalog only."""
    return f"quern_{table}_{hashlib.md5(path.encode()).hexdigest()}"


def _docs(df: DataFrame, spec: IndexSpec) -> DataFrame:
    return df.select(F.col(spec.id_col).cast("long").alias("doc_id"), *[F.col(c) for c in spec.numeric_fields])


def _stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("total_term_freq"))


def _postings(df: DataFrame, spec: IndexSpec) -> DataFrame:
    """A row per document and term: no shuffle, since a text is folded where it is."""
    doc_id = F.col(spec.id_col).cast("long").alias("doc_id")
    parts = []
    for name in spec.text_fields:
        rows = df.select(doc_id, F.lower(F.col(name)).alias("text")).mapInArrow(folded, FOLDED)
        length_norm = F.lit(1.0) if name in spec.no_norms else norm(F.col("length"))
        parts.append(rows.select(F.lit(name).alias("field"), "term", "doc_id", "tf", "positions", length_norm.alias("norm")))
    for name in spec.keyword_fields:
        rows = df.where(F.col(name).isNotNull()).select(
            F.lit(name).alias("field"), F.col(name).cast("string").alias("term"), doc_id, F.lit(1).alias("tf"), F.array(F.lit(0)).alias("positions"), F.lit(1.0).alias("norm")
        )
        parts.append(rows)
    if not parts:
        raise ValueError("an index needs a text or keyword field")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _facets(df: DataFrame, spec: IndexSpec) -> DataFrame:
    """A row per document and category, each prefix of one of its paths; ``at`` is the first place among its paths."""
    doc_id = F.col(spec.id_col).cast("long").alias("doc_id")
    kinds = dict(df.dtypes)
    parts = []
    for place, (dim, column) in enumerate(spec.facets):
        values = F.col(column) if kinds[column].startswith("array") else F.array(F.col(column))

        def prefixes(path, at):
            parted = F.split(path, "/")
            return F.transform(
                F.sequence(F.lit(1), F.size(parted)),
                lambda n: F.struct(F.array_join(F.slice(parted, F.lit(1), n), "/").alias("label"), n.alias("depth"), (at + place * 1_000_000).alias("at")),
            )

        every = F.flatten(F.transform(F.filter(values.cast("array<string>"), lambda x: x.isNotNull()), prefixes))
        rows = df.select(doc_id, every.alias("every")).where(F.size("every") > 0)
        rows = rows.select("doc_id", "every", F.transform("every", lambda x: x["label"]).alias("labels"))
        once = F.filter("every", lambda x, i: F.array_position("labels", x["label"]) == i + 1)
        parts.append(rows.select("doc_id", F.lit(dim).alias("dim"), F.inline(once)))
    if not parts:
        return df.sparkSession.createDataFrame([], "doc_id long, dim string, label string, depth int, at int")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _taxonomy(facets: DataFrame) -> DataFrame:
    """Ordinals by first appearance, parents first: (first document, place in its paths, depth). One row per category."""
    first = facets.groupBy("dim", "label", "depth").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    # a category that appears later has the larger key; ranks in one task aren't needed to compare
    return first.select("dim", "label", "depth", F.struct(F.col("first.doc_id"), F.col("first.at"), F.col("depth")).alias("ordinal"))
