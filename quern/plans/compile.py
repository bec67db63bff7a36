"""From a query tree to a DataFrame of matches (doc_id, score), deleted documents included."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.literals import double_sql, text_sql
from quern.functions.scoring import idf, query_norm
from quern.plans.query import MUST, MUST_NOT, SHOULD, Boolean, Clause, ConstantScore, MatchAll, MultiTerm, NumericRange, Phrase, Prefix, Query, Term, TermRange, UnsupportedQuery
from quern.plans.rewrite import term_predicate, unscored
from quern.sources.index import SearchIndex

#: A set of document or term keys is broadcast up to this many rows, else left to a shuffled join.
BROADCAST_ROWS = 1_000_000
#: Terms of a pattern up to this number are a filter of the scan.
PUSHED_TERMS = 1_000


def _terms_of(query: Query) -> set[tuple[str, str]]:
    if isinstance(query, Term):
        return {(query.field, query.text)}
    if isinstance(query, Phrase):
        return {(query.field, t) for t in query.terms}
    if isinstance(query, Boolean):
        return set().union(*[_terms_of(c.query) for c in query.clauses], set())
    if isinstance(query, ConstantScore):
        return _terms_of(query.query)
    return set()


@dataclass
class Compiler:
    """A query over an index, with the document frequencies of its own terms."""

    index: SearchIndex
    doc_freq: dict[tuple[str, str], int]

    @staticmethod
    def of(index: SearchIndex, *queries: Query) -> Compiler:
        index = index.counted()
        return Compiler(index, index.doc_freqs(set().union(*[_terms_of(q) for q in queries], set())))

    # -- weights

    def _idf(self, query: Term | Phrase) -> float:
        texts = (query.text,) if isinstance(query, Term) else query.terms
        return sum(idf(self.doc_freq.get((query.field, t), 0), self.index.n_docs) for t in texts)

    def _squares(self, query: Query) -> float:
        if isinstance(query, (Term, Phrase)):
            return (self._idf(query) * query.boost) ** 2
        if isinstance(query, Boolean):
            return sum(self._squares(c.query) for c in query.clauses if c.occur != MUST_NOT) * query.boost**2
        return query.boost**2

    # -- matches

    def matches(self, query: Query) -> DataFrame:
        if isinstance(query, ConstantScore):
            return self._set(query.query).withColumn("score", F.lit(float(query.boost)))
        if isinstance(query, (MultiTerm, NumericRange, MatchAll)):
            return self._set(query).withColumn("score", F.lit(float(query.boost)))
        return self._scored(query, query_norm(self._squares(query)))

    def _empty(self) -> DataFrame:
        return self.index.docs.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))

    def _postings(self, name: str, texts: list[str]) -> DataFrame:
        return self.index.postings.where(f"field = {text_sql(name)} AND term IN ({', '.join(text_sql(t) for t in sorted(set(texts)))})")

    def _scored(self, query: Query, factor: float) -> DataFrame:
        """``factor``: the query norm times the boosts of what encloses the query."""
        if isinstance(query, Term):
            weight = self._idf(query) ** 2 * query.boost * factor
            tf = "1D" if query.docs_only else "sqrt(tf)"
            return self._postings(query.field, [query.text]).selectExpr("doc_id", f"{tf} * {double_sql(weight)} * norm AS score")
        if isinstance(query, Phrase):
            weight = self._idf(query) ** 2 * query.boost * factor
            return self._phrase(query).selectExpr("doc_id", f"sqrt(freq) * {double_sql(weight)} * norm AS score")
        if isinstance(query, Boolean):
            return self._boolean(query, factor * query.boost)
        if isinstance(query, ConstantScore):
            return self._set(query.query).withColumn("score", F.lit(query.boost * factor))
        return self._set(query).withColumn("score", F.lit(query.boost * factor))

    def _boolean(self, query: Boolean, factor: float) -> DataFrame:
        clauses = query.clauses
        if not any(c.occur != MUST_NOT for c in clauses):
            return self._empty()
        required = [c for c in clauses if c.occur == MUST]
        if any(isinstance(c.query, Term) and not self.doc_freq.get((c.query.field, c.query.text)) for c in required):
            return self._empty()
        most = sum(c.occur != MUST_NOT for c in clauses)
        terms = [(n, c) for n, c in enumerate(clauses) if isinstance(c.query, Term)]
        parts = []
        by_field: dict[str, list] = {}
        for n, c in terms:
            by_field.setdefault(c.query.field, []).append((n, c))
        for name, group in by_field.items():
            parts.append(self._term_clauses(name, group, factor))
        for c in clauses:
            if not isinstance(c.query, Term):
                rows = self._set(c.query).withColumn("score", F.lit(0.0)) if c.occur == MUST_NOT else self._scored(c.query, factor)
                parts.append(rows.select("doc_id", "score", F.lit(c.occur).alias("occur")))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        summed = rows.groupBy("doc_id").agg(
            F.expr(f"sum(CASE WHEN occur <> '{MUST_NOT}' THEN score ELSE 0D END) AS total"),
            *[F.expr(f"count_if(occur = '{occur}') AS {name}") for occur, name in ((MUST, "must"), (SHOULD, "should"), (MUST_NOT, "prohibited"))],
        )
        held = summed.where(f"must = {len(required)} AND prohibited = 0 AND must + should > 0 AND should >= {int(query.min_should_match)}")
        coord = "1D" if query.disable_coord or most == 1 else f"((must + should) / {double_sql(most)})"
        return held.selectExpr("doc_id", f"total * {coord} AS score")

    @staticmethod
    def batchable(query: Query) -> bool:
        """Scored terms and Booleans of terms: these share one scan."""
        return isinstance(query, Term) or (isinstance(query, Boolean) and bool(query.clauses) and all(isinstance(c.query, Term) for c in query.clauses))

    def batch(self, queries: list[Query]) -> DataFrame:
        """(query_no, doc_id, score) of batchable queries: one scan of the postings and one aggregation for all of them.

        The clauses and what each query requires are tables of one row per clause and query of the request.
        """
        spark = self.index.postings.sparkSession
        clauses, asked = [], []
        for number, query in enumerate(queries):
            own = Boolean((Clause(MUST, query),)) if isinstance(query, Term) else query
            factor = query_norm(self._squares(own)) * own.boost
            most = sum(c.occur != MUST_NOT for c in own.clauses)
            asked.append((number, sum(c.occur == MUST for c in own.clauses), own.min_should_match, 1.0 if own.disable_coord or most == 1 else float(most), own.disable_coord or most == 1))
            for c in own.clauses:
                weight = 0.0 if c.occur == MUST_NOT else self._idf(c.query) ** 2 * c.query.boost * factor
                if self.doc_freq.get((c.query.field, c.query.text)):
                    clauses.append((c.query.field, c.query.text, number, c.occur, weight, c.query.docs_only))
        side = spark.createDataFrame(clauses, "field string, term string, query_no int, occur string, weight double, docs_only boolean")
        held = spark.createDataFrame(asked, "query_no int, required int, least int, most double, flat boolean")
        wanted = self.index.postings.where(F.col("field").isin(sorted({c[0] for c in clauses})) & F.col("term").isin(sorted({c[1] for c in clauses})))
        tf = F.when(F.col("docs_only"), 1.0).otherwise(F.sqrt("tf"))
        rows = wanted.join(F.broadcast(side), ["field", "term"]).select("query_no", "doc_id", "occur", (tf * F.col("weight") * F.col("norm")).alias("score"))
        count = lambda occur: F.sum(F.when(F.col("occur") == occur, 1).otherwise(0))
        summed = rows.groupBy("query_no", "doc_id").agg(F.sum("score").alias("total"), count(MUST).alias("must"), count(SHOULD).alias("should"), count(MUST_NOT).alias("prohibited"))
        matched = F.col("must") + F.col("should")
        kept = summed.join(F.broadcast(held), "query_no").where((F.col("must") == F.col("required")) & (F.col("prohibited") == 0) & (matched > 0) & (F.col("should") >= F.col("least")))
        return kept.select("query_no", "doc_id", (F.col("total") * F.when(F.col("flat"), 1.0).otherwise(matched / F.col("most"))).alias("score"))

    def _term_clauses(self, name: str, group: list, factor: float) -> DataFrame:
        """A row per clause and document that holds its term: one scan of the postings for all clauses of a field."""
        by_term: dict[str, list[str]] = {}
        for _, c in group:
            q = c.query
            if not self.doc_freq.get((q.field, q.text)):
                continue  # no such term: nothing to scan
            weight = 0.0 if c.occur == MUST_NOT else self._idf(q) ** 2 * q.boost * factor
            by_term.setdefault(q.text, []).append(f"named_struct('weight', {double_sql(weight)}, 'occur', '{c.occur}', 'docs_only', {str(q.docs_only).lower()})")
        if not by_term:
            return self._empty().withColumn("occur", F.lit(SHOULD))
        # a literal map, so that a union of many terms is a lookup and not a chain of branches
        single = all(len(entries) == 1 for entries in by_term.values())
        clauses = ", ".join(f"{text_sql(text)}, {entries[0] if single else 'array(' + ', '.join(entries) + ')'}" for text, entries in by_term.items())
        clauses = f"element_at(map({clauses}), term)"
        rows = self._postings(name, list(by_term)).selectExpr("doc_id", "tf", "norm", f"{clauses if single else f'explode({clauses})'} AS x")
        tf = "tf" if not any(c.query.docs_only for _, c in group) else "CASE WHEN x.docs_only THEN 1 ELSE tf END"
        return rows.selectExpr("doc_id", f"sqrt({tf}) * x.weight * norm AS score", "x.occur AS occur")

    def _phrase(self, query: Phrase) -> DataFrame:
        """(doc_id, freq, norm): a document's positions meet in one row; starts are an intersection of arrays."""
        offsets = query.offsets()
        if not query.terms or any(not self.doc_freq.get((query.field, t)) for t in query.terms):
            return self._empty().select("doc_id", F.lit(0).alias("freq"), F.lit(0.0).alias("norm"))
        if query.slop:
            return self._sloppy(query)
        distinct = sorted(set(query.terms))
        rows = self._held(query.field, distinct)
        starts = None
        for text, offset in zip(query.terms, offsets):
            moved = f"transform(at[{text_sql(text)}], p -> p - {int(offset)})"
            starts = moved if starts is None else f"array_intersect({starts}, {moved})"
        return rows.selectExpr("doc_id", f"size(filter(array_distinct({starts}), p -> p >= 0)) AS freq", "norm").where("freq > 0")

    def _held(self, name: str, distinct: list[str]) -> DataFrame:
        """(doc_id, at, norm) of the documents that hold all terms, ``at`` mapping a term to its positions."""
        rows = self._postings(name, distinct).groupBy("doc_id").agg(F.expr("map_from_entries(collect_list(struct(term, positions))) AS at"), F.expr("max(norm) AS norm"))
        return rows.where(f"size(at) = {len(distinct)}")

    def _sloppy(self, query: Phrase) -> DataFrame:
        """Every start of the first term counts 1/(1 + moves), moves being the sum over the other terms of the
        distance to their nearest place; starts with more than ``slop`` moves don't count."""
        offsets = query.offsets()
        distinct = sorted(set(query.terms))
        rows = self._held(query.field, distinct)
        moves = F.transform(F.col("at")[query.terms[0]], lambda p: self._moves(p, query, offsets))
        freq = F.aggregate(moves, F.lit(0.0), lambda a, m: a + F.when(m <= query.slop, 1.0 / (1.0 + m)).otherwise(0.0))
        return rows.select("doc_id", "norm", freq.alias("freq")).where("freq > 0").select("doc_id", "freq", "norm")

    @staticmethod
    def _moves(p: Column, query: Phrase, offsets: tuple[int, ...]) -> Column:
        total = F.lit(0)
        for text, offset in list(zip(query.terms, offsets))[1:]:
            total = total + F.array_min(F.transform(F.col("at")[text], _distance(p, offset - offsets[0])))
        return total

    def _set(self, query: Query) -> DataFrame:
        """Distinct doc_id, no scores: frequencies and norms aren't read."""
        if isinstance(query, Term):
            return self._postings(query.field, [query.text]).select("doc_id")
        if isinstance(query, Phrase):
            return self._phrase(query).select("doc_id")
        if isinstance(query, MatchAll):
            return self.index.docs.select("doc_id").distinct()
        if isinstance(query, NumericRange):
            return self._numeric(query)
        if isinstance(query, (Prefix, TermRange)):
            rows = self.index.postings.where((F.col("field") == query.field) & term_predicate(query, F.col("term")))
            return rows.select("doc_id").distinct()
        if isinstance(query, MultiTerm):
            # patterns run over the vocabulary, not over every posting
            terms = self.index.term_stats.where((F.col("field") == query.field) & term_predicate(query, F.col("term"))).select("term")
            few = [r.term for r in terms.limit(PUSHED_TERMS + 1).collect()]
            if len(few) <= PUSHED_TERMS:  # the scan is pruned to them
                return self._postings(query.field, few).select("doc_id").distinct() if few else self._empty().select("doc_id")
            if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
                terms = F.broadcast(terms)
            rows = self.index.postings.where(F.col("field") == query.field).join(terms, "term", "left_semi")
            return rows.select("doc_id").distinct()
        if isinstance(query, ConstantScore):
            return self._set(query.query)
        if isinstance(query, Boolean):
            return self._boolean(unscored(query), 0.0).select("doc_id")
        raise UnsupportedQuery(f"unknown query: {query}")

    def _numeric(self, query: NumericRange) -> DataFrame:
        out = F.col(query.column).isNotNull()
        if query.low is not None:
            out = out & (F.col(query.column) >= query.low if query.include_low else F.col(query.column) > query.low)
        if query.high is not None:
            out = out & (F.col(query.column) <= query.high if query.include_high else F.col(query.column) < query.high)
        return self.index.docs.where(out).select("doc_id")


def _distance(start: Column, offset: int):
    return lambda x: F.abs(x - offset - start)
