"""Personal data: patterns, and information-theoretic sanitisation; DataFrame and SQL functions only.

Patterns find the protected entities (e-mail, ip, card, phone). Words of its text may
give it away even when it is masked. How strongly a term reveals an entity is estimated
over all distinct texts: those that hold both against those that hold the term at all,
``P(entity | term)``, and the pointwise mutual information in bits. Terms beyond both
thresholds, seen with enough different contexts of the entity, are spans of kind ``term``
wherever they stand in a text with that entity, and are removed with it. Copies of a text
count once on both sides. Each text gives an entity one context (the least by hash of those
it has), so that neither one text nor copies of one passage are enough by themselves.

Positions come from ``split`` and ``regexp_extract_all`` with one pattern: the running sum
of the lengths of pieces and matches. The patterns use possessive repeats and a look-behind
(``\\G`` where a match may start inside a run), which find what the plain ones find,
leftmost and greedy, in time linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import SPACE_CLASS, WORD_CLASS, ascii_lower, let, read_table, stage

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_VALID = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: Characters on each side of an entity that tell its contexts apart.
CONTEXT_CHARS = 100
MIN_CONTEXTS = 3
MIN_CONDITIONAL = 0.5
MIN_BITS = 3.0
#: Candidate terms, and texts that hold entities, are broadcast up to this many rows; more meet the words in a shuffled join.
BROADCAST_TERMS = 100_000
#: So are the hashes of texts that have copies, of 16 bytes a row.
BROADCAST_COPIED = 1_000_000
_CHUNK = 256
SPAN = "array<struct<kind:string,s:int,e:int,v:string>>"


def running_sum(values: Column) -> Column:
    """Inclusive running sums of an int array, in chunks, so that no long array is copied per element."""
    empty = F.expr("cast(array() as array<int>)")

    def sums(chunk: Column, base: Column) -> Column:
        return F.aggregate(chunk, empty, lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), base) + x)))

    def chunked(v: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int"))
        chunks = F.transform(firsts, lambda i: F.slice(v, i * _CHUNK + 1, _CHUNK))

        def joined(parts: Column) -> Column:
            totals = F.transform(parts, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
            return let(
                sums(totals, F.lit(0)),
                lambda ends: F.flatten(F.transform(parts, lambda c, i: sums(c, F.when(i == 0, 0).otherwise(F.coalesce(F.get(ends, i - 1), F.lit(0)))))),
            )

        return let(chunks, joined)

    return F.when(F.size(values) == 0, empty).otherwise(let(values, chunked))


def located(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost, non-overlapping matches as structs kind, s, e (code points, end exclusive), v."""

    def spans(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        ends = running_sum(let(pieces, lambda ps: F.transform(found, lambda m, i: F.length(ps[i]) + F.length(m))))
        placed = let(ends, lambda es: F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), (es[i] - F.length(m)).alias("s"), es[i].alias("e"), m.alias("v"))))
        return F.when(F.size(found) == 0, F.expr(f"cast(array() as {SPAN})")).otherwise(placed)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _luhn(digits: Column) -> Column:
    def weighed(i: Column) -> Column:
        d = F.substring(digits, -1 - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + weighed(i))
    return total % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Spans of the four patterns, by kind as listed, then start; ``text`` must not be null."""
    none = F.expr(f"cast(array() as {SPAN})")
    email = F.when(F.contains(text, F.lit("@")), located(text, PATTERNS["email"], "email")).otherwise(none)
    ip = F.filter(located(text, PATTERNS["ip"], "ip"), lambda x: x["v"].rlike(IP_VALID))
    # only matches of 16 digits or more need places, but a match may not be retried: all are located
    card = F.when(
        text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        F.filter(
            located(text, PATTERNS["card"], "card"),
            lambda x: let(_digits(x["v"]), lambda d: F.length(d).between(16, 19) & F.when(F.length(d) <= 19, _luhn(d)).otherwise(False)),
        ),
    ).otherwise(none)
    phone = F.when(
        F.contains(text, F.lit("+")),
        F.filter(located(text, PATTERNS["phone"], "phone"), lambda x: F.length(_digits(x["v"])).between(8, 15)),
    ).otherwise(none)
    return F.concat(email, ip, card, phone)


def _context(text: Column, span: Column) -> Column:
    """Entity and hash of its context."""
    left_at = F.greatest(F.lit(0), span["s"] - CONTEXT_CHARS)
    left = F.substring(text, left_at + 1, span["s"] - left_at)
    right = F.substring(text, span["e"] + 1, F.lit(CONTEXT_CHARS))
    return F.struct(F.concat_ws(":", span["kind"], span["v"]).alias("entity"), F.xxhash64(left, right).alias("context"))


def _term(word: Column) -> Column:
    return ascii_lower(F.regexp_replace(word, r"^[^\p{L}]+|[^\p{L}]+$", ""))


def _is_term(term: Column) -> Column:
    return term.rlike(r"\p{L}{2}") & ~term.rlike("[0-9@]")


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    words = F.array_distinct(F.split(text, f"{SPACE_CLASS}+"))
    return F.array_distinct(F.filter(F.transform(words, _term), _is_term))


def _side(few: DataFrame, bound: int = BROADCAST_TERMS) -> DataFrame:
    """``few`` (staged), broadcast if it has no more rows than ``bound``."""
    return F.broadcast(few) if few.count() <= bound else few


def disclosing_terms(spark: SparkSession, texts: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, term, contexts, conditional, bits) beyond the thresholds.

    ``texts`` has rows of (doc, text), ``entities`` of (doc, entity, context) with one row for each
    entity of a doc. A doc is a distinct text, so copies count once wherever docs are counted: those
    that hold the term and the entity, the term, the entity, and all.
    """
    empty = "entity string, term string, contexts long, conditional double, bits double"
    # a term has no more contexts of an entity than the entity has: others are left out before words are met
    often = entities.select("entity", "context").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_CONTEXTS)
    often = stage(spark, entities.join(often.select("entity"), "entity", "left_semi"), "pii-often")
    docs = stage(spark, often.select("doc").distinct(), "pii-docs")
    if docs.isEmpty():
        return spark.createDataFrame([], empty)
    words = texts.join(_side(docs), "doc", "left_semi").select("doc", F.explode(_terms(F.col("text"))).alias("term")).distinct()
    pairs = words.join(often, "doc").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together"), F.count_distinct("context").alias("contexts"))
    pairs = stage(spark, pairs.where(F.col("contexts") >= MIN_CONTEXTS), "pii-pairs")
    terms = stage(spark, pairs.select("term").distinct(), "pii-terms")
    if terms.isEmpty():
        return spark.createDataFrame([], empty)
    # all copies of a text hold the same terms: of the rows with m copies that hold a term, each m are one doc
    counted = stage(spark, texts.groupBy("doc").agg(F.count(F.lit(1)).alias("m")), "pii-counted")
    copied = _side(counted.where("m > 1"), BROADCAST_COPIED)
    rows = texts.join(copied, "doc", "left").select(F.coalesce("m", F.lit(1)).alias("m"), F.explode(_terms(F.col("text"))).alias("term"))
    held = rows.join(_side(terms), "term", "left_semi").groupBy("term", "m").agg(F.count(F.lit(1)).alias("n"))
    holding = held.groupBy("term").agg(F.sum(F.expr("n div m")).alias("documents"))
    n_docs = counted.count()
    per_entity = often.groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity"))
    rated = pairs.join(holding, "term").join(per_entity, "entity")
    conditional = F.col("together") / F.col("documents")
    bits = F.log2(F.lit(float(n_docs)) * F.col("together") / (F.col("documents") * F.col("of_entity")))
    rated = rated.select("entity", "term", "contexts", conditional.alias("conditional"), bits.alias("bits"))
    return rated.where((F.col("conditional") >= MIN_CONDITIONAL) & (F.col("bits") >= MIN_BITS))


def find_pii(spark: SparkSession, df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: doc_id, row_no, base and added, arrays of spans.

    Null texts count as empty and have no spans. Repeated rows get equal spans. An empty
    table gives an empty table. Other columns of ``df`` are not looked at.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base, marked = _found(spark, rows)
    out, none = base.drop("near"), F.expr(f"cast(array() as {SPAN})")
    if marked is None:
        return out.drop("doc").withColumn("added", none)
    return out.join(_side(marked), "doc", "left").drop("doc").withColumn("added", F.coalesce("added", none))


def _found(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of rows of (doc_id, text): base (doc_id, row_no, doc, base, near), and (doc, added) of texts with disclosing terms, if any."""
    texts = rows.select(F.xxhash64("text").alias("doc"), "text")
    found = rows.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    near = F.transform("base", lambda x: _context(F.col("text"), x))
    near = F.when(F.size("base") > 0, near)
    base = found.select("doc_id", F.monotonically_increasing_id().alias("row_no"), F.xxhash64("text").alias("doc"), "base", near.alias("near"))
    base = stage(spark, base, "pii-base")
    entities = base.where("near is not null").select("doc", F.explode("near").alias("x")).groupBy("doc", "x.entity").agg(F.min("x.context").alias("context"))
    entities = stage(spark, entities, "pii-entities")
    disclosed = stage(spark, disclosing_terms(spark, texts, entities), "pii-disclosed")
    if disclosed.isEmpty():
        return base, None
    told = stage(spark, entities.join(disclosed, "entity").groupBy("doc").agg(F.collect_set("term").alias("terms")), "pii-told")
    word = lambda w: F.struct(w["kind"].alias("kind"), w["s"].alias("s"), w["e"].alias("e"), _term(w["v"]).alias("v"))
    placed = F.filter(F.transform(located(F.col("text"), WORD_CLASS, "term"), word), lambda w: F.array_contains(F.col("terms"), w["v"]))
    marked = texts.join(_side(told), "doc").select("doc", placed.alias("added")).groupBy("doc").agg(F.first("added").alias("added"))
    return base, stage(spark, marked, "pii-marked")


def sanitise(spark: SparkSession, df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` with every span of their texts generalised to its kind (``<email>``, ``<term>``), other columns as they were.

    Null texts stay null. Repeated rows get equal texts; an empty table gives an empty table.
    """
    columns = df.columns
    names = {c: f"__own_{i}" for i, c in enumerate(columns)}
    _, marked = _found(spark, df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    text = F.col(names[text_col])
    rows = df.withColumnsRenamed(names)
    spans = base_spans(F.coalesce(text, F.lit("")))
    if marked is not None:
        rows = rows.withColumn("doc", F.xxhash64(F.coalesce(text, F.lit("")))).join(_side(marked), "doc", "left")
        spans = F.concat(spans, F.coalesce("added", F.expr(f"cast(array() as {SPAN})")))
    clean = F.when(text.isNotNull(), let(spans, lambda found: F.when(F.size(found) == 0, text).otherwise(redacted(text, found))))
    return rows.select(*[(clean if c == text_col else F.col(names[c])).alias(c) for c in columns])


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    placed = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("to"), x["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        longer = F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit("<"), x["kind"], F.lit(">")).alias("out"), (-x["to"]).alias("at"))
        return F.when(x["s"] < a["at"], a).otherwise(longer)

    return F.aggregate(placed, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, counts by kind, base_sha256, spans."""
    found = find_pii(spark, read_table(spark, sf_dir, "documents"))
    counts = [_count(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.concat("base", "added")).alias("spans"))
