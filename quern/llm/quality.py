"""Quality rules under weak supervision, in DataFrame and SQL functions only.

Each rule votes good (1), bad (-1) or abstains (0) on counts taken from the whole text. The
votes of a document are one of at most 3^6 patterns; patterns are counted over all
documents, and expectation-maximisation over that one bounded row of counts estimates the
accuracy of each rule where it votes, classes balanced and abstention uninformative. The
posterior probability of "good" of a document's pattern decides, instead of all rules
having to pass. A document on which every rule abstains stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import SPACE_CLASS, let, read_table, stage

MIN_WORDS = 50
ITERATIONS = 25
THRESHOLD = 0.5
#: Accuracy that each rule starts with, and its weight as a share of all documents.
START_ACCURACY = 0.9
PRIOR_SHARE = 0.02

_WS = " \t\n\x0b\x0c\r"


def _bad(when: Column) -> Column:
    return F.when(when, -1).otherwise(0)


def rules() -> list[tuple[str, Column]]:
    """Name and vote of each rule over the counts of ``features``."""
    c, n = F.col, F.greatest(F.col("n_words"), F.lit(1))
    plain = (c("n_symbols") < 0.1 * n) & (c("n_repeat_words") < 0.25 * n) & (c("n_caps") < 0.15 * n)
    return [
        ("length", _bad(c("n_words") < MIN_WORDS)),
        ("symbols", _bad(c("n_symbols") > 0.2 * n)),
        ("repetition", _bad(c("n_repeat_words") > 0.35 * n)),
        ("lines", _bad((c("n_dup_lines") >= 3) & (c("n_dup_lines") > 0.3 * c("n_lines")))),
        ("capitals", _bad(c("n_caps") > 0.4 * n)),
        ("prose", F.when(plain & (c("word_chars") >= 3 * n) & (c("word_chars") <= 10 * n), 1).when(c("word_chars") > 14 * n, -1).otherwise(0)),
    ]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the text."""
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(starts: Column) -> Column:
        # each repeated window adds what the one before doesn't cover, 3 words at most
        steps = F.transform(starts, lambda s, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), s - starts[j - 1])))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(hashes: Column) -> Column:
        def starts(ranked: Column) -> Column:
            # get() gives null beyond the ends, which equals nothing
            twice = F.filter(
                ranked,
                lambda x, j: F.coalesce(F.get(ranked, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ranked, j + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(let(ranked, starts), covered))

    return F.when(n < 3, 0).otherwise(let(windows, repeated))


def features(df: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """keep columns and the counts of every row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_caps."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def count(text: Column) -> Column:
        def of_words(words: Column) -> Column:
            n = F.when(words[0] == "", 0).otherwise(F.size(words))
            return F.struct(
                n.alias("n_words"),
                F.length(F.array_join(words, "")).alias("word_chars"),
                _repeat_words(words, n).alias("n_repeat_words"),
            )

        def of_lines(lines: Column) -> Column:
            return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

        words = F.split(F.btrim(text, F.lit(_WS)), f"{SPACE_CLASS}+")
        lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_WS)) != "")
        return F.struct(
            let(words, of_words).alias("w"),
            let(lines, of_lines).alias("l"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
            F.regexp_count(text, F.lit(r"[A-Z][A-Z]+")).alias("n_caps"),
        )

    counted = df.select(*keep, count(text).alias("c"))
    long = lambda name, at: F.col(f"c.{at}").cast("long").alias(name)
    return counted.select(
        *keep,
        long("n_words", "w.n_words"),
        long("word_chars", "w.word_chars"),
        long("n_symbols", "n_symbols"),
        long("n_dup_lines", "l.n_dup_lines"),
        long("n_repeat_words", "w.n_repeat_words"),
        long("n_lines", "l.n_lines"),
        long("n_caps", "n_caps"),
    )


def _fit_sql(n_rules: int, iterations: int) -> str:
    """Posterior of "good" for each pattern, from the array ``ps`` of (code, v, n) in one row; ``s`` holds the accuracies."""
    rules_at = f"sequence(0, {n_rules - 1})"
    odds = f"aggregate({rules_at}, 0D, (a, k) -> a + p.v[k] * ln(s[k] / (1 - s[k])))"
    weigh = f"transform(ps, p -> named_struct('code', p.code, 'v', p.v, 'n', p.n, 'g', 1 / (1 + exp(-({odds})))))"
    right = "aggregate(qs, 0D, (a, p) -> a + if(p.v[k] = 1, p.g, if(p.v[k] = -1, 1 - p.g, 0D)) * p.n)"
    voted = "aggregate(qs, 0D, (a, p) -> a + if(p.v[k] = 0, 0D, p.n))"
    prior = f"({PRIOR_SHARE}D * total)"
    accuracy = f"greatest(0.05D, least(0.995D, ({prior} * {START_ACCURACY}D + {right}) / ({prior} + {voted})))"
    step = f"element_at(transform(array({weigh}), qs -> transform({rules_at}, k -> {accuracy})), 1)"
    fitted = f"aggregate(sequence(1, {iterations}), array_repeat({START_ACCURACY}D, {n_rules}), (s, it) -> {step})"
    return f"element_at(transform(array({fitted}), s -> transform({weigh}, q -> named_struct('code', q.code, 'quality', q.g))), 1)"


def pattern_quality(counts: DataFrame, n_rules: int, iterations: int = ITERATIONS) -> DataFrame:
    """(code, quality), at most 3^n_rules rows, from rows of (code, n): EM in one expression over one row."""
    votes = F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), lambda k: (F.pmod(F.floor(F.col("code") / F.pow(F.lit(3.0), k)), F.lit(3)) - 1).cast("int"))
    one = counts.select(F.struct("code", votes.alias("v"), F.col("n").cast("double").alias("n")).alias("p")).agg(
        F.sort_array(F.collect_list("p")).alias("ps"), F.sum("p.n").alias("total")
    )
    return one.select(F.explode(F.expr(_fit_sql(n_rules, iterations))).alias("q")).select("q.code", "q.quality")


def _code() -> Column:
    """The votes of the rules as one number, base 3."""
    return sum(((vote + 1) * F.lit(3**k) for k, (_, vote) in enumerate(rules())), F.lit(0)).cast("int")


def _weighed(counted: DataFrame) -> DataFrame:
    """``counted`` (staged) with base_failed, quality and kept, from its counts and code."""
    quality = pattern_quality(counted.groupBy("code").agg(F.count(F.lit(1)).alias("n")), len(rules()))
    # a bounded table: 3^6 rows at most
    out = counted.join(F.broadcast(quality), "code", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumns({"base_failed": failed, "kept": ~failed & (F.col("quality") >= THRESHOLD)})


def score(spark: SparkSession, df: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """keep columns, the counts, the votes' code, base_failed, quality and kept of every row.

    Null texts, empty texts and texts of white space have no words and fail the base rule.
    Repeated rows get equal results. An empty table gives an empty table. A ``keep`` column
    named like one that is added is replaced by it.
    """
    rows = df.select(*[F.col(c).alias(f"__own_{c}") for c in keep], F.col(text_col).alias("__text"))
    counted = features(rows, "__text", *[f"__own_{c}" for c in keep]).withColumn("code", _code())
    judged = _weighed(stage(spark, counted, "quality"))
    own = [F.col(f"__own_{c}").alias(c) for c in keep if c not in judged.columns]
    return judged.select(*own, *[c for c in judged.columns if not c.startswith("__own_")])


def keep_good(spark: SparkSession, df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules keep, columns as they were.

    Texts are counted once: rows are written with their code, and the decision, a function of
    the code and the base rule, is taken there, so rows aren't joined by id and repeated ids
    do no harm.
    """
    columns = df.columns
    names = {c: f"__own_{i}" for i, c in enumerate(columns)}
    counted = features(df.withColumnsRenamed(names), names[text_col], *names.values()).withColumn("code", _code())
    judged = _weighed(stage(spark, counted.select(*names.values(), "n_words", "n_repeat_words", "code"), "quality"))
    return judged.where("kept").select(*[F.col(names[c]).alias(c) for c in columns])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, the five counts, base_failed, kept, and the quality."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(spark, docs, "doc_id").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality")
    )
