"""Bench: search tasks by frequency band over documents, batches of queries, facets. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.operators.facets import drill_sideways
from quern.operators.search import search, search_many
from quern.plans.query import MUST, MUST_NOT, SHOULD, Boolean, Fuzzy, NumericRange, Prefix, Term, Wildcard
from quern.sources.shared import index_of

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TOP = 100


def bands(index) -> dict[str, list[str]]:
    """Terms of three bands of document frequency: High from 20 % of documents, Med from 2 %, Low below."""
    n = index.n_docs
    rows = index.term_stats.where("field = 'text' and doc_freq > 1").select("term", "doc_freq")
    pick = lambda low, high: [r.term for r in rows.where((F.col("doc_freq") >= low) & (F.col("doc_freq") < high)).orderBy(F.desc("doc_freq"), "term").limit(4).collect()]
    return {"High": pick(0.2 * n, n + 1), "Med": pick(0.02 * n, 0.2 * n), "Low": pick(2, 0.02 * n)}


def tasks(by_band) -> dict:
    t = lambda band, at=0: Term("text", by_band[band][at])
    two = lambda a, x, b, y: Boolean.of((a, x), (b, y))
    out = {f"{b}Term": t(b) for b in ("High", "Med", "Low")}
    for other in ("High", "Med", "Low"):
        o = t(other, 1)
        out[f"AndHigh{other}"] = two(MUST, t("High"), MUST, o)
        out[f"OrHigh{other}"] = two(SHOULD, t("High"), SHOULD, o)
        out[f"OrHighNot{other}"] = two(SHOULD, t("High"), MUST_NOT, o)
        out[f"OrNotHigh{other}"] = two(MUST_NOT, t("High"), SHOULD, o)
    low = by_band["Low"][0]
    return out | {"Fuzzy1": Fuzzy("text", low, 1), "Fuzzy2": Fuzzy("text", low, 2), "Prefix3": Prefix("text", prefix=low[:3]), "Wildcard": Wildcard("text", pattern=low[:2] + "*" + low[-1]), "IntNRQ": NumericRange("n_chars", 500, 2000)}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, run):
        began = time.time()
        run()
        seconds[name] = round(time.time() - began, 3)

    timed("build_index", lambda: index_of(spark, SF_DIR))
    index = index_of(spark, SF_DIR)
    found = tasks(bands(index))
    search(index, found["HighTerm"], TOP).hits.collect()  # warm
    for name, query in found.items():
        timed(name, lambda q=query: search(index, q, TOP).hits.collect())
    timed("batch_all", lambda: search_many(index, found, TOP).collect())
    drills = {"lang": ["en"]}
    timed("drill_sideways", lambda: drill_sideways(index, found["OrHighMed"], drills, [("lang", 10), ("source", 10)], TOP).facets.collect())
    seconds["batch_per_query"] = round(seconds["batch_all"] / len(found), 3)
    single = [v for k, v in seconds.items() if k in found]
    print(json.dumps({"metric": "mean seconds of a search task", "value": round(sum(single) / len(single), 4), "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1].strip("/")}))


if __name__ == "__main__":
    main()
