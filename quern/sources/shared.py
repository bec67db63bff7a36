"""Indexes of the driver's tables, built once per session and folder, and kept as Parquet."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.index import IndexSpec, SearchIndex

DOCUMENTS = IndexSpec(text_fields=("text",), keyword_fields=("lang", "source"), numeric_fields=("n_chars",), facets=(("lang", "lang"), ("source", "source")))
PARTS = IndexSpec("p_partkey", ("p_name",), ("p_brand",), ("p_size",), (("category", "category"),))
#: The same without length norms, and with the brand as a dimension of its own.
PARTS_FLAT = IndexSpec("p_partkey", ("p_name",), (), (), (("category", "category"), ("p_brand", "p_brand")), ("p_name",))
EVENTS = IndexSpec("event_id", (), ("event_type",), (), (("event_type", "event_type"),))
PAGES = IndexSpec("page_id", (), ("url",))
TURNS = IndexSpec("turn_id", ("text",), ("role",), (), (("role", "role"),))

_built: dict[tuple[str, str, str], SearchIndex] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, IndexSpec]:
    if name == "documents":
        return table(spark, sf_dir, "documents"), DOCUMENTS
    if name in ("parts", "parts_flat"):
        return table(spark, sf_dir, "part").withColumn("category", F.concat_ws("/", "p_type", "p_brand")), PARTS if name == "parts" else PARTS_FLAT
    if name == "events":
        return table(spark, sf_dir, "events"), EVENTS
    if name == "pages":
        return table(spark, sf_dir, "pages"), PAGES
    turns = table(spark, sf_dir, "conversations")
    # raises beyond 2^31 conversations; turns count to 2^32
    return turns.withColumn("turn_id", F.col("conv_id") * (1 << 32) + F.col("turn")), TURNS


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder in a session of one JVM, an error in any other."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def index_of(spark: SparkSession, sf_dir: str, name: str = "documents") -> SearchIndex:
    """The index of a table, kept in the shared folder until the driver's JVM exits."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        path = f"{shared_dir(spark)}/quern-index-{name}-{uuid.uuid4().hex}"
        df, spec = _source(spark, sf_dir, name)
        SearchIndex.build(df, spec).save(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
        _built[key] = SearchIndex.load(spark, path)
    return _built[key]


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted documents of a later snapshot: those labelled toxic."""
    return table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
