"""Shared pieces of the training-data operators: word rules, staged tables, hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staging_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` names it.

    Where it is unset, a session in one JVM (master ``local``, as in tests) gets a temporary
    folder, and any other is refused: a folder of the driver's own is no use on a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


_staged: dict[str, list[str]] = {}


def stage(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return the written table.

    This cuts lineage: an executor lost later costs a re-read, not a re-computation. The
    table goes with ``drop_staged``, or when the driver's JVM exits.
    """
    path = f"{staging_dir(spark)}/quern-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete all tables staged in this session, once their results are written or collected; how many there were."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A one-element array binds it as a lambda variable, so that neither projection
    collapsing nor nested lambdas evaluate it again.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
