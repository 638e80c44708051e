"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: How written tables are stored: plainly, so that a file is about as large as its rows are in memory.
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or the folder given to setCheckpointDir. Where neither is set, a temporary one in local mode; on a cluster that is an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="ridgeline-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


def new_folder(spark: SparkSession, what: str) -> str:
    """The name of a folder of one's own in the shared one; it is not made."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The table, written to the shared folder and read back: what several branches of a plan use is worked out once, and a lost executor costs nothing.

    Spark takes a table for as small as its files are, through joins and unions, and even series compress to a small part of what
    they take in memory; so files are stored plainly, and a large table is not taken for one that can be broadcast."""
    path = new_folder(df.sparkSession, what)
    df.write.options(**PLAIN).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Batches for Python workers hold at most so many bytes, where the session allows more: workers hold whole batches of texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(name, str(most))
