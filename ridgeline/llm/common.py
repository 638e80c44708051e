"""What several operators of this subpackage share."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.sources.shared import shared_dir, small_batches  # noqa: F401  the latter is taken from here


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table of ours, by the file system that holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_out(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: the lineage ends there, and a lost executor costs nothing.

    Statistics of the files also tell later joins their true sizes."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables of one operator in the shared folder, removed when their last reader is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, what: str) -> DataFrame:
        """write_out, with the shuffle files of finished steps removed."""
        table, path = write_out(df, what)
        self.paths.append((table, path))
        release(self.spark)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            for own in [x for x in self.paths if x[0] is t]:
                delete_path(self.spark, own[1])
                self.paths.remove(own)


def byte_cuts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about so many bytes; a larger row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def number_rows(df: DataFrame, within: str, order: list[str], out: str, parts: int = 64) -> DataFrame:
    """Number the rows of each value of `within` from 0 without gaps, however many rows one value has.

    The rows of a value are dealt to `parts` by a hash of `order`; each part is numbered by a window, and the
    counts of the parts (at most values x parts rows) give its first number. `order` must tell rows apart;
    repeated rows get different numbers in any order. The order among parts is by hash."""
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(within, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col(within).alias("_within"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy(within, "_part").orderBy(*order)
    numbered = dealt.withColumn("_own", F.row_number().over(own) - 1)
    return (
        numbered.join(firsts, (F.col(within) == F.col("_within")) & (F.col("_part") == F.col("_p")))
        .withColumn(out, F.col("_own") + F.col("_first"))
        .drop("_part", "_p", "_within", "_own", "_first")
    )


_RELEASED = [0.0]


def release(spark: SparkSession, least_s: float = 3.0) -> None:
    """Have the shuffle files of finished steps removed now: Spark drops them when the driver's objects are collected. Not again within so many seconds."""
    import gc

    if time.monotonic() - _RELEASED[0] >= least_s:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _RELEASED[0] = time.monotonic()


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with _doc and _text; _doc is the key itself where that is unique and not null, else a number in the order of key and text."""
    rows = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    if docs.groupBy(F.col(key).alias("_k")).count().where("count > 1 or _k is null").head(1):
        ordered = rows.orderBy(F.asc_nulls_last(key), "_text").withColumn("_doc", F.monotonically_increasing_id())
        return write_out(ordered, "numbered")[0]
    return rows.withColumn("_doc", F.col(key).cast("long"))
