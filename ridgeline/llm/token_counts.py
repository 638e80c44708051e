"""Token counts as rollups that deltas maintain.

A store has two tables of signed rows, one folder for each batch: `ledger` holds what a batch changed for each document and
tokenizer version (+ its new state, - the state before), `totals` the same changes summed by source, language and tokenizer
version. Both only add up: the sum over all committed batches is the present state, so no total is ever read, changed and
written. Inserting a document that is known under a version with other figures revises it: the old figures are taken
back with the new ones' arrival. Under another version it counts beside them.

Commits are idempotent. A batch is written under its own name and counts once its marker stands in `commits`; a batch
with a marker is skipped, and one that broke off is simply written over. The ledger lies in buckets of document ids: a
commit reads the buckets that its ids fall into, and joins with the rows of those ids alone. `compact` writes the state
as one folder, marked in the same way, which stands for the batches before it. One writer commits at a time.

Null sources, languages and tokenizers are values like any other; a null count is 0. A document that a batch inserts more
than once under a version counts once, with the greatest of its rows; what it also deletes is inserted. Deleting an
unknown document, or inserting it as it is, changes nothing. Null ids are ignored. Further columns are not read. Counts come
from a tokenizer elsewhere, so texts of any length are a number here. An empty batch is a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, sign long, bucket int"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class Store:
    """buckets: into how many parts document ids fall; fixed when the store begins."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _names(self, folder: str) -> list[str]:
        """Names in a folder of the store, by whatever file system holds it: a name for each batch."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def batches(self) -> list[str]:
        return self._names("commits")

    def _folders(self) -> list[str]:
        """Folders whose rows make the state: the last compaction, and the batches after it."""
        done, last = self.batches(), self._names("compacted")[-1:]
        covered = [r[0] for r in self.spark.read.schema("name string").parquet(f"{self.path}/compacted/{last[0]}").collect()] if last else []  # names of batches
        return last + [b for b in done if b not in set(covered)]

    def _read(self, table: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{table}/{b}") for b in self._folders()]
        out = self.spark.createDataFrame([], schema)
        for p in parts:
            out = out.unionByName(p)
        return out

    @staticmethod
    def _sum(rows: DataFrame) -> DataFrame:
        """What is left when signed rows cancel out."""
        return rows.groupBy("doc_id", *KEYS, "n_tokens").agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign")

    def state(self) -> DataFrame:
        """The present row of every document and version."""
        return self._sum(self._read("ledger", LEDGER))

    def totals(self) -> DataFrame:
        sums = self._read("totals", TOTALS).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0")

    def _bucket(self):
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def _write(self, signed: DataFrame, name: str) -> None:
        rows = signed.select("doc_id", *KEYS, "n_tokens", "sign").withColumn("bucket", self._bucket())
        rows.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/ledger/{name}")
        rows = self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/{name}")
        rows.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")).write.mode("overwrite").parquet(f"{self.path}/totals/{name}")

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """inserts: doc_id, source, lang, tokenizer, n_tokens; deletes: doc_id, of all versions, or with tokenizer of that one. False if the batch had been committed."""
        if batch in self.batches():
            return False
        new = self.spark.createDataFrame([], LEDGER) if inserts is None else inserts
        new = new.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(k).cast("string").alias(k) for k in KEYS], F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens")).where("doc_id is not null")
        new = new.groupBy("doc_id", "tokenizer").agg(F.max(F.struct("source", "lang", "n_tokens")).alias("new"))
        gone = self.spark.createDataFrame([], "doc_id long") if deletes is None else deletes
        versions = "tokenizer" in gone.columns
        gone = gone.select(F.col("doc_id").cast("long").alias("_gone"), *[F.col("tokenizer").cast("string").alias("_version")] * versions).where("_gone is not null").distinct()
        ids = new.select("doc_id").unionByName(gone.select(F.col("_gone").alias("doc_id"))).distinct()
        touched = sorted(r[0] for r in ids.select(self._bucket().alias("b")).distinct().collect())  # at most `buckets`
        known = self._read("ledger", LEDGER).where(F.col("bucket").isin(touched) if touched else F.lit(False))
        old = self._sum(known.join(ids.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left_semi"))
        old = old.groupBy(F.col("doc_id").alias("_doc"), F.col("tokenizer").alias("_tokenizer")).agg(F.max(F.struct("source", "lang", "n_tokens")).alias("old"))
        both = new.join(old, (F.col("doc_id") == F.col("_doc")) & F.col("tokenizer").eqNullSafe(F.col("_tokenizer")), "full_outer")
        both = both.select(F.coalesce("doc_id", "_doc").alias("doc_id"), F.when(F.col("new").isNull(), F.col("_tokenizer")).otherwise(F.col("tokenizer")).alias("tokenizer"), "new", "old")
        same = F.col("doc_id") == F.col("_gone")
        both = both.join(gone, same & F.col("tokenizer").eqNullSafe(F.col("_version")) if versions else same, "left")
        changed = both.where(F.when(F.col("new").isNull(), F.col("_gone").isNotNull()).otherwise(~F.col("new").eqNullSafe(F.col("old"))))
        sides = F.array(*[F.struct(F.col(c).alias("row"), F.lit(sign).cast("long").alias("sign")) for c, sign in (("new", 1), ("old", -1))])
        self._write(changed.select("doc_id", "tokenizer", F.explode(sides).alias("x")).where("x.row is not null").select("doc_id", "tokenizer", "x.row.*", "x.sign"), batch)
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/commits/{batch}")
        return True

    def compact(self) -> str | None:
        """Write the state as one folder that stands for all batches so far; its name. None without any batch. Totals stay what they are."""
        done = self.batches()
        if not done:
            return None
        name = f"compact-{len(done):09d}"
        if name not in self._names("compacted"):
            self._write(self.state().withColumn("sign", F.lit(1).cast("long")), name)
            self.spark.createDataFrame([(b,) for b in done], "name string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/compacted/{name}")
        return name
