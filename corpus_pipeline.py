"""The corpus pipeline: quality filter, line dedup, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), with docs all that the stage before kept, and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents. Stages keep what
they have no reason to take: null and empty texts count as clean documents without words, of which near-dedup keeps one.
SQL cannot express the stages, so a test holds the rows against a plain version on a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import bpe, decontaminate, lines, quality, similar
from ridgeline.llm.common import read_table, write_out
from ridgeline.llm.queries import ranks_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs.select(COLUMNS), read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated and boilerplate lines; n_chars follows the text."""
    cut = lines.dedup_lines(docs.select(COLUMNS))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles alike to 0.8 or more): that of the smallest id.

    SimHash proposes and the whole sets decide; an exact join finds what lies beyond SimHash's radius."""
    return similar.keep_one(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.find_items(docs.select(COLUMNS), read_table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.where(F.size("spans") == 0).select(COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and byte offsets of each text."""
    tokens = bpe.encode(docs, ranks_path(), keep=["doc_id", "lang", "source"])
    return tokens.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [("quality classifier", quality_filter), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("byte-level BPE", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = write_out(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
