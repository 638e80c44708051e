"""Benchmark decontamination: a prefix-filtered set join of documents with item windows.

Words are runs of letters and digits: A-Z is lower-cased, and [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ are the words. Every run
of WINDOW consecutive item words is a window; an item of fewer words, but not none, is one window. A document must hold
a window whole, so its similarity threshold is full containment and the necessary prefix, in the order of rarity over
all documents, is one word: the window's rarest. Only documents' occurrences of such words give candidates; the word's
offset in the window and the document's length bound where the window can lie; the words there are then compared one
by one. Document words inside any occurrence are hit.

The index of the item windows is built for blocks of items of at most BLOCK bytes of text, each sent to all tasks; more
items mean more passes over the documents, whose hits are then united, so neither memory nor broadcasts grow with the
benchmark. Null texts have no words. Repeated documents get a row each; of items with one id the windows are united.
Documents need a key for the union only when there is more than one block; a row number is added then. Columns besides
those asked for are dropped, one of these that is called like an output is an error; names of the benchmark's columns don't
matter. Texts may be of any length: a document's words are held once, its hits as ranges. Of windows whose words are equally rare the
first word is the prefix. Empty tables of documents give an empty one; without items no word is hit.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import write_out

WINDOW, BLOCK = 10, 16 << 20
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def _texts(batch: pa.RecordBatch, name: str = "_text") -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def word_counts(docs: DataFrame, text: str, wanted: set[bytes]) -> dict[bytes, int]:
    """How often each wanted word occurs in all documents; tasks count first."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, own = Counter(), shared.value
        for batch in batches:
            for data in _texts(batch):
                found.update(w for w in words_of(data) if w in own)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, "word binary, n long")
    return {bytes(r[0]): r[1] for r in rows.groupBy("word").agg(F.sum("n")).toLocalIterator()}


class WindowIndex:
    """Windows by their rarest word: prefix word -> (offset of that word, window, item numbers)."""

    def __init__(self, items: list[tuple[str, bytes]], counts: dict[bytes, int], window: int):
        owners = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners[tuple(words[i : i + window])].add(item)
        self.by_word = defaultdict(list)
        for words, own in owners.items():
            at = min(range(len(words)), key=lambda i: (counts.get(words[i], 0), words[i], i))
            if all(w in counts for w in words):  # else some word is in no document
                self.by_word[words[at]].append((at, words, tuple(own)))
        self.by_word = dict(self.by_word)

    def find(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray, set[str]]:
        """Number of words; begins and ends of occurrences; items."""
        words, begins, ends, items = words_of(text), [], [], set()
        n, by_word = len(words), self.by_word
        for i in [i for i, w in enumerate(words) if w in by_word]:
            for at, window, own in by_word[words[i]]:
                a = i - at
                b = a + len(window)
                if a >= 0 and b <= n and words[a] == window[0] and tuple(words[a:b]) == window:
                    begins.append(a)
                    ends.append(b)
                    items.update(own)
        return n, np.array(begins, np.int32), np.array(ends, np.int32), items


def _covered(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    out = []
    for a, b in sorted(zip(begins.tolist(), ends.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    rows = items.select(F.col(f"`{item}`").cast("string"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")))
    block, size = [], 0
    for name, data in rows.toLocalIterator():
        if block and size + len(data) > most:
            yield block
            block, size = [], 0
        block.append(("" if name is None else name, bytes(data)))
        size += len(data)
    yield block


def find_items(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The columns `keep` of docs with n_words long, spans array<struct<begin, end>> (word ranges that are hit, apart from one another) and items array<string> (sorted)."""
    added = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("items", T.ArrayType(T.StringType()))]
    if clash := {f.name for f in added} & set(keep):
        raise ValueError(f"a kept column is called {', '.join(sorted(clash))}")
    blocks = _blocks(items, item, item_text, block)
    first = next(blocks)
    second = next(blocks, None)
    if second is not None:
        docs, _ = write_out(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
        keep = [*keep, "_row"]
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def one(part: list[tuple[str, bytes]]) -> DataFrame:
        counts = word_counts(docs, text, {w for _, data in part for w in words_of(data)})
        shared = docs.sparkSession.sparkContext.broadcast(WindowIndex(part, counts, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = [index.find(data) for data in _texts(batch)]
                columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([[{"begin": a, "end": b} for a, b in _covered(f[1], f[2])] for f in found], span), pa.array([sorted(f[3]) for f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *columns], [*keep, "n_words", "spans", "items"])

        rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
        return rows.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + added))

    if second is None:
        return one(first)
    parts = [one(first), one(second), *map(one, blocks)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("_row").agg(*[F.first(f"`{c}`").alias(c) for c in keep if c != "_row"], F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    grown = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<begin:int,end:int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["begin"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["begin"].alias("begin"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s))),
    )
    return merged.withColumn("spans", grown).drop("_row")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
