"""Ranked lexical search over impact-ordered postings, score at a time.

A term's impact in a document is the whole number that it adds to the score; it needs the corpus' counts, so documents are
tokenised once to rows of (terms, occurrences), from which Spark sums up how many documents there are, how long they are
and how many hold each term. Documents are then dealt to blocks of about BLOCK postings. A block's postings stand by term
and falling impact, in groups of one exact impact each. For an item the groups of its terms are taken in falling order of
impact, down to half of the highest impact left at a time, each added to the scores of its documents. What the next groups
of all terms would add together bounds what any document can still gain: once that is less than the k-th score so far, no
new document can come in, and of the others only those within it can. When to complete these costs no more than to go on,
their scores are completed from their own rows, and the k best stay. Scores are exact, so the best of the blocks' best
are the best of all.

Items are taken in parts of about PART bytes of text: a part's terms and weights go to all workers; a further part is a
further pass over the documents. Every row of items is an item of its own, so that repeated ones get the same ranks twice;
null and empty texts, and items whose terms no document has, get none. Documents of one score rank by rising key, nulls
last; repeated documents each count. A text may be of any length: what is kept of it are the items' terms in it. Other
columns are not read. Empty tables give an empty one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import delete_path, small_batches, write_out

PART, BLOCK = 16 << 20, 1 << 21
_WORDS = bytes(c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    """Maximal stretches of ASCII letters and digits and of all other code points; A-Z in lower case."""
    return text.translate(_WORDS).split()


def count_terms(docs: DataFrame, known: dict[bytes, int], key: str, text: str) -> DataFrame:
    """key, n (terms with repeats), terms (numbers of the known ones), counts (their occurrences)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    schema = T.StructType([docs.schema[key], T.StructField("n", T.LongType()), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("terms", "counts"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for batch in batches:
            n, sizes, terms, counts = [], [0], [], []
            for body in batch.column(1).cast(pa.binary()):
                words = words_of(body.as_py() or b"")
                found = Counter(filter(numbers.__contains__, words))
                n.append(len(words))
                terms.extend(map(numbers.__getitem__, found))
                counts.extend(found.values())
                sizes.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(v, pa.int32())) for v in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], schema.names)

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, schema)


class Block:
    """The impact-ordered index of some documents."""

    def __init__(self, terms: np.ndarray, impacts: np.ndarray, rows: np.ndarray):
        """terms and impacts of document i from rows[i] to rows[i + 1]."""
        self.rows, self.terms, self.impacts = rows, terms, impacts
        docs = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        order = np.lexsort((-impacts, terms))
        order = order[impacts[order] > 0]
        self.falling, self.docs, sorted_terms = -impacts[order], docs[order], terms[order]
        held, first = np.unique(sorted_terms, return_index=True)
        self.place = dict(zip(held.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)])))
        self.wanted = np.zeros(int(terms.max(initial=0)) + 1, bool)

    def best(self, item: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents for an item's terms, and their scores; equal scores by document."""
        spans = [list(self.place[t]) for t in item if t in self.place]
        scores, left = np.zeros(len(self.rows) - 1, np.int64), sum(b - a for a, b in spans)
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            level = -min(self.falling[a] for a, b in spans if a < b)
            for span in spans:
                a, b = span
                if a < b and -self.falling[a] >= (level + 1) // 2:
                    # The groups of all impacts down to half of the highest one; a document stands once in a term's postings.
                    end = a + int(np.searchsorted(self.falling[a:b], -((level + 1) // 2), side="right"))
                    scores[self.docs[a:end]] -= self.falling[a:end]
                    left -= end - a
                    span[0] = end
            spans = [s for s in spans if s[0] < s[1]]
            if not spans:
                found = np.flatnonzero(scores)
                break
            bound = -sum(int(self.falling[a]) for a, _ in spans)
            if len(scores) < k:
                continue
            least = int(np.partition(scores, len(scores) - k)[len(scores) - k])
            if bound < least:
                found = np.flatnonzero(scores >= least - bound)
                if int((self.rows[found + 1] - self.rows[found]).sum()) <= left:
                    scores = self.complete(item, found, scores)
                    break
        order = found[np.lexsort((found, -scores[found]))][:k]
        return order, scores[order]

    def complete(self, item: list[int], found: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Whole scores of the found documents from their own rows."""
        sizes = self.rows[found + 1] - self.rows[found]
        ends = np.cumsum(sizes)
        at = np.repeat(self.rows[found] - (ends - sizes), sizes) + np.arange(ends[-1])
        own = [t for t in item if t < len(self.wanted)]
        self.wanted[own] = True
        sums = np.concatenate(([0], np.cumsum(np.where(self.wanted[self.terms[at]], self.impacts[at], 0))))
        self.wanted[own] = False
        scores[found] = sums[ends] - sums[ends - sizes]
        return scores


def impacts_of(terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray, rows: np.ndarray, weights: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 20 m)) with m = 50 + (50 n N) div L, in whole numbers."""
    known, back = np.unique(lengths, return_inverse=True)
    m = np.array([50 + 50 * int(n) * n_docs // n_words for n in known], np.int64)[back]
    tf = counts.astype(np.int64)
    return weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, np.diff(rows))))


def _rank(index: DataFrame, key: str, items: list[list[int]], weights: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """_item (its number), key, score: for each block of documents the k best of each item."""
    shared = index.sparkSession.sparkContext.broadcast((items, weights))
    schema = T.StructType([T.StructField("_item", T.IntegerType()), index.schema[key], T.StructField("score", T.LongType())])

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.take(pc.sort_indices(table, sort_keys=[(key, "ascending")], null_placement="at_end"))  # so that a document's number says how its key ranks
        table = table.combine_chunks()
        lists = table.column("terms").combine_chunks()
        rows = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        terms = lists.flatten().to_numpy(zero_copy_only=False)
        counts = table.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        block = Block(terms, impacts_of(terms, counts, table.column("n").to_numpy(), rows, weights, n_docs, n_words), rows)
        numbers, docs, scores = [], [], []
        for i, item in enumerate(items):
            found, own = block.best(item, k)
            numbers.append(np.full(len(found), i, np.int32))
            docs.append(found)
            scores.append(own)
        if items:
            keys = table.column(key).combine_chunks().take(pa.array(np.concatenate(docs), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), keys, pa.array(np.concatenate(scores), pa.int64())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= BLOCK:
                yield from done(held)
                held, size = [], 0
        if held:
            yield from done(held)

    return index.select(key, "n", "terms", "counts").mapInArrow(run, schema)


def _search_part(docs: DataFrame, items: list[tuple], item_type: T.StructField, k: int, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    known: dict[bytes, int] = {}
    of = [[known.setdefault(w, len(known)) for w in dict.fromkeys(words_of((body or "").encode()))] for _, body in items]
    index, path = write_out(count_terms(docs, known, key, text), "postings")
    n_docs, n_words = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = index.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # at most the part's terms
    df = np.zeros(len(known) + 1, np.int64)
    df[held.column("term").to_numpy()] = held.column("count").to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    best, _ = write_out(_rank(index, key, of, weights, n_docs, n_words, k), "best")
    delete_path(spark, path)
    w = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last(f"`{key}`"))
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(items)], T.StructType([T.StructField("_number", T.IntegerType()), item_type]))
    return ranked.join(F.broadcast(names), F.col("_item") == F.col("_number")).select(names[item_type.name], "rank", ranked[key], "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item, rank (from 1), key, score: for each row of items its k documents of the highest score above 0."""
    if item == key or {item, key} & {"rank", "score"}:
        raise ValueError("the keys must have names of their own, other than rank and score")
    rows = items.select(F.col(f"`{item}`"), F.col(f"`{item_text}`").cast("string").alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = -(-size // PART) or 1
    part = F.pmod(F.xxhash64(F.col(f"`{item}`"), F.col("_text")), F.lit(parts))
    out = None
    for i in range(parts):
        own = _search_part(docs, [tuple(r) for r in rows.where(part == i).collect()], items.schema[item], k, key, text)  # about PART bytes
        out = own if out is None else out.unionByName(own)
    return out
