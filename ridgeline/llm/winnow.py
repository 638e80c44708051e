"""Document fingerprints by winnowing.

The hashes of all k-grams of code points are rolled up by doubling; of every window of w consecutive k-grams the least
hash is kept, the rightmost on ties, with its position. Two texts that share w + k - 1 code points in a row therefore
share a kept hash. A text shorter than k code points has one print, the hash of the whole; one with fewer than w
k-grams is a single window; an empty text or a null has none. Equal texts have equal fingerprints.

A fingerprint is binary: for each print eight bytes, hash and position, both unsigned and big-endian, in the order of
the positions. Texts may be of any length: a batch is cut between texts into pieces of about CHUNK code points, and one
text takes some dozens of bytes for each of its own. Repeated rows are treated each on its own. Other columns pass through,
whatever their names; one that is called like the output is an error. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM, WINDOW = 12, 20
CHUNK = 1 << 21
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _rolled(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of the k-grams that begin at each place (the last k - 1 mean nothing)."""
    n = len(points)
    power, width = _BASE, 1
    part = (points.astype(np.uint64) + np.uint64(1)) * _MIX
    part ^= part >> np.uint64(29)
    total, done = None, 0
    while True:
        if k & width:
            if total is None:
                total, done = part.copy(), width
            else:
                total[: n - done] = total[: n - done] * power + part[done:]
                done += width
        width *= 2
        if width > k:
            break
        half = width // 2
        part[: n - half] = part[: n - half] * power + part[half:]
        with np.errstate(over="ignore"):
            power = power * power
    total ^= total >> np.uint64(32)
    total *= _MIX
    return total >> np.uint64(32)


def prints(texts: list[str], k: int = GRAM, w: int = WINDOW) -> list[np.ndarray]:
    """For each text an array of (hash, position) rows."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    empty = np.zeros((0, 2), ">u4")
    out = [empty] * len(texts)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes)
    starts, grams = ends - sizes, sizes - k + 1
    for i in np.flatnonzero((grams < 1) & (sizes > 0)).tolist():
        out[i] = np.array([[zlib.crc32(texts[i].encode("utf-8", "surrogatepass")), 0]], ">u4")
    if not (grams > 0).any():
        return out
    key = (_rolled(points, k) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(points), dtype=np.uint64))
    least, width = key.copy(), 1
    while width < w:
        step = min(width, w - width)
        np.minimum(least[:-step], least[step:], out=least[:-step])
        width += step
    full = grams >= w
    counts = np.where(full, grams - w + 1, 0)
    window_at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    picked = least[window_at]
    if len(picked):
        picked = picked[np.concatenate(([True], picked[1:] != picked[:-1]))]
    places = np.int64(0xFFFFFFFF) - (picked & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.searchsorted(ends, places, side="right")
    table = np.empty((len(picked), 2), ">u4")
    table[:, 0] = picked >> np.uint64(32)
    table[:, 1] = places - starts[owner]
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in np.flatnonzero(grams > 0).tolist():
        if full[i]:
            out[i] = table[cut[i] : cut[i + 1]]
        else:
            best = key[starts[i] : starts[i] + grams[i]].min()
            out[i] = np.array([[best >> np.uint64(32), 0xFFFFFFFF - int(best & np.uint64(0xFFFFFFFF)) - starts[i]]], ">u4")
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of the sets of hashes; 1 if both are empty."""
    x, y = np.unique(a[:, 0]), np.unique(b[:, 0])
    both = len(np.intersect1d(x, y, assume_unique=True))
    either = len(x) + len(y) - both
    return both / either if either else 1.0


def _packed(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _cut(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > CHUNK:
            yield start, i
            start, total = i, 0
        total += len(t)
    yield start, len(texts)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Add the fingerprint of a column's texts."""
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for a, b in _cut(texts):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns, _packed(prints(texts[a:b], k, w))], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())]))


#: Ranges of ids: about this many rows in one, and so many ranges at most (what the driver and a broadcast hold of them).
RANGE_ROWS, COARSE, FINE = 64, 256, 1024


def _ranges(docs: DataFrame, key: str) -> Column | None:
    """The number of a row's range of ids, rising with the id; -1 for null. None if there is no id."""
    probabilities = [i / COARSE for i in range(COARSE + 1)]
    n, bounds = docs.agg(F.count(key), F.percentile_approx(key, probabilities, 2000)).first()
    if not n:
        return None
    bounds = sorted(set(bounds))
    fine = max(1, min(FINE, n // RANGE_ROWS // len(bounds)))
    edges = F.array(*[F.lit(b) for b in bounds])
    at = F.greatest(F.size(F.filter(edges, lambda b: b <= F.col(key))), F.lit(1))
    low, high = F.element_at(edges, at), F.element_at(edges, F.least(at + 1, F.lit(len(bounds))))
    within = F.when(high > low, F.floor((F.col(key) - low) / (high - low) * fine)).otherwise(0)
    within = F.greatest(F.least(within, F.lit(fine - 1)), F.lit(0))
    return F.when(F.col(key).isNull(), -1).otherwise(at * fine + within).cast("long")


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next text, in descending order of `key` (nulls last; after the last: the first).

    The edited text has its last third replaced by the beginning of the next text. The texts are dealt once, by ranges
    of the key; each range also gets the first row of the range after it, so the next text is always at hand.
    Repeated keys are ordered by the text's hash. An empty table gives an empty table.
    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    import hashlib

    fields = [T.StructField(key, T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.BinaryType()), T.StructField("edited_fingerprint", T.BinaryType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
    number = _ranges(docs, key)
    number = F.lit(-1).cast("long") if number is None else number
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"), number.alias("_range"))
    heads = sorted(((r[0], r[1]) for r in rows.groupBy("_range").agg(F.max("_key")).collect()), reverse=True)  # at most COARSE x FINE
    above = {heads[i + 1][0]: heads[i][0] for i in range(len(heads) - 1)} | ({heads[0][0]: heads[-1][0]} if heads else {})
    after = docs.sparkSession.createDataFrame([(r, first, above[r]) for r, first in heads], "_of long, _first long, _goes_to long")
    copies = rows.join(F.broadcast(after), (F.col("_range") == F.col("_of")) & F.col("_key").eqNullSafe(F.col("_first")), "left")
    targets = F.array(F.struct(F.col("_range"), F.lit(False).alias("_tail")), F.struct(F.col("_goes_to").alias("_range"), F.lit(True).alias("_tail")))
    dealt = copies.withColumn("_to", F.explode(F.when(F.col("_goes_to").isNull(), F.slice(targets, 1, 1)).otherwise(targets)))
    dealt = dealt.select("_to._range", "_to._tail", "_key", "_text").repartition("_range").sortWithinPartitions(F.col("_range"), F.col("_tail"), F.desc_nulls_last("_key"), F.xxhash64("_text"))
    schema = T.StructType(fields)

    def done(rows: list[tuple]) -> pa.RecordBatch | None:
        """Of rows in order, all but the last, whose next row is not known yet."""
        texts = [r[3] for r in rows]
        whole = prints(texts, k, w)
        own = [i for i in range(len(rows) - 1) if not rows[i][1]]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[i + 1][: len(texts[i]) // 3] for i in own]
        other = prints(edited, k, w)
        columns = [
            [rows[i][2] for i in own],
            [len(texts[i]) for i in own],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            [whole[i].tobytes() for i in own],
            [p.tobytes() for p in other],
            [likeness(whole[i], p) for i, p in zip(own, other)],
            [likeness(whole[i], whole[i + 1]) for i in own],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append(row)
                size += len(row[3])
                if size > CHUNK:
                    yield done(held)
                    held, size = held[-1:], 0
        if held:
            yield done(held)

    return dealt.mapInArrow(run, schema)
