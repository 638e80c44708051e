"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A text's fingerprint has 64 bits: the majority of the bits of its word shingles' XXH64. Two fingerprints are linked if
at most RADIUS bits differ. Candidates come from covering masks: each bit position gets a non-zero vector of RADIUS + 1
bits, and for each of the 2^(RADIUS+1) - 1 non-zero vectors v there is a table keyed by the bits whose vector has an
odd product with v. The vectors of at most RADIUS differing bits span less than the whole space, so some v is orthogonal
to all of them: in v's table the two keys agree. Every pair within the radius meets; about half of the bits must agree.

Equal fingerprints are one node, so copies of a text cost nothing. A bucket of up to BUCKET nodes is compared in one
task, which returns the links of a spanning forest of the bucket's real links, not its pairs. A larger bucket is divided
by a second and third family of masks with other vectors (pairs within the radius meet again), and what is still larger
by blocks, whose pairs are compared in different tasks. No link is lost. Links go through connected components.

A null text has no words, like an empty one: fingerprint zero, linked like any other. Null ids never become a component's
id unless a component has no other. Repeated rows fall into one component. Texts may be of any length: fingerprints are
worked out a text at a time. Further columns are not touched; one called simhash or component_id is an error. An empty table gives an empty one.

Within RADIUS bits lie copies and texts that differ in very little; near copies of a likeness of 0.8 mostly differ in more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import numbered, write_out
from ridgeline.llm.graph import components

RADIUS, SHINGLE, SEED = 3, 3, 42
BUCKET, FAMILIES = 2048, 3
CHUNK = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(texts: list[bytes], words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    import xxhash

    hashes, counts, digest = [], [], xxhash.xxh64_intdigest
    for text in texts:
        parts = text.translate(_LOWER).split()  # of bytes: at spaces and 09 to 0D
        if len(parts) <= words:
            if parts:
                hashes.append(digest(b" ".join(parts), seed))
            counts.append(int(bool(parts)))
            continue
        line = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        stops = ends[words - 1 :].tolist()
        starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
        hashes += [digest(line[a:b], seed) for a, b in zip(starts, stops)]
        counts.append(len(stops))
    out = np.zeros(len(texts), np.uint64)
    n = np.array(counts, np.int64)
    if hashes:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = np.flatnonzero(n)
        sums = np.add.reduceat(bits, (np.cumsum(n) - n)[own], axis=0, dtype=np.int32)
        out[own] = np.packbits(2 * sums > n[own, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None, words: int = SHINGLE) -> DataFrame:
    """The columns `keep` (default: all) and simhash long (the 64 bits, signed)."""
    keep = docs.columns if keep is None else keep
    if "simhash" in keep:
        raise ValueError("a kept column is called simhash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column("_text").cast(pa.binary()).to_pylist()]
            start = size = 0
            for i in range(len(texts) + 1):
                if i == len(texts) or size > CHUNK:
                    rows = batch.slice(start, i - start)
                    got = fingerprints(texts[start:i], words).view(np.int64)
                    yield pa.RecordBatch.from_arrays([*(rows.column(j) for j in range(len(keep))), pa.array(got)], [*keep, "simhash"])
                    start, size = i, 0
                if i < len(texts):
                    size += len(texts[i])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("simhash", T.LongType())])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, schema)


def masks(family: int, radius: int = RADIUS) -> list[int]:
    """The masks of one family, as signed longs; families give the bits different vectors."""
    vectors = (1 << (radius + 1)) - 1
    order = np.random.default_rng(family).permutation(64) if family else np.arange(64)
    own = [int(i) % vectors + 1 for i in order]
    out = [sum(1 << bit for bit in range(64) if bin(own[bit] & v).count("1") % 2) for v in range(1, vectors + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _forest(nodes: np.ndarray, radius: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of pairs within the radius; with `split`, of pairs across it alone."""
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, bits = [], nodes.view(np.uint64)
    for i in range(len(nodes) - 1 if split is None else split):
        begin = i + 1 if split is None else split
        for j in (np.flatnonzero(np.bitwise_count(bits[begin:] ^ bits[i]) <= radius) + begin).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, half, node) ordered by bucket and half. half is 0 for a whole bucket; 1 and 2 are two blocks of one."""

    def batch_of(pairs: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

    def links(bucket: np.ndarray, half: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        sizes, out = np.diff(cut), []
        two = cut[:-1][sizes == 2]
        two = two[half[two] == half[two + 1]] if len(two) else two
        two = two[half[two] == 0]
        near = np.bitwise_count((node[two] ^ node[two + 1]).view(np.uint64)) <= radius
        out.append(np.stack([node[two][near], node[two + 1][near]], 1))
        for a, n in zip(cut[:-1].tolist(), sizes.tolist()):
            split = None if half[a] == 0 else int(np.searchsorted(half[a : a + n], 2))
            if (n > 2 or split is not None) and (found := _forest(node[a : a + n], radius, split)):
                out.append(np.array(found, np.int64))
        return batch_of(out)

    held = None
    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(3)]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        last = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
        if last:
            yield links(*(x[:last] for x in rows))
        held = [x[last:] for x in rows]
    if held is not None and len(held[0]):
        yield links(*held)


def _bucket(key: Column, node: Column, family: int, radius: int) -> Column:
    """An array with the bucket of every table: a hash of the bucket before, the table and the key. A chance collision only adds comparisons."""
    return F.array(*[F.xxhash64(key, F.lit(t), node.bitwiseAND(F.lit(m))) for t, m in enumerate(masks(family, radius))])


def near_links(nodes: DataFrame, node: str, radius: int = RADIUS) -> DataFrame:
    """Links u, v between distinct values of `node` that connect all that is connected by pairs within the radius."""
    spark = nodes.sparkSession
    rows = nodes.select(F.col(node).alias("node"), F.lit(0).cast("long").alias("bucket"))
    found = None
    for family in range(FAMILIES):
        rows, _ = write_out(rows.select("node", F.explode(_bucket(F.col("bucket"), F.col("node"), family, radius)).alias("bucket")), "buckets")
        counts, _ = write_out(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
        full = rows.join(counts, "bucket")
        small = full.where(F.col("n") <= BUCKET).select("bucket", F.lit(0).alias("half"), "node")
        found = small if found is None else found.unionByName(small)
        if not counts.where(F.col("n") > BUCKET).head(1):
            break
        rows, _ = write_out(full.where(F.col("n") > BUCKET).select("bucket", "node", "n"), "hot")
    else:
        blocks = rows.withColumn("b", F.ceil(F.col("n") / (BUCKET // 2)).cast("long")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("b")))
        others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("b") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
        dealt = blocks.withColumn("p", F.explode(others))
        half = F.when(F.col("p.i") == F.col("p.j"), 0).when(F.col("own") == F.col("p.i"), 1).otherwise(2)
        found = found.unionByName(dealt.select(F.xxhash64("bucket", "p.i", "p.j").alias("bucket"), half.cast("int").alias("half"), "node"))
    dealt = found.repartition(F.col("bucket")).sortWithinPartitions("bucket", "half", "node")
    return dealt.mapInArrow(lambda batches: _links(batches, radius), "u long, v long").distinct()


def near_duplicates(hashed: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Add component_id to (key, simhash) rows: the smallest key that links reach."""
    if "component_id" in hashed.columns:
        raise ValueError("a column is called component_id")
    nodes, _ = write_out(hashed.groupBy("simhash").agg(F.min(key).alias("_low")), "nodes")
    roots = components(near_links(nodes, "simhash", radius))
    rooted = nodes.join(roots, nodes["simhash"] == roots["node"], "left").select("simhash", "_low", F.coalesce("root", "simhash").alias("root"))
    least = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("_low").alias("component_id"))
    classes = rooted.join(least, F.col("root") == F.col("_root")).select(F.col("simhash").alias("_simhash"), "component_id")
    return hashed.join(classes, F.col("simhash") == F.col("_simhash")).drop("_simhash")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row of the smallest key (of repeated or null keys the first by text)."""
    names = docs.columns
    rows = numbered(docs, key, text)
    hashed, _ = write_out(fingerprint(rows, "_text", keep=["_doc"]), "hashed")
    kept = near_duplicates(hashed, "_doc", radius).where(F.col("_doc") == F.col("component_id")).select(F.col("_doc").alias("_kept"))
    return rows.join(kept, F.col("_doc") == F.col("_kept"), "left_semi").select(*[F.col(f"`{c}`") for c in names])
