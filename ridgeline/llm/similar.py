"""Near-duplicates by the likeness of word shingles: an exact set-similarity join.

A text's set has the 64-bit hashes of its shingles of WORDS words (ASCII lower case, split at ASCII white space; a shorter text is one
shingle). Two sets are linked if their Jaccard similarity is at least NUM / DEN. No sketch guarantees that: at 0.8 a bit
of SimHash differs in about one case of seven, so masks that cover the radius have hardly a bit left to key by. The
prefix filter does: in any one order of all shingles, two linked sets share one among the first n - ceil(0.8 n) + 1 of
either. The order puts common shingles last (counted in a part of the texts, which moves cost and never results).

So SimHash goes first, as in `simhash`: texts whose fingerprints are equal or within its radius are compared by their whole
sets, and what that connects is not compared again; the prefix filter finds the rest.

Equal sets are one node. Nodes that share a prefix shingle meet: under shingles of up to PAIRS nodes in pairs, which
lengths, places and a bitmap of parities bound (a bit that differs stands for at least one shingle that one set alone
has); under others first with two nodes of the group, and what that does not connect in blocks of about BLOCK hashes, of
which a task finds a spanning forest and does not compare what is connected by then. Shingles held by the same nodes count once. Of what meets, each node is
compared with its smallest partner first, then pairs that no links connect so far, by their whole sets. Links go
through connected components.

Null and empty texts have empty sets and are one node. Ids may repeat or be null, as in `numbered`; of repeated rows one stays. Texts may
be of any length: a text's set is worked out on its own, eight bytes for each different shingle. Other columns stay as they are,
whatever their names. An empty table gives an empty one. Tables that were written for a step go when their last reader is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import simhash
from ridgeline.llm.common import Scratch, numbered
from ridgeline.llm.graph import components
from ridgeline.llm.simhash import _LOWER

WORDS, NUM, DEN, SEED = 5, 4, 5, 42
PAIRS, BLOCK = 32, 1 << 20
#: More than so many comparisons go in PARTS one after the other, so that the sets that they move lie on disk by a part at a time.
MANY, PARTS = 50_000, 4
#: Longs of a set's bitmap of parities.
PARITY = 16
#: Nodes and keys are sent to all tasks up to this number; beyond it they are joined by a shuffle.
SENT = 1_000_000
#: One text in SAMPLE counts for the order; shingles of OFTEN of them or more stand last, at most HOT shingles (8 bytes each, sent to all tasks).
SAMPLE, OFTEN, HOT = 32, 3, 500_000


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted different hashes of a text's shingles."""
    import xxhash

    parts, digest = text.translate(_LOWER).split(), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), SEED)] if parts else [], np.uint64).view(np.int64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    stops = ends[words - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], np.uint64).view(np.int64))


def _sig(own: np.ndarray) -> int:
    import xxhash

    return int(np.array(xxhash.xxh64_intdigest(own.tobytes(), SEED), np.uint64).view(np.int64))


def parities(own: np.ndarray) -> np.ndarray:
    """A bit for each of 64 PARITY classes of hashes: whether the set has an odd number of them."""
    odd = np.bincount((own.view(np.uint64) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, keep: str, value) -> DataFrame:
    """docs: _doc, _text. Returns `_doc` or `sig` or both, as keep names them, n int, keys array<long>: value(set) of each text, and parity if keep names `_doc`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, start, size, out = batch.column(0), batch.column(1).cast(pa.binary()), 0, 0, []
            for i in range(len(docs) + 1):
                if i > start and (i == len(docs) or size > 1 << 18):
                    keys = pa.ListArray.from_arrays(np.cumsum([0, *(len(k) for _, _, k, _ in out)]).astype(np.int32), np.concatenate([k for _, _, k, _ in out]))
                    columns = {"_doc": docs.slice(start, i - start), "sig": pa.array([s for s, _, _, _ in out], pa.int64()), "n": pa.array([n for _, n, _, _ in out], pa.int32()), "keys": keys}
                    if "parity" in names:
                        columns["parity"] = pa.ListArray.from_arrays(np.arange(0, PARITY * len(out) + 1, PARITY, np.int32), np.concatenate([p for _, _, _, p in out]))
                    yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)
                    start, size, out = i, 0, []
                if i < len(docs):
                    own = shingle_set(texts[i].as_py() or b"")
                    out.append((_sig(own), len(own), value(own), parities(own) if "parity" in names else None))
                    size += len(own)

    more = ["parity"] if "_doc" in keep else []
    names = [*keep.split(), "n", "keys", *more]
    return docs.select("_doc", "_text").mapInArrow(run, ", ".join([*(f"{c} long" for c in keep.split()), "n int", "keys array<long>", *(f"{c} array<long>" for c in more)]))


def _common(docs: DataFrame) -> np.ndarray:
    """Common shingles, rarest first."""
    some = docs.where(F.pmod(F.xxhash64("_doc", F.lit(3)), F.lit(SAMPLE)) == 0)
    held = _sets(some, "sig", lambda own: own).dropDuplicates(["sig"])
    counts = held.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") >= OFTEN)
    return counts.orderBy(F.desc("count"), "key").limit(HOT).select("key").toArrow().column(0).to_numpy()[::-1].copy()


def prefix_of(own: np.ndarray, common: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The prefix of a set; common: the sorted common shingles, places: their places in the order."""
    if not len(own):
        return own
    n = len(own) + (-NUM * len(own)) // DEN + 1
    at = np.minimum(np.searchsorted(common, own), max(len(common) - 1, 0))
    place = np.where(common[at] == own, places[at] + 1, 0) if len(common) else np.zeros(len(own), np.int64)
    return own[np.argsort(place, kind="stable")[:n]]


def _alike(both: Column, a: Column, b: Column) -> Column:
    return both * (NUM + DEN) >= NUM * (a + b)


def _sent(some: DataFrame) -> DataFrame:
    """A written table, sent to all tasks if it is small."""
    return F.broadcast(some) if some.count() <= SENT else some


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _forest(nodes: list[int], sets: list[np.ndarray], split: int | None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of alike sets; with `split`, of pairs across it alone."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts, flag = np.cumsum(sizes) - sizes, np.zeros(len(ids) and int(ids.max()) + 1, bool)
    root, out = np.arange(len(nodes)), []
    for i in range(len(nodes) - 1 if split is None else split):
        begin = i + 1 if split is None else split
        if begin == len(nodes) or (root[begin:] == root[i]).all():
            continue
        own = ids[starts[i] : starts[i] + sizes[i]]
        flag[own] = True
        shared = np.add.reduceat(flag[ids[starts[begin] :]], starts[begin:] - starts[begin], dtype=np.int64)
        flag[own] = False
        for j in (np.flatnonzero(shared * (NUM + DEN) >= NUM * (sizes[begin:] + sizes[i])) + begin).tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((nodes[i], nodes[j]))
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, half, node, keys) ordered by bucket and half. half is 0 for a whole bucket; 1 and 2 are two blocks of one."""

    def links() -> pa.RecordBatch:
        split = None if not halves[0] else sum(h == 1 for h in halves)
        found = np.array(_forest(nodes, sets, split), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

    bucket, halves, nodes, sets = None, [], [], []
    for batch in batches:
        for b, h, n, keys in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            if b != bucket and nodes:
                yield links()
                halves, nodes, sets = [], [], []
            bucket = b
            halves.append(h)
            nodes.append(n)
            sets.append(keys.values.to_numpy())
    if nodes:
        yield links()


def _rest_of_groups(members: DataFrame, ends: DataFrame, sets: DataFrame, near: DataFrame, scratch: Scratch) -> DataFrame:
    """Links of crowded groups that `near` leaves to be found: nodes that are not yet connected with their group's first node against those that are, and among one another, in blocks of about BLOCK hashes."""
    roots = scratch.write(components(near), "roots")
    placed = members.join(roots, F.col("sig") == F.col("node"), "left").select("key", "sig", "n", F.coalesce("root", "sig").alias("root"))
    placed = scratch.write(placed, "placed")
    main = placed.join(ends, (F.col("key") == F.col("_key")) & (F.col("sig") == F.col("_low"))).select(F.col("key").alias("_k"), F.col("root").alias("_main"))
    placed = placed.join(main, F.col("key") == F.col("_k")).select("key", "sig", "n", (F.col("root") != F.col("_main")).alias("apart"))
    half = BLOCK // 2
    blocks = placed.groupBy(F.col("key").alias("_k")).agg(*[F.ceil(F.sum(F.when(F.col("apart") == apart, F.col("n")).otherwise(0)) / half).cast("long").alias(c) for c, apart in (("u", True), ("v", False))], F.bool_or("apart").alias("_any")).where("_any").drop("_any")
    blocks = blocks.withColumns({c: F.greatest(c, F.lit(1)) for c in "uv"})
    dealt = placed.join(blocks, F.col("key") == F.col("_k")).withColumn("own", F.pmod(F.xxhash64("sig", F.lit(7)), F.when(F.col("apart"), F.col("u")).otherwise(F.col("v"))))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    place = lambda i, j, kind, half: F.struct(F.xxhash64("key", i, j, F.lit(kind)).alias("bucket"), half.cast("int").alias("half"))
    among = F.transform(upto("u"), lambda o: place(F.least(o, F.col("own")), F.greatest(o, F.col("own")), 0, F.when(o == F.col("own"), 0).when(F.col("own") < o, 1).otherwise(2)))
    across = F.transform(upto("v"), lambda o: place(F.col("own"), o, 1, F.lit(1)))
    known = F.transform(upto("u"), lambda o: place(o, F.col("own"), 1, F.lit(2)))
    rows = dealt.withColumn("p", F.explode(F.when(F.col("apart"), F.concat(among, across)).otherwise(known))).select("p.bucket", "p.half", F.col("sig").alias("_node"))
    rows = scratch.write(rows, "rows")
    part = lambda i, n: rows.where(F.pmod(F.xxhash64("bucket"), F.lit(n)) == i)
    shipped = lambda i, n: part(i, n).join(sets, F.col("_node") == F.col("sig")).select("bucket", "half", F.col("_node").alias("node"), "keys").repartition(F.col("bucket")).sortWithinPartitions("bucket", "half", "node")
    parts = PARTS if rows.count() > MANY else 1
    return _union([scratch.write(shipped(i, parts).mapInArrow(_links, "u long, v long").distinct(), "links") for i in range(parts)])


def _hash_pairs(rows: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs a, b of nodes that SimHash proposes: a node and the least one of its fingerprint, and the least ones of linked fingerprints."""
    firsts = rows.join(nodes.select("sig", "low"), F.col("_doc") == F.col("low")).select("sig", "_text")
    hashed = scratch.write(simhash.fingerprint(firsts, "_text", keep=["sig"]), "hashed")
    lows = scratch.write(hashed.groupBy("simhash").agg(F.min("sig").alias("first")), "fingerprints")
    named = lambda h, s: lows.select(F.col("simhash").alias(h), F.col("first").alias(s))
    equal = hashed.join(named("_h", "a"), F.col("simhash") == F.col("_h")).select("a", F.col("sig").alias("b"))
    linked = simhash.near_links(lows, "simhash").join(named("u", "a"), "u").join(named("v", "b"), "v").select("a", "b")
    pairs = equal.unionByName(linked).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    out = scratch.write(pairs.distinct(), "hash-pairs")
    scratch.drop(hashed, lows)
    return out


def near_links(docs: DataFrame, nodes: DataFrame, prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links u, v between nodes that connect all that alike pairs connect. nodes: sig, low (a _doc), n; prefixes: sig, n, keys."""
    proposed = _hash_pairs(docs, nodes, scratch)
    marks = prefixes.select("sig", "n", F.posexplode("keys").alias("at", "key"))
    several = scratch.write(marks.groupBy("key").agg(F.min("sig").alias("a"), F.max("sig").alias("b")).where("a < b").select(F.col("key").alias("_key")), "shared")
    held = scratch.write(marks.join(_sent(several), F.col("key") == F.col("_key")).select("key", "sig", "n", "at").distinct(), "held")
    scratch.drop(several, prefixes)
    counts = scratch.write(held.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.sum(F.xxhash64("sig").cast("decimal(38,0)")).alias("who")), "counts")
    full = held.join(counts.select("_key", "m"), F.col("key") == F.col("_key")).where(F.col("m") <= PAIRS).drop("_key", "m")
    side = lambda s: full.select("key", F.col("sig").alias(s), F.col("n").alias(f"n_{s}"), F.col("at").alias(f"at_{s}"))
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + F.least("at_a", "at_b")
    met = side("a").join(side("b"), "key").where("a < b").where(_alike(F.least("n_a", "n_b"), F.col("n_a"), F.col("n_b")) & _alike(rest, F.col("n_a"), F.col("n_b")))
    met = scratch.write(met.select("a", "b").distinct(), "met")
    bitmap = lambda s: nodes.select(F.col("sig").alias(s), F.col("n").alias(f"n_{s}"), F.col("parity").alias(f"p_{s}"))
    apart = F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    bounded = met.join(bitmap("a"), "a").join(bitmap("b"), "b").where(apart * (NUM + DEN) <= (DEN - NUM) * (F.col("n_a") + F.col("n_b")))
    pairs = scratch.write(bounded.select("a", "b"), "pairs")
    scratch.drop(met)
    groups = counts.where(F.col("m") > PAIRS).groupBy("m", "total", "who").agg(F.min("_key").alias("_key")).select("_key", "m")
    members = scratch.write(held.select("key", "sig", "n").distinct().join(groups, F.col("key") == F.col("_key")).select("key", "sig", "n", "m"), "members")
    scratch.drop(held, counts)
    ends_of = [t.select(F.col(c).alias("_sig")) for t, c in ((pairs, "a"), (pairs, "b"), (proposed, "a"), (proposed, "b"), (members, "sig"))]
    wanted = _union(ends_of).distinct()
    lows = scratch.write(nodes.join(wanted, F.col("sig") == F.col("_sig"), "left_semi").select("low"), "lows")
    sets = scratch.write(_sets(docs.join(_sent(lows), F.col("_doc") == F.col("low"), "left_semi"), "sig", lambda own: own), "sets")
    scratch.drop(lows)
    named = lambda s: sets.select(F.col("sig").alias(s), F.col("n").alias(f"n_{s}"), F.col("keys").alias(f"keys_{s}"))

    def alike(some: DataFrame) -> DataFrame:
        """Which of the pairs a, b of a written table are alike, by their whole sets."""
        parts = PARTS if some.count() > MANY else 1
        both = lambda i: some.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == i).join(named("a"), "a").join(named("b"), "b")
        found = lambda i: both(i).where(_alike(F.size(F.array_intersect("keys_a", "keys_b")), F.col("n_a"), F.col("n_b"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
        return _union([scratch.write(found(i), "near") for i in range(parts)])

    # Of a crowded group each node is first compared with two of its nodes, the same for all; most are linked by then.
    ends = members.groupBy(F.col("key").alias("_key")).agg(F.min("sig").alias("_low"), F.max("sig").alias("_high"))
    largest = members.groupBy(F.col("sig").alias("_sig")).agg(F.max(F.struct("m", "key")).alias("_l")).select("_sig", F.col("_l.key").alias("_of"))
    star = largest.join(ends, F.col("_of") == F.col("_key")).select("_sig", F.explode(F.array("_low", "_high")).alias("_end")).where("_sig <> _end")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(star.select(F.least("_sig", "_end").alias("a"), F.greatest("_sig", "_end").alias("b"))).distinct()
    # What SimHash connects needs no second comparison.
    hashed = alike(proposed)
    roots = scratch.write(components(hashed), "roots")
    root = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    first = first.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    near = hashed.unionByName(alike(scratch.write(first, "first")))
    near = near.unionByName(_rest_of_groups(members, ends, sets, near, scratch))
    roots = scratch.write(components(near), "roots")
    tried = pairs.groupBy("b").agg(F.min("a").alias("a"))
    left = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    rest = scratch.write(left.select("a", "b").join(tried, ["a", "b"], "left_anti"), "rest")
    return near.unionByName(alike(rest))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row of the smallest key (of repeated or null keys the first by text)."""
    names = docs.columns
    rows, scratch = numbered(docs, key, text), Scratch(docs.sparkSession)
    last = _common(rows)
    order = np.argsort(last)
    shared = docs.sparkSession.sparkContext.broadcast((last[order], order))
    prefixes = scratch.write(_sets(rows, "_doc sig", lambda own: prefix_of(own, *shared.value)), "prefixes")
    nodes = scratch.write(prefixes.groupBy("sig").agg(F.min("_doc").alias("low"), F.min("n").alias("n"), F.any_value("parity").alias("parity")), "nodes")
    roots = components(near_links(rows, nodes, prefixes, scratch))
    rooted = nodes.join(roots, nodes["sig"] == roots["node"], "left").select("low", F.coalesce("root", "sig").alias("root"))
    kept = scratch.write(rooted.groupBy("root").agg(F.min("low").alias("_kept")).select("_kept"), "kept")
    scratch.drop(*[t for t, _ in scratch.paths if t is not kept])
    return rows.join(_sent(kept), F.col("_doc") == F.col("_kept"), "left_semi").select(*[F.col(f"`{c}`") for c in names])
