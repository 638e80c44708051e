import random

import numpy as np
import pytest
import xxhash

from ridgeline.llm import graph, simhash


def plain_fingerprint(text):
    words = text.encode().translate(simhash._LOWER).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, radius=3):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(nodes)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprints():
    rng = random.Random(4)
    texts = ["", " \n", "a", "A b", "É é x y", *(" ".join(rng.choices(["A", "b", "Éc", "d\t", "e\x0bf"], k=rng.randrange(30))) for _ in range(200))]
    assert simhash.fingerprints([t.encode() for t in texts]).tolist() == [plain_fingerprint(t) for t in texts]


def test_masks_cover():
    rng = random.Random(6)
    for family in range(simhash.FAMILIES):
        own = [m & (2**64 - 1) for m in simhash.masks(family)]
        for _ in range(3000):
            differing = sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
            assert any(differing & m == 0 for m in own)


@pytest.mark.parametrize("bucket", [2048, 8])
def test_components_like_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(25)] + [0, 0, 1]
    signed = [v - 2**64 if v >> 63 else v for v in values]
    rows = [(i if i % 7 else None, v) for i, v in enumerate(signed)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, simhash long")).collect()
    assert len(got) == len(rows)
    roots, least = plain_components(set(signed)), {}
    for i, v in rows:
        if i is not None:
            least[roots[v]] = min(least.get(roots[v], i), i)
    assert all(r.component_id == least.get(roots[r.simhash]) for r in got)


def test_long_path_and_empty(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (7, 3)], "u long, v long")
    assert {(r.node, r.root) for r in graph.components(edges).collect()} == {(i, 0) for i in range(61)}
    assert graph.components(edges.limit(0)).collect() == []
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5)], "doc_id long, text string, simhash2 int")
    hashed = simhash.fingerprint(docs)
    assert {r.component_id for r in simhash.near_duplicates(hashed).collect()} == {1}
    assert np.all([r.simhash == 0 for r in hashed.collect()])


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 2)], "doc_id long, text string, simhash int")
    with pytest.raises(ValueError):
        simhash.fingerprint(docs)
    hashed = simhash.fingerprint(docs, keep=["doc_id"])
    with pytest.raises(ValueError):
        simhash.near_duplicates(hashed.withColumn("component_id", hashed.doc_id))
