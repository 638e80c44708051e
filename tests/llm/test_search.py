import math
import random
import re
from collections import Counter

import pytest

from ridgeline.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    tfs = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in tfs]
    count, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in tfs for t in c)
    out = []
    for item, text in items:
        found = []
        for (key, _), c, size in zip(docs, tfs, n):
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                m = 50 + 50 * size * count // total
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, key, -s) for i, (s, _, _, key) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def corpus(rng, n=400):
    words = [f"W{i}" for i in range(60)] + ["É", "漢字", "naïve", "x²", "don't"]
    weight = [1 / (i + 1) for i in range(len(words))]
    text = lambda most: " ".join(rng.choices(words, weight, k=rng.randrange(most)))
    docs = [(i, text(120)) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(5, docs[5][1]), (None, "W1 W2"), (2000, None), (2001, ""), (2002, "w1 " * 20000), (2003, "\x00--..")]
    items = [(f"i{i}", text(25)) for i in range(12)] + [("same", docs[7][1]), ("same", docs[7][1]), ("none", None), ("empty", ""), ("absent", "zzz"), (None, "W3"), ("all", " ".join(words))]
    return docs, items


@pytest.mark.parametrize("block", [500, 1 << 21])
def test_like_plain_scores(spark, monkeypatch, block):
    docs, items = corpus(random.Random(block))
    monkeypatch.setattr(search, "BLOCK", block)
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n string").repartition(3)
    asked = spark.createDataFrame(items, "item_id string, text string")
    got = search.search(table, asked, k=10).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, 10)


def test_parts_of_items(spark, monkeypatch):
    docs, items = corpus(random.Random(1), 60)
    monkeypatch.setattr(search, "PART", 200)
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), k=5).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, 5)


def test_stops_before_the_end():
    """Rare terms settle the best documents; the common ones' postings are not all taken."""
    import numpy as np

    rng = np.random.default_rng(4)
    n = 5000
    rows = np.arange(n + 1) * 2
    terms = np.tile([0, 1], n)
    impacts = np.where(terms == 0, rng.integers(1, 20, 2 * n), np.where(np.arange(2 * n) < 200, 10_000, 1))
    block = search.Block(terms, impacts, rows)
    asked = []
    whole = search.Block.complete
    block.complete = lambda *a: asked.append(len(a[1])) or whole(block, *a)
    found, scores = block.best([0, 1], 10)
    totals = impacts.reshape(n, 2).sum(1)
    assert scores.tolist() == sorted(totals.tolist(), reverse=True)[:10]
    assert asked and asked[0] <= 200


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert search.search(docs.limit(0), items).collect() == []
    assert search.search(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in search.search(docs, items).collect()] == brute([(1, "a b")], [("q", "a")], 50)
    with pytest.raises(ValueError):
        search.search(docs, items.withColumnRenamed("item_id", "score"), item="score")
