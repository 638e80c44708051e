import random

import pytest

from ridgeline.llm import decontaminate as d


def brute(docs, items, window):
    out = []
    for text in docs:
        words, hit, own = d.words_of((text or "").encode()), set(), set()
        for name, item in items:
            parts = d.words_of((item or "").encode())
            windows = [parts[i : i + window] for i in range(max(1, len(parts) - window + 1))] if parts else []
            for w in windows:
                for i in range(len(words) - len(w) + 1):
                    if words[i : i + len(w)] == w:
                        hit.update(range(i, i + len(w)))
                        own.add(name)
        out.append((len(words), len(hit), sorted(own)))
    return out


def test_like_brute_force(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choices(["a", "B", "c-d", "É", "9"], k=n))
    docs = [None, "", "!!", "a", *(say(rng.randrange(60)) for _ in range(150))]
    items = [("1", say(6)), ("2", "zz yy a"), ("10", "é"), ("3", None), ("4", ""), ("5", say(3)), ("5", say(5)), ("x", docs[20])]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)] + [(3, "a", "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id string, text string, n_words int")
    want = brute(docs, items, 4)
    for block in (1 << 20, 30):
        got = d.find_items(table, bench, ["doc_id"], window=4, block=block).collect()
        assert len(got) == len(docs) + 1
        for r in got:
            assert (r.n_words, sum(s.end - s.begin for s in r.spans), list(r.items)) == want[r.doc_id]
    assert d.find_items(table, bench.limit(0), ["doc_id"]).where("size(items) > 0").count() == 0
    assert d.find_items(table.limit(0), bench, ["doc_id"]).collect() == []


def test_long_text_ties_and_names(spark):
    """A very long document, windows of equally rare words, other columns and clashing ones."""
    words = [f"w{i % 1000}" for i in range(200_000)]
    docs = spark.createDataFrame([(1, " ".join(words), 7), (2, "p q r s " * 3, 8)], "doc_id long, text string, more int")
    bench = spark.createDataFrame([("a", " ".join(words[500:512])), ("b", "p q r s")], "item_id string, text string")
    got = {r.doc_id: r for r in d.find_items(docs, bench, ["doc_id", "more"]).collect()}
    assert got[1].n_words == 200_000 and len(got[1].spans) == 200 and sum(s.end - s.begin for s in got[1].spans) == 2400 and got[1].more == 7
    assert [(s.begin, s.end) for s in got[2].spans] == [(0, 12)] and list(got[2]["items"]) == ["b"]
    for name in ("n_words", "spans", "items"):
        with pytest.raises(ValueError):
            d.find_items(docs.withColumnRenamed("more", name), bench, ["doc_id", name])
