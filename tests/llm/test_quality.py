import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ridgeline.llm import quality as q


def plain_model(texts):
    """Interpolated modified Kneser-Ney, written out plainly; returns the probability of a 5-gram of symbols."""
    grams = Counter()
    for t in texts:
        line = [ord(q.PAD)] * (q.ORDER - 1) + plain_symbols(t)
        grams.update(tuple(line[i : i + q.ORDER]) for i in range(len(line) - q.ORDER + 1))
    levels = {q.ORDER: grams}
    for n in range(q.ORDER - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    stats = {}
    for n, level in levels.items():
        t = Counter(level.values())
        share = t[1] / max(t[1] + 2 * t[2], 1)
        cut = [0] + [min(max(i - (i + 1) * share * t[i + 1] / max(t[i], 1), 0.05), i - 0.05) for i in (1, 2, 3)]
        total, left = defaultdict(int), defaultdict(float)
        for g, c in level.items():
            total[g[:-1]] += c
            left[g[:-1]] += cut[min(c, 3)]
        stats[n] = (cut, total, left)

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(levels[1]) + 1)
        cut, total, left = stats[n]
        if not total[gram[:-1]]:
            return p(gram[1:])
        c = levels[n][gram]
        return (c - cut[min(c, 3)]) / total[gram[:-1]] + left[gram[:-1]] / total[gram[:-1]] * p(gram[1:])

    return p


def plain_symbols(text):
    return [32 if c.isspace() else 48 if c.isdigit() else ord(c) for c in text.lower()]


def plain_bits(p, text):
    line = [ord(q.PAD)] * (q.ORDER - 1) + plain_symbols(text)
    return [-math.log2(p(tuple(line[i : i + q.ORDER]))) for i in range(len(line) - q.ORDER + 1)]


def plain_figures(good, bad, text):
    bits = plain_bits(good, text)
    if not bits:
        return [1.0, 1.0, 0.0, 0.0]
    more = [a - b for a, b in zip(bits, plain_bits(bad, text))]

    def upper(x, width, rank):
        if len(x) <= width:
            return sum(x) / len(x)
        means = sorted(sum(x[i : i + width]) / width for i in range(len(x) - width + 1))
        return means[min(len(means) - 1, int(rank * len(means)))]

    return [2 ** (sum(bits) / len(bits)), 2 ** upper(bits, q.WINDOW, 0.99), upper(more, q.CONTRAST_WINDOW, 0.99), upper(more, q.PASSAGE, 1.0)]


def test_like_a_plain_model(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("aab cdé.\n7日😀ж", k=rng.randrange(80))) for _ in range(60)] + ["", "É"]
    frame = spark.createDataFrame([("good", t) for t in texts], "model string, text string").repartition(3)
    model = q.train(q.count_ngrams(frame))
    p = plain_model(texts)
    other = ["abz cd", "", "aab a", "zzzz 99", "жж日本😀", "a" * 400]
    for most in (10**9, 0):
        got = {r.text2: r for r in q.score(spark.createDataFrame([(t, t) for t in other], "text string, text2 string"), model, most=most).collect()}
        assert len(got) == len(other)
        for t in other:
            bits = plain_bits(p, t)
            assert abs(got[t].perplexity - (2 ** np.mean(bits) if t else 1)) < 1e-4
    own = model.toArrow()
    by = defaultdict(float)
    for size, key, prob in zip(*(own.column(c).to_pylist() for c in ("size", "key", "p"))):
        if prob is not None and size == 1:
            by[size] += prob
    assert by[1] <= 1 + 1e-9


def test_thresholds_and_keep_like_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(q, "HELD", 12)
    monkeypatch.setattr(q, "HELD_ALIKE", 5)
    rng = random.Random(5)
    say = lambda a, n: "".join(rng.choices(a, k=n))
    docs = [(i, say("abcde  " if i % 3 else "жбвгд  ", rng.randrange(3, 120)) + ("xyx" * (i % 2 * 3) if i % 7 == 0 else ""), [None, "aa", "bb"][i % 3]) for i in range(220)]
    docs += [(900, None, "aa"), (901, "", None), (902, docs[5][1], "aa"), (903, "@" * 50, "cc")]
    labels = [(i, int(i % 11 != 0), int(i % 7 == 0)) for i in range(0, 220)] + [(3, 0, 0), (None, 1, 0), (7, None, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    fold = {r[0]: r[1] for r in frame.selectExpr("doc_id", "pmod(xxhash64(coalesce(text, ''), 11), 5)").collect()}
    good_of = {}
    for i, a, b in labels:
        if i is not None and a is not None:
            good_of[i] = min(good_of.get(i, 1), int(a == 1 and b == 0))
    text_of = {i: t or "" for i, t, _ in docs}
    good, bad = (plain_model([text_of[i] for i, g in good_of.items() if g == want and fold[i]]) for want in (1, 0))
    held = [i for i, g in good_of.items() if g == 1 and fold[i] == 0]
    lengths = sorted(len(text_of[i]) for i in held)
    at = lambda x, share: sorted(x)[max(0, math.ceil(share * len(x) - 1e-9) - 1)]
    edges = [at(lengths, s) for s in (0.2, 0.4, 0.6, 0.8)]
    length = {i: sum(len(t) > e for e in edges) for i, t in text_of.items()}
    figures = {i: plain_figures(good, bad, t) for i, t in text_of.items()}
    lang = {i: x for i, _, x in docs}
    rows = [(l, n, i) for i in held for l in {lang[i] or "", ""} for n in (length[i], -1)]
    limits = {}
    for l, n in {r[:2] for r in rows}:
        own = [figures[r[2]] for r in rows if r[:2] == (l, n)]
        if len(own) >= (12 if n < 0 else 5) or (l, n) == ("", -1):
            limits[l, n] = [at([f[k] for f in own], share) for k, share in enumerate(q.QUANTILES.values())]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for rows_sent in (10**9, 0):
        got = {r.doc_id: r for r in q.classify(frame, marks, model_rows=rows_sent).collect()}
        assert len(got) == len(docs) and {r.keep for r in got.values()} == {True, False}
        for i, _, l in docs:
            assert np.allclose([got[i][f] for f in q.FIGURES], figures[i], rtol=1e-4, atol=1e-4), i
            own = next(limits[k] for k in ((l, length[i]), (l, -1), ("", length[i]), ("", -1)) if k in limits)
            margin = min(abs(x - y) for x, y in zip(figures[i], own))
            assert margin < 1e-4 or got[i].keep == all(x <= y for x, y in zip(figures[i], own)), i


def test_toxic_passage_in_a_very_long_text(spark):
    """A few bad words are found in a long text as well as in a short one."""
    rng = random.Random(8)
    words = ["".join(rng.choices("aeiourstnl", k=rng.randrange(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    bad = ["zkrvx", "qwzzk", "xkcdq"]
    docs = [(i, prose(int(10 ** rng.uniform(1.5, 4))), "en") for i in range(700)]
    docs += [(i, f"{prose(60)} {' '.join(rng.choices(bad, k=5))} {prose(60)}", "en") for i in range(1000, 1150)]
    docs += [(2000, f"{prose(20_000)} {bad[0]} {bad[1]} {bad[2]} {prose(20_000)}", "en"), (2001, prose(40_000), "en")]
    labels = [(i, 1, int(i >= 1000)) for i, _, _ in docs if i < 2000]
    got = {r.doc_id: r.keep for r in q.classify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert not got[2000] and got[2001]


def test_held_out_toxic_documents(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    hidden = labels.where("pmod(xxhash64(doc_id), 2) = 0")
    got = q.classify(docs, labels.join(hidden, "doc_id", "left_anti"))
    rows = got.join(hidden, "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("share")).collect()
    kept = {(r.quality, r.toxic): r.share for r in rows}
    assert kept[1, 0] > 0.94 and kept[1, 1] < 0.2


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, 1), (2, "", "en", 1), (2, "x", "xx", 1)], "doc_id long, text string, lang string, keep int")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.keep for r in q.classify(docs, labels.limit(0)).collect()] == [True] * 3
    assert len(q.classify(docs, labels).collect()) == 3
    assert q.classify(docs.limit(0), labels).collect() == []
    clash = docs.toDF("doc_id", "text", "lang", "perplexity").withColumn("_length", F.lit("x"))
    assert sorted(q.keep_good(clash, labels).collect(), key=str) == sorted(clash.collect(), key=str) and q.keep_good(clash, labels).columns == clash.columns


def test_the_model_reaches_the_driver_narrow(spark, monkeypatch):
    """At most 17 bytes a row and its model's name, where it took 28; and the scorer is that of the whole rows."""
    seen = [("good", "the quick brown fox"), ("good", "a lazy dog sleeps"), ("bad", "zzz xx qq")]
    model = q.train(q.count_ngrams(spark.createDataFrame(seen, "model string, text string"))).cache()
    taken, made = [], q.Scorer.__init__

    def looked(self, rows, *rest):
        taken.append({f.name: f.type.bit_width for f in rows.schema if f.name != "model"})
        made(self, rows, *rest)

    want = q.Scorer(model.toArrow()).score(["the fox", "xx a dog", ""])
    monkeypatch.setattr(q.Scorer, "__init__", looked)
    out = q.score(spark.createDataFrame([("the fox",), ("xx a dog",), ("",)], "text string").coalesce(1), model, whole=True).collect()
    assert sum(taken[0].values()) <= 17 * 8
    assert [[r[f] for f in q.FIGURES] for r in out] == [list(map(float, x)) for x in zip(*want)]
