import random
import re

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import repetition as R


def brute(text):
    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = word.findall(text)
    lines = [x for x in text.split("\n") if word.search(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(again), "dup_line_chars": sum(len(w) for x in again for w in word.findall(x))}
    for n in R.LENGTHS:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        both = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(n)}
        later = {i + k for i, g in enumerate(grams) if g in grams[:i] for k in range(n)}
        if n == 5:
            out["n_repeat_words"] = len(both)
        out[f"repeat_chars_{n}"] = sum(len(words[i]) for i in later)
    return out


def texts():
    rng = random.Random(2)
    small = ["".join(rng.choices(["a ", "b ", "é\n", "漢\t", "# ", "c\r\n", "\x0b", "\x0c", " ", "\x1c"], k=rng.randrange(90))) for _ in range(150)]
    prose = [" ".join(rng.choices([f"w{i}" for i in range(40)], k=rng.randrange(300))) + "\n" for _ in range(20)]
    return [None, "", " ", "\n\n", "one", "a b c d e", "a b c d e a b c d e", "x y\nx y\n x y\nx y", "😀 $ " * 30, *small, *prose, prose[0] * 3, prose[1]]


def test_like_plain_version(spark, monkeypatch):
    rows = [(i, t, t) for i, t in enumerate(texts())] + [(3, "a b", "a b"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body string").repartition(3)
    got = R.judge(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(r.text)
        assert {f: r[f] for f in R.FIGURES} == want, repr(r.text)
        failed = want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]
        over = 100 * want["n_dup_lines"] > 30 * want["n_lines"] or 100 * want["dup_line_chars"] > 20 * want["word_chars"] or any(100 * want[f"repeat_chars_{n}"] > m * want["word_chars"] for n, m in R.LENGTHS.items())
        assert (r.base_failed, r.kept) == (failed, not failed and not over)
    assert {r.kept for r in got} == {True, False}


def test_collisions_cost_no_result(monkeypatch):
    """With a base that makes all hashes of a text alike the words still tell n-grams apart."""
    data = [t.encode() for t in texts() if t]
    want = R.measure(data)
    import numpy as np

    monkeypatch.setattr(R, "_MIX", np.uint64(0))
    got = R.measure(data)
    assert all((got[f] == want[f]).all() for f in R.FIGURES)


def test_long_text_empty_table_and_names(spark):
    docs = spark.createDataFrame([(1, "ab cd ef gh ij " * 100_000)], "doc_id long, text string")
    (row,) = R.judge(docs, keep=["doc_id"]).collect()
    assert row.n_words == 500_000 == row.n_repeat_words and row.base_failed and not row.kept
    assert R.judge(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        R.judge(docs.withColumn("n_words", F.lit(1)))
    with pytest.raises(ValueError):
        R.judge(docs.withColumn("kept", F.lit(1)))
    assert R.judge(docs.withColumn("n_words", F.lit(1)), keep=["doc_id"]).count() == 1
