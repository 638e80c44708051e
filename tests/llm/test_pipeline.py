import math

import corpus_pipeline as cp
import tiktoken

import public_tokenizers
from ridgeline.llm import bpe, quality
from ridgeline.llm.queries import ranks_path
from test_lines import brute as brute_lines
from test_quality import plain_figures, plain_model
from test_similar import plain_kept

SF = "/root/testdata/sf0.001"


def plain_good(docs, labels, fold):
    """Ids that the classifier should keep. docs: id -> (text, lang)."""
    marks = {}
    for i, a, b in labels:
        marks[i] = min(marks.get(i, 1), int(a == 1 and b == 0))
    good, bad = (plain_model([docs[i][0] for i, g in marks.items() if g == want and fold[i]]) for want in (1, 0))
    held = [i for i, g in marks.items() if g == 1 and fold[i] == 0]
    at = lambda x, share: sorted(x)[max(0, math.ceil(share * len(x) - 1e-9) - 1)]
    edges = [at([len(docs[i][0]) for i in held], s) for s in (0.2, 0.4, 0.6, 0.8)]
    length = {i: sum(len(t) > e for e in edges) for i, (t, _) in docs.items()}
    figures = {i: plain_figures(good, bad, t) for i, (t, _) in docs.items()}
    limits = {}
    for i in held:
        for key in {(lang, n) for lang in (docs[i][1], "") for n in (length[i], -1)}:
            limits.setdefault(key, []).append(figures[i])
    limits = {k: [at([f[j] for f in own], share) for j, share in enumerate(quality.QUANTILES.values())] for k, own in limits.items() if len(own) >= (quality.HELD if k[1] < 0 else quality.HELD_ALIKE) or k == ("", -1)}
    own = lambda i: next(limits[k] for k in ((docs[i][1], length[i]), (docs[i][1], -1), ("", length[i]), ("", -1)) if k in limits)
    return {i for i in docs if all(x <= y + 1e-4 * abs(y) for x, y in zip(figures[i], own(i)))}


def plain_words(text):
    out, word = [], ""
    for c in text + " ":
        if ord(c) >= 128 or c.isalnum():
            word += c.lower() if ord(c) < 128 else c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_clean(text, items):
    words, windows = plain_words(text), set()
    for item in map(plain_words, items):
        windows.update(tuple(item[i : i + 10]) for i in range(max(1, len(item) - 9)) if item)
    return not any(tuple(words[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words) - n + 1))


def test_stages_like_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    fold = {r[0]: r[1] for r in docs.selectExpr("doc_id", "pmod(xxhash64(coalesce(text, ''), 11), 5)").collect()}
    by_id = {r.doc_id: (r.text or "", r.lang) for r in docs.collect()}
    good = sorted(plain_good(by_id, labels, fold))
    assert good == sorted(r.doc_id for r in cp.quality_filter(spark, docs, SF).collect()) and len(good) < len(by_id)
    cleaned = brute_lines([by_id[i][0] for i in good], 2, 20)
    single = sorted(plain_kept(cleaned))
    left = {good[k]: cleaned[k] for k in single if plain_clean(cleaned[k], items)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks_path()), special_tokens={})
    got = cp.run(spark, SF).collect()
    assert {r.doc_id: list(r.token_ids) for r in got} == {d: own.encode_ordinary(t) for d, t in left.items()}
    assert len(got) == len(left) < len(single) < len(good)


def test_stages_bear_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame, n in ((docs, 2), (docs.limit(0), 0)):
        for _, stage in cp.STAGES:
            frame = stage(spark, frame, SF)
        assert frame.count() == n
