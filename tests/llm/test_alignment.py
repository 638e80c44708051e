import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import alignment, queries
from ridgeline.llm.alignment import SPACE

PARTS = ["a", "the ", " of", "  ", "\n", "\n ", " \n", "\t", "é", "日本", "😀", "'s", "12345", "﻿", " ", " x", "\x1c ", "\x85 ", "unbelievably ", "<s>", "<|endoftext|>", "ﬁ", "!?", "́"]


@pytest.fixture(scope="module")
def paths():
    pytest.importorskip("tokenizers")
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries(paths):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=paths[1])


def texts():
    rng = random.Random(13)
    wild = ["".join(rng.choices(PARTS, k=rng.randrange(40))) for _ in range(400)]
    return [None, "", " ", "  ", "x ", " x", "a b", SPACE, f"a{SPACE}b", "\n", "word\nword  word", "z" * 3000, "日" * 500, "tab\t tab", *wild]


def brute(libraries, rows):
    """Links by the overlap of all tokens' ranges, groups by the sets of ends."""
    a_lib, b_lib = libraries
    alphabet = alignment.byte_alphabet()
    docs = []
    for text in rows:
        if not text:
            docs.append(([], [], [], []))
            continue
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        a_bytes = [bytes(alphabet[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:-1], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace(SPACE, " ").encode() for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            docs.append(([], [], [], []))
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        links, k = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(b) and spans[1][j][0] < e:
                links.append((i, j))
                j += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [([t for t, (_, e) in zip(a, spans[0]) if lo < e <= hi], [t for t, (_, e) in zip(b, spans[1]) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        docs.append((a, b, groups, links))
    counts = Counter(p for a, b, _, links in docs for p in {(a[i], b[j]) for i, j in links})
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for a, b, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        own = [counts[a[i], b[j]] for i, j in links]
        out.append((len(a), len(b), len(groups), len(links), hashlib.sha256(said.encode()).hexdigest() if a else "", sum(n == best[a[i]] for n, (i, _) in zip(own, links)), sum(own)))
    return docs, out


@pytest.mark.parametrize("sent", [0, 2_000_000])
def test_like_libraries(spark, libraries, monkeypatch, tmp_path, sent):
    rows = [(i, t) for i, t in enumerate(texts())] + [(5, "a b"), (None, "the end")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(alignment, "PAIRS_SENT", sent)
    got = queries.op13_alignment(spark, str(tmp_path))
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    _, want = brute(libraries, [t for _, t in rows])
    assert sorted((tuple(r[c] for c in ["doc_id", *names]) for r in got.collect()), key=str) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=str)


def test_tokens_cuts_and_links(spark, libraries, paths, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED", 50)
    own = texts()
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in alignment.align(docs, *paths, ["a_ids", "b_ids", "a_cuts", "b_cuts", "link_a", "link_b"]).collect()}
    for i, (a, b, groups, links) in enumerate(brute(libraries, own)[0]):
        r = got[i]
        assert (list(r.a_ids), list(r.b_ids)) == (a, b), repr(own[i])
        assert sorted(zip(r.link_a, r.link_b)) == links
        ends = [[], []]
        for g in groups:
            for e, ids in zip(ends, g):
                e.append((e[-1] if e else 0) + len(ids))
        assert [list(r.a_cuts), list(r.b_cuts)] == ends


def test_bits():
    import numpy as np

    rng = np.random.default_rng(3)
    places = np.unique(rng.integers(0, 1000, 200))
    bits = alignment.Bits.of(places, 1000)
    assert bits.select().tolist() == places.tolist()
    asked = np.arange(1025)
    assert bits.rank(asked).tolist() == np.searchsorted(places, asked).tolist()


def test_empty_table_and_names(spark, paths):
    docs = spark.createDataFrame([], "doc_id long, text string, groups int")
    assert alignment.align(docs, *paths, ["n_a"]).collect() == []
    with pytest.raises(ValueError):
        alignment.align(docs, *paths, ["groups"])
    assert alignment.align(docs.withColumn("x", F.lit(1)), *paths, ["groups"], keep=["x"]).columns == ["x", "groups"]
