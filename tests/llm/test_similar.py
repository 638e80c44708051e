import random
from fractions import Fraction

import pytest

import corpus_pipeline as cp
from ridgeline.llm import similar


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_kept(docs):
    sets = [shingles(t) for t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or Fraction(len(sets[i] & sets[j]), union) >= Fraction(4, 5):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in range(len(docs))}


@pytest.mark.parametrize("pairs, block", [(32, 1 << 20), (2, 1 << 20), (2, 400)])
def test_stage_like_brute_force_jaccard(spark, monkeypatch, pairs, block):
    monkeypatch.setattr(similar, "PAIRS", pairs)
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "SAMPLE", 2)
    monkeypatch.setattr(similar, "MANY", 0 if block == 400 else 50_000)
    rng = random.Random(pairs)
    say = lambda n: [f"W{rng.randrange(300)}" for _ in range(n)]
    docs, common = [None, "", "a", "A b", "a  b"], say(40)
    for _ in range(12):
        base = say(rng.randrange(3, 120)) + common * rng.randrange(2)
        docs.append(" ".join(base))
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            docs.append(" ".join(own[: len(own) - rng.randrange(3)]))
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = cp.near_dedup(spark, table, "").collect()
    assert {r.doc_id for r in got} == plain_kept(docs) and len(got) < len(docs)
    assert all(r.text == docs[r.doc_id] for r in got)


def test_stage_goes_through_simhash(spark, monkeypatch):
    proposed, own = [], similar._hash_pairs
    monkeypatch.setattr(similar, "_hash_pairs", lambda *a: proposed.append(own(*a).collect()) or own(*a))
    # Repeated shingles outvote the rest of a fingerprint, but count once in a set: 0 and 1 have one fingerprint and are not alike.
    base = " ".join(f"w{i}" for i in range(60))
    docs = ["a b c d e f g " * 40 + base, "a b c d e f g " * 40 + base.replace("w", "v"), base, base + " " + base, None]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.near_dedup(spark, table, "").collect()} == plain_kept(docs) == {0, 1, 4}
    sig = {i: similar._sig(similar.shingle_set((t or "").encode())) for i, t in enumerate(docs)}
    assert tuple(sorted((sig[0], sig[1]))) in {tuple(r) for r in proposed[0]}
