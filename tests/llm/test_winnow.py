import hashlib
import random

import numpy as np

from ridgeline.llm import winnow

K, W = 5, 4


def brute(text):
    points = [ord(c) for c in text]
    if not points:
        return []
    if len(points) < K:
        return [(tuple(points), 0)]
    grams = [tuple(points[i : i + K]) for i in range(len(points) - K + 1)]
    return grams


def test_guarantee_and_positions():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abé漢", k=rng.randrange(80))) for _ in range(300)]
    for text, rows in zip(texts, winnow.prints(texts, K, W)):
        grams = brute(text)
        if len(text) < K:
            assert len(rows) == bool(text)
            continue
        by_place = {int(p): int(h) for h, p in rows}
        assert list(by_place) == sorted(by_place)
        for i in range(max(1, len(grams) - W + 1)):
            assert any(j in by_place for j in range(i, min(i + W, len(grams))))
        for p, h in by_place.items():
            for q, g in by_place.items():
                if grams[p] == grams[q]:
                    assert h == g


def test_like_plain_winnowing():
    """Of every window the least hash, the rightmost on ties, with few different characters and so many ties."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("aab", k=rng.randrange(K, 90))) for _ in range(200)] + ["é" * 5000, "".join(rng.choices("abcdefgh日", k=50_000))]
    for text, rows in zip(texts, winnow.prints(texts, K, W)):
        hashes = winnow._rolled(np.frombuffer(text.encode("utf-32-le"), np.uint32), K)[: len(text) - K + 1].tolist()
        kept = {max((j for j in range(i, min(i + W, len(hashes))) if hashes[j] == min(hashes[i : i + W]))) for i in range(max(1, len(hashes) - W + 1))}
        assert [(int(h), int(p)) for h, p in rows] == [(hashes[p], p) for p in sorted(kept)]


def test_rightmost_on_ties():
    (rows,) = winnow.prints(["a" * 30], K, W)
    assert rows[:, 1].tolist() == list(range(W - 1, 30 - K + 1))


def test_next_text(spark):
    rng = random.Random(7)
    rows = [(i * 3, "".join(rng.choices("abcdefgh ", k=rng.choice([0, 3, 50, 400])))) for i in range(700)]
    rows += [(None, "null key"), (5000, None), (5001, rows[0][1]), (9000, "same"), (9000, "same")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, fingerprint int").repartition(5)
    got = winnow.compare_with_next(docs, k=K, w=W).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    after = {a[0]: (a[1] or "", b[1] or "") for a, b in zip(order, order[1:] + order[:1])}
    for r in got:
        text, follow = after[r.doc_id]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follow[:cut]
        if r.doc_id != 9000:
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert bytes(r.fingerprint) == winnow.prints([text], K, W)[0].tobytes()
            assert r.near_edited == winnow.likeness(*winnow.prints([text, edited], K, W))
            assert bytes(r.edited_fingerprint) == winnow.prints([edited], K, W)[0].tobytes()
            assert r.near_next == winnow.likeness(*winnow.prints([text, follow], K, W))
    assert winnow.compare_with_next(docs.limit(0)).collect() == []
    assert winnow.fingerprint(docs.select("doc_id", "text")).where("octet_length(fingerprint) % 8 <> 0").count() == 0
