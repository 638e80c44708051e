import random

import numpy as np
import pytest

from ridgeline.llm import repeats


def brute(texts, n=repeats.LENGTH):
    """texts in order -> kept bytes and number of removed runs."""
    seen, out = set(), []
    for data in texts:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - n + 1):
            w = data[i : i + n]
            if w in seen:
                gone[i : i + n] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((bytes(np.frombuffer(data, np.uint8)[~gone]), runs))
    return out


def corpus(rng):
    word = lambda: "".join(rng.choices("abcdé ", k=rng.randrange(1, 9)))
    say = lambda n: "".join(word() for _ in range(n))[:n]
    common = [say(k) for k in (60, 99, 100, 101, 160, 400)]
    texts = ["", "x" * 350, "ab" * 200, "x" * 99, "x" * 100]
    for _ in range(120):
        parts = [rng.choice([say(rng.randrange(120)), rng.choice(common), rng.choice(common)]) for _ in range(rng.randrange(7))]
        texts.append("".join(parts))
    near = say(900)
    for _ in range(30):
        at = rng.randrange(850)
        texts.append(near[:at] + say(rng.randrange(6)) + near[at + rng.randrange(6) :])
    return texts + texts[3:9] + [near, near]


def test_meeting_in_small_batches():
    """_meet tells the same however its rows are cut into batches."""
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted((rng.randrange(6), rng.randrange(3), rng.randrange(50), (k << 16) | 5) for k in range(80))
    rows += [(9, 1, 1, 1 << 16), (10, 1, 1, 1 << 16), (10, 2, 0, 1 << 16)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in range(4)], ["gram", "context", "doc", "span"])
    told = lambda parts: sorted(tuple(r.values()) for b in repeats._meet(iter(map(batch, parts))) for r in b.to_pylist())
    seen, want = set(), []
    several = {g for g in {r[0] for r in rows} if len({r[1] for r in rows if r[0] == g}) > 1}
    for g, c, d, s in rows:
        if (g, c) in seen:
            want.append((d, s >> 16, (s >> 16) + (s & 0xFF) + repeats.LENGTH, 0))
        elif g in several:
            want.append((d, s, g, 1))
        seen.add((g, c))
    for size in (1, 2, 3, 7, 100):
        assert told([rows[i : i + size] for i in range(0, len(rows), size)]) == sorted(want)


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_like_brute_force(spark, monkeypatch, hot):
    texts = corpus(random.Random(hot))
    rows = [(i * 2, t, "z") for i, t in enumerate(texts)] + [(10**6, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, hot=hot).collect()}
    assert len(got) == len(rows)
    for (i, text, _), (kept, runs) in zip(rows, brute([(t or "").encode() for _, t, _ in rows])):
        r = got[i]
        assert bytes(r.kept) == kept and r.n_spans == runs and r.n_bytes == len((text or "").encode()) and r.n_removed == r.n_bytes - len(kept)


def test_repeated_ids_and_empty(spark):
    text = "".join(map(str, range(60)))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert sorted(r.n_removed for r in repeats.remove_repeats(docs).collect()) == [0, len(text), len(text)]
    assert repeats.remove_repeats(docs.limit(0)).collect() == []


def test_intervals():
    rng = random.Random(1)
    for _ in range(200):
        common = np.array([0, *(rng.randrange(5) for _ in range(rng.randrange(1, 20)))])
        want = set()
        for i in range(len(common)):
            for j in range(i + 1, len(common)):
                n = common[i + 1 : j + 1].min()
                if n >= 2 and (i == 0 or common[i] < n) and (j + 1 == len(common) or common[j + 1] < n):
                    want.add((i, j, n))
        got = repeats.intervals(common, 2)
        assert len(got) == len(set(got)) and set(got) == want


def check_groups(texts, groups):
    """Every group has all places of its string; every window that repeats is in groups at each of its places."""
    data = [t.encode() for t in texts]
    own = {}
    for g in groups:
        own.setdefault((g.first_doc, g.first_begin, g.length), set()).add((g.doc, g.begin))
    covered = {}
    for (d, b, n), places in own.items():
        string = data[d][b : b + n]
        assert n >= repeats.LENGTH and len(string) == n
        want = {(i, k) for i, t in enumerate(data) for k in range(len(t) - n + 1) if t.startswith(string, k)}
        assert places == want and min(places) == (d, b) and len(places) > 1
        for e, k in places:
            covered.setdefault(e, set()).update(range(k, k + n - repeats.LENGTH + 1))
    windows = {}
    for i, t in enumerate(data):
        for k in range(len(t) - repeats.LENGTH + 1):
            windows.setdefault(t[k : k + repeats.LENGTH], []).append((i, k))
    for places in windows.values():
        if len(places) > 1:
            assert all(k in covered.get(i, ()) for i, k in places)


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_groups_have_all_occurrences(spark, hot):
    rng = random.Random(9)
    say = lambda n: "".join(rng.choices("abcdefghij", k=n))
    shared, other, whole = say(130), say(260), say(1000)
    texts = [say(200) + shared + say(200) for _ in range(6)] + [say(50) + other + shared + say(90) for _ in range(3)]
    texts += [whole, say(30) + other[:180], "x" * 99, "", whole, whole]
    groups = repeats.repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), hot=hot).collect()
    check_groups(texts, groups)
    assert sorted((g.doc, g.begin, g.length) for g in groups if g.first_doc == 9) == [(9, 0, 1000), (13, 0, 1000), (14, 0, 1000)]


def test_groups_of_a_corpus(spark):
    texts = [t for t in corpus(random.Random(11)) if len(t) < 300 and "xxx" not in t and "abababab" not in t][:60]
    groups = repeats.repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    check_groups(texts, groups)


def test_long_text_in_pieces(monkeypatch):
    """Runs of a text longer than PIECE cover each window once, under the k-gram that it has in the whole text."""
    import pyarrow as pa

    rng = random.Random(6)
    data = bytes(rng.choices(b"abcd", k=30_000))
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array([data.decode(), None, data[:777].decode()])], ["_doc", "_text"])
    whole = repeats.Hashed([data])
    pick = {w: q for a, b, q in zip(*(x.tolist() for x in whole.runs())) for w in range(a, b + 1)}
    monkeypatch.setattr(repeats, "PIECE", 777)
    got = {}
    for keys, texts, begins in repeats._chunks(iter([batch])):
        hashed = repeats.Hashed(texts)
        for a, b, q in zip(*(x.tolist() for x in hashed.runs())):
            i = int(np.searchsorted(hashed.ends, a, side="right"))
            if keys[i] == 7:
                for w in range(a, b + 1):
                    place = w - int(hashed.starts[i]) + int(begins[i])
                    assert place not in got
                    got[place] = q - int(hashed.starts[i]) + int(begins[i])
    assert got == pick


def test_picks_in_parts(monkeypatch):
    """A text longer than PLACES has the same runs as one picked at a time."""
    rng = random.Random(5)
    hashed = repeats.Hashed([bytes(rng.choices(b"abc", k=n)) for n in (3000, 0, 99, 100, 9000)])
    whole = hashed.runs()
    monkeypatch.setattr(repeats, "PLACES", 777)
    assert all((x == y).all() for x, y in zip(whole, hashed.runs()))
