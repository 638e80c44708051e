import random

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def within(a, b, edits):
    """Whether at most `edits` edits tell a and b apart: the plain recurrence, in a band."""
    if abs(len(a) - len(b)) > edits:
        return False
    row = {j: j for j in range(min(len(b), edits) + 1)}
    for i, x in enumerate(a):
        new = {}
        for j in range(max(0, i + 1 - edits), min(len(b), i + 1 + edits) + 1):
            new[j] = min(row.get(j, 99) + 1, new.get(j - 1, 99) + 1, row.get(j - 1, 99) + (j == 0 or x != b[j - 1])) if j else i + 1
        if min(new.values()) > edits:
            return False
        row = new
    return row[len(b)] <= edits


def brute(docs, edits, least):
    rows = [(d, i, x) for d, t in enumerate(docs) if t is not None for i, x in enumerate(t.split("\n")) if x.strip()]
    names = sorted({r[2] for r in rows})
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    long = [n for n in names if len(n) >= least]
    for i, a in enumerate(long):
        for b in long[i + 1 :]:
            if abs(len(a) - len(b)) <= edits and within(a, b, edits):
                root[find(a)] = find(b)
    first = {}
    for d, i, x in rows:
        first.setdefault(find(x), d)
    gone, met = set(), set()
    for d, i, x in rows:
        c = find(x)
        if (d, c) in met or docs[d] != docs[first[c]]:
            gone.add((d, i))
        met.add((d, c))
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in enumerate(docs)]


def mutate(rng, line, n):
    for _ in range(n):
        i = rng.randrange(len(line) + 1)
        line = rng.choice([line[:i] + "é" + line[i:], line[:i] + line[i + 1 :], line[:i] + "z" + line[i + 1 :]])
    return line


@pytest.mark.parametrize("edits", [1, 2])
def test_like_brute_force(spark, edits):
    rng = random.Random(edits)
    say = lambda n: "".join(rng.choices("abcdé ", k=n))
    common = [say(rng.randrange(6, 30)) for _ in range(12)]
    docs = [None, "", "\n", "a\n\nb", *("\n".join(mutate(rng, rng.choice(common), rng.choice([0, 0, 1, 2, 3])) if rng.random() < 0.6 else say(rng.randrange(25)) for _ in range(rng.randrange(1, 8))) for _ in range(70))]
    docs += [docs[9], docs[9]]
    table = spark.createDataFrame([(i, t, "k") for i, t in enumerate(docs)], "doc_id long, text string, n_lines string").repartition(3)
    got = lines.dedup_lines(table, edits=edits, least=5).collect()
    want = brute(docs, edits, 5)
    assert len(got) == len(docs)
    for r in got:
        assert r.text == want[r.doc_id]
        before, after = docs[r.doc_id], r.text
        assert r.n_lines == (0 if before is None else before.count("\n") + 1)


def test_no_python_and_edges(spark):
    docs = spark.createDataFrame([(1, "the same line of text\nthe same line of text", "x"), (1, "the same line of text", "x"), (None, None, "x")], "doc_id long, text string, lang string")
    got = lines.dedup_lines(docs)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    assert sorted((r.text or "", r.n_removed) for r in got.collect()) == [("", 0), ("", 2), ("the same line of text", 0)]
    clash = docs.withColumns({"n_removed": F.lit("x"), "no": F.lit(1), "class": F.lit(2), "first_doc": F.lit(3)})
    assert {(r.no, r["class"], r.first_doc) for r in lines.dedup_lines(clash).collect()} == {(1, 2, 3)}
    assert lines.dedup_lines(docs.limit(0)).collect() == []


def test_bit_parallel_distance(spark):
    rng = random.Random(7)
    pairs = [("", ""), ("a", ""), ("é😀", "😀")]
    for _ in range(1500):
        a = "".join(rng.choices("ab😀", k=rng.randrange(30)))
        pairs.append((a, mutate(rng, a, rng.randrange(5)) if rng.random() < 0.7 else "".join(rng.choices("ab😀", k=len(a)))))
    for edits in (1, 2, 3):
        own = [p for p in pairs if abs(len(p[0]) - len(p[1])) <= edits]
        chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)(.)"))
        got = spark.createDataFrame(own, "a string, b string").select("a", "b", lines.edit_distance(chars("a"), chars("b"), edits).alias("d")).collect()
        for r in got:
            d = edit_distance(r.a, r.b)
            assert (r.d == d) if d <= edits else r.d > edits, (r, d, edits)


@pytest.mark.parametrize("finer", [(6, 12), ()])
def test_crowded_keys_lose_no_link(spark, finer):
    """Variants of two lines, so that every key is shared by many; meet=1 sends all lines through every step."""
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdef ", k=n)) for n in (24, 60)]
    texts = sorted({mutate(rng, b, rng.choice([0, 1, 1, 2, 2, 3, 4, 6])) for b in base for _ in range(60)})
    rows = spark.createDataFrame([(i, i % 7, t, len(t)) for i, t in enumerate(texts)], "id long, more int, line string, n int").repartition(3)
    root = {r.node: r.root for r in lines.near_lines(rows, meet=1, finer=finer).collect()}
    want = list(range(len(texts)))

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            if edit_distance(a, texts[j]) <= 2:
                want[max(find(i), find(j))] = min(find(i), find(j))
    assert [root.get(i, i) for i in range(len(texts))] == [find(i) for i in range(len(texts))]


def test_what_goes(spark):
    """A passage of several lines goes from all but its first document, in however few; equal texts stay alike; a short line goes if it is equal."""
    say = lambda k, i: f"{k} words of its own number {i * 7919 % 10007} and {i * 104729 % 10007} here"
    passage = "\n".join(say("passage", i) for i in range(3))
    own = ["\n".join([*(f"{say(f'text {d}', i)} {d * 31} {'xyz'[d % 3] * 9}" for i in range(6)), "short", ""]) for d in range(4)]
    docs = [own[0] + passage, own[1] + passage, own[2], own[2], own[3].replace("xyz"[0] * 9, "changed words in a copy", 1), own[3]]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got[0] == (docs[0], 0)
    assert got[1] == (own[1].replace("\nshort", ""), 4) or got[1][1] == 4
    assert got[2] == (own[2].replace("\nshort", ""), 1) and got[3] == got[2]
    assert got[4][1] == 1 and got[5][1] == 6 and "changed" not in got[5][0]  # of an edited copy the edited line stays


@pytest.mark.parametrize("own", [111, 279])
def test_boilerplate_goes_however_much_it_is(spark, own):
    """Short pages under one header and footer keep what is their own."""
    rng = random.Random(own)
    head, foot = ("".join(rng.choices("abcdefghij ", k=97)) for _ in range(2))
    bodies = ["".join(rng.choices("klmnopqrst ", k=own)).strip() for _ in range(6)]
    docs = [(i, f"{head}\n{b}\n{foot}") for i, b in enumerate(bodies)]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: (docs[0][1], 0), **{i: (bodies[i], 2) for i in range(1, 6)}}


def test_very_long_line(spark):
    line = "".join(random.Random(2).choices("abcdefgh ", k=300_000))
    rest = "other words in this document, more than in the line?"
    docs = [(1, line), (2, line[:1000] + "#" + line[1000:] + "\n" + rest), (3, None)]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (line, 0), 2: (rest, 1), 3: (None, 0)}


def test_lines_of_one_hash(spark):
    """A second hash tells lines of one hash apart: only the lesser of them is linked."""
    rows = [(1, 10, "a line of some words 1", 22), (1, 11, "quite another line there", 24), (2, 12, "a line of some words 2", 22)]
    got = lines.near_lines(spark.createDataFrame(rows, "id long, more int, line string, n int"))
    assert sorted((r.node, r.more, r.root) for r in got.collect()) == [(1, 10, 1), (2, 12, 1)]


def test_keys_of_the_same_lines_meet_once(spark):
    """Lines that are alike nearly everywhere share many keys; their pairs are made once, and none is lost."""
    rows = [(key, line, True) for key in range(20) for line in (1, 2, 3)] + [(30, 3, True), (30, 4, False), (31, 4, True), (31, 5, True), (31, 5, False)]
    held = spark.createDataFrame(rows, "key long, id long, own boolean")
    once = lines._once(held)
    assert once.select("key").distinct().count() == 3
    assert {tuple(r) for r in lines._in_pairs(once).collect()} == {(1, 2), (1, 3), (2, 3), (3, 4), (4, 5)} == {tuple(r) for r in lines._in_pairs(held).collect()}


def near_pairs(texts, edits):
    return [(i, j) for i, a in enumerate(texts) for j in range(i) if within(a, texts[j], edits)]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_lines_share_keys(spark, edits):
    """Coarse keys, finer keys and the letters' bounds lose no near pair, of lines of all lengths; and a line has few coarse keys."""
    rng = random.Random(edits)
    base = ["".join(rng.choices("abc ", k=n)) for n in (6, 24, 31, 64, 130)]
    texts = sorted({mutate(rng, b, rng.randrange(edits + 2)) for b in base for _ in range(16)} - {""})
    rows = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "id long, line string, n int")
    near = near_pairs(texts, edits)
    assert len(near) > 20
    for keys in (lines.coarse_keys(rows, edits), *[lines._finer(rows, edits, parts) for parts in (6, 12) if edits < 3]):
        held = [set() for _ in texts]
        for r in keys.select("id", "key").collect():
            held[r.id].add(r.key)
        assert all(held[i] & held[j] for i, j in near)
    assert lines.coarse_keys(rows, 2).where("n >= 64").groupBy("id").count().agg(F.avg("count")).first()[0] < 6  # before, 11
    odd = {r.id: r for r in lines._letters(rows).collect()}
    apart = lambda i, j, c: ((odd[i][c] ^ odd[j][c]) & (1 << 64) - 1).bit_count()
    assert all(apart(i, j, "letters") <= 2 * edits and apart(i, j, "couples") <= 4 * edits for i, j in near)


def test_copies_but_for_a_word_do_not_all_meet(spark, monkeypatch):
    """Lines that share all keys but are not near: their pairs grow with the square of their number, and few are left to verify."""
    rng = random.Random(4)
    head, tail = ("".join(rng.choices("abcdefgh ", k=150)) for _ in range(2))
    texts = sorted({head + "".join(rng.choices("klmnopqrstuvwxyz", k=9)) + tail for _ in range(60)} | {head + "klmnopqrs" + tail, head + "klmnopq" + tail})
    met, verified = [], lines._verified

    def counted(pairs, *rest):
        met.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(lines, "_verified", counted)
    rows = spark.createDataFrame([(i, i, t, len(t)) for i, t in enumerate(texts)], "id long, more int, line string, n int")
    found = {r.node: r.root for r in lines.near_lines(rows).collect()}
    near = near_pairs(texts, 2)
    assert near and all(found[i] == found[j] for i, j in near) and set(found) == {i for p in near for i in p}
    assert sum(met) < 5 * len(texts)  # before, 62 * 61 / 2
