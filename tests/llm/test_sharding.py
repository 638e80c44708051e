import random
import zlib
from collections import Counter, defaultdict

from ridgeline.llm import sharding
from ridgeline.llm.queries import op4_sharding


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            r, i = min(fits)
            rooms[i] -= s
        else:
            rooms.append(max(capacity, s) - s)
    return rooms


def test_like_plain_best_fit():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(120))]
        table = sorted(Counter(sizes).items(), reverse=True)
        plan = sharding.pack(table, 50)
        used = Counter()
        for s, a, b, first, each in plan:
            for r in range(b - a):
                used[first + r // each] += s
        assert sorted(50 - u for u in used.values()) == sorted(plain_best_fit(sizes, 50))
        assert sum(p[2] - p[1] for p in plan) == len(sizes)


def test_query(spark):
    rows = op4_sharding(spark, "/root/testdata/sf0.001").collect()
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r)
    assert len(by_shard) == 16
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert len({r.doc_id for r in rows}) == len(rows)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    shard_of, loads = {}, Counter()
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert shard_of.setdefault(docs[r.doc_id], r.shard) == r.shard
        loads[r.shard] += r.size
    groups = Counter()
    for text in docs.values():
        groups[text] += len(text.encode()) + 1
    sizes, n_alone = sorted(groups.values(), reverse=True), 0
    while sizes[0] * (16 - n_alone) > sum(sizes):
        sizes, n_alone = sizes[1:], n_alone + 1
    assert max(sorted(loads.values(), reverse=True)[n_alone:]) <= 1.01 * max(sum(sizes) / (16 - n_alone), sizes[0])


def test_equal_groups_need_one_run_and_names_may_clash(spark):
    assert len(sharding.pack([(7, 40_000)], 24)) <= 2
    rows = [(i % 3, 7, i // 2, "x", i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, size long, same long, shard string, slot long")
    got = sharding.shard(df, "doc_id", "size", "same", capacity=28).collect()
    assert len(got) == 400 and Counter(Counter(r.shard for r in got).values()) == {4: 100}
    got = sharding.shard(df, "slot", "size", "same", shards=3).collect()
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert [sorted(v) for v in by_shard.values()] == [list(range(len(v))) for v in by_shard.values()]


def test_edges(spark):
    rows = [(1, 5, "a"), (1, 5, "a"), (2, 9, None), (3, 10_000_000, "big"), (4, 1, "b")]
    df = spark.createDataFrame(rows, "doc_id long, size long, same string").selectExpr("doc_id", "size", "coalesce(same, '') same", "1 as rank")
    got = sharding.shard(df, "doc_id", "size", "same", capacity=12).collect()
    assert len(got) == 5 and len({r.shard for r in got if r.same == "a"}) == 1
    assert [r.slot for r in got if r.same == "big"] == [0]
    assert sharding.shard(df.limit(0), "doc_id", "size", "same", shards=3).collect() == []


def loads_of(table, shards):
    plan, ranks, loads = sharding.pack_into(table, shards), defaultdict(list), [0] * shards
    for s, a, b, first, each in plan:
        for r in range(b - a):
            loads[first + r // each] += s
        ranks[s] += range(a, b)
    assert all(sorted(ranks[s]) == list(range(n)) for s, n in table) and len(ranks) == len(table)
    return loads


def test_group_of_a_third_leaves_the_other_shards_even(spark):
    rng = random.Random(3)
    small = [rng.randrange(50, 150) for _ in range(3000)]
    third = sum(small) // 2
    for large in ([third], [third, third], [third, sum(small) // 10]):
        loads = sorted(loads_of(sorted(Counter([*small, *large]).items(), reverse=True), 16), reverse=True)
        even = sum(small) / (16 - len(large))
        assert loads[: len(large)] == large
        assert all(0.97 * even <= x <= 1.03 * even for x in loads[len(large) :])
    rows = [(0, third, "hot")] + [(i + 1, s, str(i)) for i, s in enumerate(small)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, size long, same string"), "doc_id", "size", "same", shards=16).collect()
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert len(got) == len(rows) and len(loads) == 16 and min(loads.values()) >= 0.97 * sum(small) / 15


def test_shards_near_brute_force():
    def least(sizes, loads):
        """The least possible largest load."""
        if not sizes:
            return max(loads)
        return min(least(sizes[1:], sorted([*loads[:i], loads[i] + sizes[0], *loads[i + 1 :]])) for i in range(len(loads)))

    rng = random.Random(5)
    for _ in range(40):
        small = [rng.randrange(1, 20) for _ in range(7)]
        loads = sorted(loads_of(sorted(Counter([*small, sum(small)]).items(), reverse=True), 4))
        assert loads[-1] == sum(small) and loads[-2] <= 11 / 9 * least(sorted(small, reverse=True), [0, 0, 0]) + 6
    assert loads_of([(5, 2)], 4) == [5, 5, 0, 0] and loads_of([], 3) == [0, 0, 0]
