"""Sharding by best-fit-decreasing bin packing.

Rows that must stay together form a group; groups go, largest first, into the open shard with the tightest remaining
capacity that holds them. Groups of one size are interchangeable, so packing needs only how many groups there are of
each size: that histogram comes from an aggregation and is bounded by the number of sizes told apart (exact up to
EXACT bytes, above that rounded up to 12 significant bits, so a few million at most), never by the rows. The open shards
stand in a balanced tree by remaining capacity; the tightest one keeps being the tightest until a size no longer fits,
so all groups of a size take few steps. The plan says which ranks within a size go to which shard, as runs: `each` groups
to one shard, as many to the next, and so on. Ranks and slots are numbered on the executors.

Sizes above EXACT are packed as if they were larger by less than one part in 4096, so with a number of shards the fullest
is larger by no more than that share of its bytes than exact sizes would make it, and a capacity is never exceeded.

Columns called shard or slot are replaced. Null texts count as empty ones; a null group is a group. Repeated rows stay in one group and get different slots. A group larger than the
capacity gets a shard of its own (fixed capacity); with a fixed number, so does a group larger than an even share of what
is left beside those that are larger still. An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import number_rows, write_out

EXACT = 1 << 20


@dataclass(slots=True)
class _Node:
    room: int
    shard: int
    height: int = 1
    left: _Node | None = None
    right: _Node | None = None


class RoomTree:
    """Shards in an AVL tree by (remaining capacity, shard)."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    @staticmethod
    def _tall(n: _Node | None) -> int:
        return n.height if n else 0

    def _fix(self, n: _Node) -> _Node:
        lean = self._tall(n.left) - self._tall(n.right)
        if lean > 1:
            if self._tall(n.left.left) < self._tall(n.left.right):
                n.left = self._turn(n.left, "right", "left")
            return self._turn(n, "left", "right")
        if lean < -1:
            if self._tall(n.right.right) < self._tall(n.right.left):
                n.right = self._turn(n.right, "left", "right")
            return self._turn(n, "right", "left")
        n.height = 1 + max(self._tall(n.left), self._tall(n.right))
        return n

    def _turn(self, n: _Node, up: str, down: str) -> _Node:
        """The child on side `up` takes the place of n."""
        child = getattr(n, up)
        setattr(n, up, getattr(child, down))
        n.height = 1 + max(self._tall(n.left), self._tall(n.right))
        setattr(child, down, n)
        child.height = 1 + max(self._tall(child.left), self._tall(child.right))
        return child

    def add(self, room: int, shard: int) -> None:
        def put(n: _Node | None) -> _Node:
            if n is None:
                return _Node(room, shard)
            if (room, shard) < (n.room, n.shard):
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return self._fix(n)

        self.root = put(self.root)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the shard of least room that still holds `size`."""
        best, n = None, self.root
        while n:
            if n.room >= size:
                best, n = n, n.left
            else:
                n = n.right
        if best is None:
            return None
        key = (best.room, best.shard)

        def out(n: _Node, key: tuple[int, int]) -> _Node | None:
            if key < (n.room, n.shard):
                n.left = out(n.left, key)
            elif key > (n.room, n.shard):
                n.right = out(n.right, key)
            elif n.left is None or n.right is None:
                return n.left or n.right
            else:
                least = n.right
                while least.left:
                    least = least.left
                n.room, n.shard = least.room, least.shard
                n.right = out(n.right, (least.room, least.shard))
            return self._fix(n)

        self.root = out(self.root, key)
        return key


def pack(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int, int]] | None:
    """Best fit, decreasing: runs (size, first rank, end rank, first shard, each). None if more than `most` shards would be needed.

    sizes: (size, number of groups), sizes falling. Of a run the rank r goes to shard first shard + (r - first rank) // each."""
    tree, plan, opened = RoomTree(), [], 0
    if most is not None:
        for shard in range(most):
            tree.add(capacity, shard)
        opened = most
    for size, n in sizes:
        rank = 0
        while rank < n:
            if (found := tree.take_tightest(size)) is None:
                if most is not None:
                    return None
                found = (max(capacity, size), opened)
                opened += 1
            room, shard = found
            fit = min(n - rank, room // size)
            if plan and (last := plan[-1])[0] == size and fit <= last[4] and (last[2] - last[1]) % last[4] == 0 and shard == last[3] + (last[2] - last[1]) // last[4]:
                plan[-1] = (size, last[1], rank + fit, last[3], last[4])
            else:
                plan.append((size, rank, rank + fit, shard, fit))
            rank += fit
            tree.add(room - fit * size, shard)
    return plan


def alone(sizes: list[tuple[int, int]], shards: int) -> int:
    """How many groups, from the largest on, get a shard of their own: each is larger than an even share of what is left."""
    left, n_alone = sum(s * n for s, n in sizes), 0
    for size, n in sizes:
        for _ in range(n):
            if size * (shards - n_alone) <= left:
                return n_alone
            left, n_alone = left - size, n_alone + 1
    return n_alone


def pack_into(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """The packing into a given number of shards with the least capacity that a bisection finds.

    Groups larger than an even share stand alone, so that they raise the capacity of no other shard."""
    n_alone, own, rest, before = alone(sizes, shards), [], [], {}
    for size, n in sizes:
        single = min(n, n_alone - len(own))
        own += [(size, rank, rank + 1, len(own) + rank, 1) for rank in range(single)]
        before[size] = single
        if n > single:
            rest.append((size, n - single))
    first, shards = len(own), shards - len(own)
    if not rest:
        return own
    total = sum(s * n for s, n in rest)
    low = max(-(-total // shards), rest[0][0])
    high, plan = low, pack(rest, low, shards)
    while plan is None:
        low, high = high, high + max(1, high // 64)
        plan = pack(rest, high, shards)
    while high - low > max(1, total // shards // 4096):
        middle = (low + high) // 2
        if (better := pack(rest, middle, shards)) is None:
            low = middle
        else:
            high, plan = middle, better
    return own + [(size, a + before[size], b + before[size], first + shard, each) for size, a, b, shard, each in plan]


def shard(rows: DataFrame, key: str, size: str, group: str, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """Add shard int and slot long (gapless from 0 in each shard) to rows.

    size: a column of positive sizes; group: a column whose equal values stay together; either a number of shards of
    nearly equal size, or a fixed capacity whose shards are to be few."""
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = rows.sparkSession
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "slot") or c in (key, size, group)])
    taken = {c: f"_own_{c}" for c in ("shard", "slot") if c in rows.columns}  # columns so called that are asked for stand aside
    rows = rows.withColumnsRenamed(taken)
    key, size, group = (taken.get(c, c) for c in (key, size, group))
    same = F.struct(F.col(f"`{group}`"))
    groups = rows.groupBy(same.alias("_group")).agg(F.sum(f"`{size}`").alias("_bytes"))
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.col("_bytes"))) - 12).cast("long")
    weight = F.when(F.col("_bytes") <= EXACT, F.col("_bytes")).otherwise(F.ceil(F.col("_bytes") / unit) * unit).cast("long")
    groups, _ = write_out(groups.withColumn("_weight", weight), "groups")
    sizes = [(r[0], r[1]) for r in groups.groupBy("_weight").count().orderBy(F.desc("_weight")).toLocalIterator()]
    plan = pack_into(sizes, shards) if shards else pack(sizes, capacity)
    planned = spark.createDataFrame(plan, "_size long, _from long, _to long, _shard int, _each long")
    ranked = number_rows(groups, "_weight", ["_group"], "_rank")
    at = (F.col("_shard") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_each"))).cast("int")
    placed = ranked.join(planned, (F.col("_weight") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).select("_group", at.alias("shard"))
    dealt = rows.withColumn("_same", same).join(placed, F.col("_same") == F.col("_group")).drop("_group")
    parts = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // (shards or 64))
    return number_rows(dealt, "shard", [f"`{key}`", "_same"], "slot", parts=parts).drop("_same", *taken.values())
