"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Two lines of at least LEAST characters are linked if at most EDITS edits tell them apart; shorter ones only if they are
equal, since two edits there join different words. Linked lines are one class, with the lines that links reach from them.

0. Most lines are like no other one. So lines first meet by few coarse keys (`coarse_keys`), which two near lines can't help
   sharing; only lines that share one with a different line go on.
1. A line is split into EDITS + 1 segments of even length; a line within EDITS edits holds one of them unchanged, at a
   place that the number of edits bounds. So each line puts its segments into an index, keyed by its length, the segment's
   number and its characters, and each line probes, for each length up to EDITS shorter than its own, the substrings at
   the few places where that segment can stand. Lines under keys that at most MEET lines share meet in pairs, once for all keys of the same lines.
2. Lines under other keys are split anew, into more segments (FINER): edits touch at most EDITS of them, so all others
   agree, and a key is all of those at once. Every near pair of such lines shares a finer key too, so nothing is lost, and
   keys cover more and more of the line until only lines that are alike nearly everywhere share one.
3. Under keys that many lines share even then, all lines are compared with the key's first line; keys whose lines those
   links connect are done. What is left meets in pairs of lines that no links connect so far and whose letters, and couples of
   letters, differ by no more than EDITS edits can change: of lines that are alike but for a word, few pairs are left.
4. Lines that meet must hold all but EDITS of SCREEN segments about where they should, and lose what they begin and end
   with alike; what is left is verified by banded bit-parallel edit distance: a column of the band is a few bits of an integer.

What goes: of a class, every later line in a document; and every line of a document but the class's first one, unless the
two documents are of one text: equal texts are one family, whose documents lose the same lines, and stay alike for the
near-duplicate operators to find. However much of a document such lines are, they go. Lines of white space alone stay.

Lines end at newlines and may be of any length. Null texts stay null, with no lines. Lines are told apart by 96
bits of hashes. Rows whose ids repeat or are null are documents of their own, ordered by id (nulls last) and text. Repeated
rows are of one text, so the later ones stay. Other columns stay as they are; columns called n_lines or n_removed
are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Scratch, numbered
from ridgeline.llm.graph import components

EDITS, LEAST = 2, 20
MEET, FINER = 24, (6, 12)
#: Segments by which lines that meet are screened; rows of a table that is sent to all tasks.
SCREEN, SENT = 12, 1_000_000


def coarse_keys(rows: DataFrame, edits: int) -> DataFrame:
    """rows (line, n, and others) once for each key: two lines within `edits` edits share one.

    Lengths fall into classes at least edits + 1 wide, and a line stands in its own and in that of a length greater by `edits`, so near
    lines share a class. A class fixes edits + 1 zones: the line's beginning, its end, and zones between, each with edits - 1
    characters to spare on its right. One of them, with those, is touched by no edit. If it is the beginning or the end, that is a common
    key. Else both of these are touched, so a zone between moves by edits - 1 at most: forwards it is found by the other
    line's moved keys, backwards the other line's own zone is found by this one's."""
    width = lambda n: f"shiftleft(1, greatest(length(bin({n})) - 3, {edits.bit_length()}))"
    rows = rows.withColumns({f"_w{i}": F.expr(f"cast(n + {k} - (n + {k}) % {width(f'n + {k}')} as int)") for i, k in enumerate((0, edits))})
    dealt = rows.select(*[c for c in rows.columns if c[0] != "_"], F.explode(F.expr("if(_w0 = _w1, array(_w0), array(_w0, _w1))")).alias("_w"))
    dealt = dealt.withColumn("_s", F.expr(f"cast(greatest(0, (_w - {edits} - {(edits - 1) ** 2}) div {edits + 1}) as int)"))
    begins = [(0, "0"), (edits, "n - _s"), *((i, f"_s + {i - 1} * (_s + {edits - 1}) + {move}") for i in range(1, edits) for move in range(edits))]
    keys = F.array(*[F.xxhash64("_w", F.lit(i), F.expr(f"substring(line, cast({b} + 1 as int), _s)")) for i, b in begins])
    return dealt.select(*[c for c in dealt.columns if c[0] != "_"], F.explode(keys).alias("key"))


def _marked(rows: DataFrame, edits: int) -> DataFrame:
    """id, key, own: the keys under which each line of rows (id, line, n) stands in the index (own), and the further ones that it probes.

    A line's own keys are among its probes. Keys that a line has no room for are left out. Begins and lengths of the
    segments are columns of their own: inside the keys' expressions they would make code too large to be compiled well."""
    parts, keys, own = edits + 1, [], []
    rows = rows.withColumns({f"{c}{k}": F.expr(e) for k in range(parts) for c, e in (("s", f"cast((n - {k}) div {parts} as int)"), ("r", f"cast((n - {k}) % {parts} as int)"))})
    # Segments of a length that doesn't divide: the last ones are longer by one.
    rows = rows.withColumns({f"{c}{k}_{i}": F.expr(e) for k in range(parts) for i in range(parts) for c, e in (("b", f"s{k} * {i} + greatest(0, r{k} - {parts - i})"), ("m", f"s{k} + cast(r{k} >= {parts - i} as int)"))})
    for k in range(parts):  # characters fewer than the line's own
        for i in range(parts):
            # Left of the segment at most i edits, right of it at most edits - i: its place moves by -i to i, and by k - (edits - i) to k + (edits - i).
            # Of two lines of one length each probes the other, and what moves back in one moves on in the other.
            for move in range(max(-i, k - (edits - i)) if k else 0, min(i, k + (edits - i)) + 1):
                key = F.xxhash64(F.col("n") - k, F.lit(i), F.expr(f"substring(line, b{k}_{i} + {move + 1}, m{k}_{i})"))
                if k == move == 0:
                    own.append(len(keys))
                else:
                    key = F.when(F.expr(f"b{k}_{i} + {move} >= 0 and b{k}_{i} + {move} + m{k}_{i} <= n"), key)
                keys.append(key)
    rows = rows.select("id", *[key.alias(f"k{j}") for j, key in enumerate(keys)])
    return rows.select("id", F.posexplode(F.array(*[f"k{j}" for j in range(len(keys))])).alias("_at", "key")).where("key is not null").select("id", "key", F.col("_at").isin(own).alias("own"))


def moves(edits: int, parts: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """All (characters fewer, ((segment, move), ...)): where the untouched segments of a line can stand in one within `edits` edits.

    Edits change the place of what follows only in the segments that they touch. Of two lines of one length each probes the
    other, so the moves that begin backwards are left out."""
    out = {}
    for touched in combinations(range(parts), edits):
        for fewer in range(edits + 1):
            for inner in product(range(-edits, edits + 1), repeat=edits - 1):
                path = (0, *inner, fewer)
                if sum(abs(a - b) for a, b in zip(path, path[1:])) <= edits and (fewer or next((s for s in path if s), 0) >= 0):
                    out[fewer, tuple((i, path[sum(t < i for t in touched)]) for i in range(parts) if i not in touched)] = None
    return list(out)


def _finer(rows: DataFrame, edits: int, parts: int) -> DataFrame:
    """Like _marked, with keys of all the segments that `edits` edits leave untouched, out of `parts`.

    Each segment is hashed once at each place, in a table; the ways to choose and move them are rows of a constant array of places in that table."""
    width = 2 * edits + 1
    ways = ", ".join(f"struct({fewer} as k, {'true' if fewer == 0 and not any(m for _, m in kept) else 'false'} as own, array({', '.join(str((fewer * parts + i) * width + m + edits) for i, m in kept)}) as at)" for fewer, kept in moves(edits, parts))
    k, i, m = f"(x div {parts * width})", f"(x div {width} % {parts})", f"(x % {width} - {edits})"
    begin, size = f"((n - {k}) div {parts} * {i} + greatest(0, (n - {k}) % {parts} - ({parts} - {i})) + {m})", f"((n - {k}) div {parts} + cast((n - {k}) % {parts} >= {parts} - {i} as int))"
    table = F.expr(f"transform(sequence(0, {(edits + 1) * parts * width - 1}), x -> if({begin} >= 0 and {begin} + {size} <= n, xxhash64({i}, substring(line, cast({begin} + 1 as int), cast({size} as int))), null))")
    # Dealt in all parts, as the lines are few and their keys many.
    dealt = rows.select("id", "line", "n").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").select("id", "n", table.alias("h"))
    keys = f"transform(array({ways}), w -> struct(if(forall(w.at, j -> get(h, j) is not null), xxhash64(n - w.k, {parts}, transform(w.at, j -> get(h, j))), null) as key, w.own as own))"
    return dealt.select("id", F.expr(f"inline({keys})")).where("key is not null").select("id", "key", "own")


def edit_distance(x: Column, y: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters by bits, if it is at most `edits` (else some greater number). Their sizes must differ by no more than `edits`.

    The band holds 2 edits + 1 cells of each column; a bit of VP or VN says that a cell is greater or less than the one
    above it. The distance is followed down the band's lower edge, and from the last row on along that row."""
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << width - 1
    m, n = F.size(y), F.size(x)
    both = lambda f, g: F.element_at(F.transform(F.array(f), g), 1)  # noqa: E731  g with the value of f, worked out once

    def step(s: Column, j: Column) -> Column:
        seen = F.get(x, j - 1)
        match = F.lit(0)
        for b in range(width):
            match = match.bitwiseOR(F.when(F.get(y, F.greatest(j + (b - edits - 1), F.lit(-1))) == seen, 1 << b).otherwise(0))
        known = lambda e: (((e.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(e).bitwiseOR(s["vn"])).bitwiseAND(F.lit(full))

        def rest(d: Column) -> Column:
            hp = s["vn"].bitwiseOR(F.lit(full).bitwiseXOR(d.bitwiseOR(s["vp"])))
            hn = d.bitwiseAND(s["vp"])
            down = F.shiftright(d, 1)
            past = j + edits - m  # rows that the band reaches below the last one
            row = F.element_at(F.array(*[F.lit(1 << width - 1 - p) for p in range(width)]), F.least(F.greatest(past, F.lit(0)), F.lit(width - 1)) + 1)
            more = F.when(past <= 0, F.when(d.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)).otherwise(F.when(hp.bitwiseAND(row) != 0, 1).when(hn.bitwiseAND(row) != 0, -1).otherwise(0))
            return F.struct(hn.bitwiseOR(F.lit(full).bitwiseXOR(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["far"] + more).alias("far"))

        return both(both(match, known), rest)

    start = F.struct(F.lit(full & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.least(F.lit(edits), m).alias("far"))
    return F.when(n == 0, m).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step, lambda s: s["far"]))


def _windows(pairs: DataFrame, edits: int) -> DataFrame:
    """pairs (a_line, b_line, a_n, b_n), and what is left between their common beginnings and ends: x and y, characters each."""
    steps = F.lit([1 << i for i in range(30, -1, -1)])  # of a doubling search
    grow = lambda same: F.aggregate(steps, F.lit(0), lambda p, s: F.when(p + s > F.least("a_n", "b_n"), p).when(same(p, s), p + s).otherwise(p))
    begin = grow(lambda p, s: F.substring("a_line", p + 1, s) == F.substring("b_line", p + 1, s))
    end = grow(lambda p, s: F.substring("a_line", F.col("a_n") - p - s + 1, s) == F.substring("b_line", F.col("b_n") - p - s + 1, s))
    pairs = pairs.withColumns({"_begin": begin, "_end": end})
    pairs = pairs.withColumn("_end", F.least("_end", F.least("a_n", "b_n") - F.col("_begin")))
    left = lambda c: F.regexp_extract_all(F.substring(f"{c}_line", F.col("_begin") + 1, F.col(f"{c}_n") - F.col("_begin") - F.col("_end")), F.lit("(?s)(.)"))
    return pairs.withColumns({"x": left("a"), "y": left("b")})


def _screened(edits: int, parts: int = SCREEN) -> Column:
    """Whether enough of b's segments stand about where they should in a: near lines pass, as edits touch at most `edits` segments."""
    m = f"(b_n div {parts} + cast(i < b_n % {parts} as int))"
    at = f"(i * (b_n div {parts}) + least(i, b_n % {parts}))"
    piece = f"substring(b_line, cast({at} + 1 as int), cast({m} as int))"
    around = f"substring(a_line, cast(greatest(1, {at} + 1 - {edits}) as int), cast({m} + {edits} + least({at}, {edits}) as int))"
    return F.expr(f"aggregate(sequence(0, {parts - 1}), 0, (bad, i) -> if(bad > {edits}, bad, if(contains({around}, {piece}), bad, bad + 1))) <= {edits}")


def _verified(pairs: DataFrame, texts: DataFrame, edits: int, scratch: Scratch) -> DataFrame:
    """u, v: the pairs (a, b) of lines that are near. texts: id, line, n."""
    named = lambda c: texts.select(F.col("id").alias(c), F.col("line").alias(f"{c}_line"), F.col("n").alias(f"{c}_n"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(named("a"), "a").join(named("b"), "b").where(_screened(edits)).repartition(parts, "a", "b")
    # The distance is a column that is written: a filter by it would be pushed below what it is worked out from, and carry that along.
    told = scratch.write(_windows(both, edits).select(F.col("a").alias("u"), F.col("b").alias("v"), edit_distance(F.col("x"), F.col("y"), edits).alias("d")), "told")
    near = scratch.write(told.where(F.col("d") <= edits).select("u", "v"), "near")
    scratch.drop(told)
    return near


def _once(held: DataFrame, most: int | None = None) -> DataFrame:
    """held without the keys that hold the same lines as another one, as their pairs are the same; most: and of at most so many lines."""
    sizes = held.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_m"), F.sum(F.xxhash64("id", "own").cast("decimal(38,0)")).alias("_who"))
    sizes = sizes if most is None else sizes.where(F.col("_m") <= most)
    return held.join(sizes.groupBy("_m", "_who").agg(F.min("_key").alias("_key")).select("_key"), F.col("key") == F.col("_key"), "left_semi")


def _letters(texts: DataFrame) -> DataFrame:
    """id, letters, couples: which of 64 classes of characters, and of couples of them, stand in the line an odd number of times. An edit changes 2 of letters at most, and 4 of couples."""
    odd = lambda hashed: F.aggregate(hashed, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))))
    chars = texts.select("id", F.regexp_extract_all("line", F.lit("(?s)(.)")).alias("c"))
    return chars.select("id", odd(F.transform("c", lambda x: F.xxhash64(x))).alias("letters"), odd(F.transform("c", lambda x, i: F.xxhash64(x, F.get("c", i + 1)))).alias("couples"))


def _in_pairs(held: DataFrame, also: str = "true") -> DataFrame:
    """also: what else must hold of two lines, by further columns of held (a_ and b_ before their names)."""
    # Of two lines that both stand in the index under the key the lesser one probes.
    more = [c for c in held.columns if c not in ("key", "id", "own")]
    side = lambda s: ["key", F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in more]]
    left, right = held.where("own").select(*side("a")), held.select(*side("b"), "own")
    return left.join(right, "key").where(f"(a < b or a > b and not own) and {also}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_lines(rows: DataFrame, edits: int = EDITS, meet: int = MEET, finer: tuple[int, ...] = FINER) -> DataFrame:
    """rows: id long (a hash of the line), more int (another one), line, n (its characters). Returns node, more, root: classes of linked lines; lines without a link are not in it.

    Coarse keys are first aggregated to those that different lines share, with partial results before the shuffle, so a line that
    many documents repeat counts once for each task; only lines with such keys go on."""
    scratch = Scratch(rows.sparkSession)
    first = F.min(F.struct("line", "more", "n")).alias("_l")  # of two lines of one hash the lesser is linked
    coarse = coarse_keys(rows, edits)
    shared = scratch.write(coarse.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select(F.col("key").alias("_key")), "coarse")
    if shared.count() <= SENT:
        some = coarse.join(F.broadcast(shared), F.col("key") == F.col("_key"), "left_semi")
    else:
        wanted = scratch.write(coarse.select("key", "id").join(shared, F.col("key") == F.col("_key")).select(F.col("id").alias("_id")).distinct(), "wanted")
        some = rows.join(_sent(wanted), F.col("id") == F.col("_id"), "left_semi")
    texts = scratch.write(some.groupBy("id").agg(first).select("id", "_l.line", "_l.more", "_l.n"), "lines")
    scratch.drop(*[t for t, _ in scratch.paths if t is not texts])
    marked, near, crowded = _marked(texts, edits), [], None
    for parts in (0, *finer):
        few = None
        if parts:  # the lines of the keys that too many share, once each
            few = scratch.write(crowded.select(F.col("id").alias("_id")).distinct(), "few")
            scratch.drop(crowded)
            marked = scratch.write(_finer(texts.join(few, F.col("id") == F.col("_id"), "left_semi"), edits, parts), "finer")
        shared = scratch.write(marked.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select(F.col("key").alias("_key")), "keys")
        held = scratch.write(marked.join(_sent(shared), F.col("key") == F.col("_key")).select("key", "id", "own").distinct(), "segments")
        scratch.drop(few, marked, shared)
        busy = scratch.write(held.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > meet).select("_key"), "busy")
        crowded = scratch.write(held.join(busy, F.col("key") == F.col("_key"), "left_semi"), "crowded")
        once = scratch.write(_once(held, meet), "once")
        pairs = scratch.write(_in_pairs(once), "pairs")
        scratch.drop(held, busy, once)
        near.append(_verified(pairs, texts, edits, scratch))
        scratch.drop(pairs)
        if crowded.isEmpty():
            break
    else:
        first = crowded.where("own").groupBy(F.col("key").alias("_key")).agg(F.min("id").alias("a"))
        star = scratch.write(crowded.join(first, F.col("key") == F.col("_key")).where("a <> id").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct(), "stars")
        near.append(_verified(star, texts, edits, scratch))
        roots = scratch.write(components(_union(near)), "roots")
        placed = scratch.write(crowded.join(roots, F.col("id") == F.col("node"), "left").select("key", "id", "own", F.coalesce("root", "id").alias("root")), "placed")
        apart = placed.groupBy(F.col("key").alias("_key")).agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("_key")
        once = scratch.write(_once(placed.join(apart, F.col("key") == F.col("_key"), "left_semi")), "once")
        left = scratch.write(once.select(F.col("id").alias("_id")).distinct(), "left")
        letters = scratch.write(_letters(texts.join(left, F.col("id") == F.col("_id"), "left_semi")), "letters")
        also = f"a_root <> b_root and bit_count(a_letters ^ b_letters) <= {2 * edits} and bit_count(a_couples ^ b_couples) <= {4 * edits}"
        pairs = scratch.write(_in_pairs(once.join(letters, "id"), also).join(star, ["a", "b"], "left_anti"), "pairs")
        scratch.drop(star, placed, roots, once, left, letters)
        near.append(_verified(pairs, texts, edits, scratch))
        scratch.drop(pairs)
    found = components(_union(near))
    told = scratch.write(found.join(texts.select("id", "more"), F.col("node") == F.col("id")).select("node", "more", "root"), "classes")
    scratch.drop(crowded, texts, *near)
    return told


def _sent(some: DataFrame) -> DataFrame:
    """A written table of hashes, sent to all tasks if it has at most SENT rows (16 bytes each); else it is joined by a shuffle."""
    return F.broadcast(some) if some.count() <= SENT else some


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """docs with the lines removed from `text`, and n_lines and n_removed long."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = numbered(docs.select(*[F.col(f"`{c}`") for c in names]), key, text)
    parts = docs.where(F.col(f"`{text}`").isNotNull()).select("_doc", F.split("_text", "\n", -1).alias("parts"))
    own = parts.select(F.explode("parts").alias("line")).withColumn("n", F.char_length("line")).where(F.col("n") >= least)
    scratch = Scratch(docs.sparkSession)
    marks = lambda d: d.withColumns({"id": F.xxhash64("line"), "more": F.hash("line")})
    roots = near_lines(marks(own).select("id", "more", "line", "n"), edits)
    every = parts.select("_doc", F.posexplode("parts").alias("no", "line")).where(F.btrim("line", F.lit(" \t\n\x0b\f\r")) != "")
    plain = marks(every).select("_doc", "no", "id", "more", F.char_length("line").alias("n"))
    roots = roots.select("node", "root", F.col("more").alias("_more"))
    rows = plain.join(roots, (F.col("n") >= least) & (F.col("id") == F.col("node")) & (F.col("more") == F.col("_more")), "left")
    rows = scratch.write(rows.select("_doc", "no", F.coalesce("root", "id").alias("class"), F.when(F.col("root").isNull(), F.col("more")).alias("more")), "classes")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    firsts = rows.groupBy(F.col("class").alias("_class"), F.col("more").alias("_more")).agg(F.count(F.lit(1)).alias("_n"), F.min("_doc").alias("first_doc")).where("_n > 1").drop("_n")
    # What grows with the documents is dealt at every size, so that what is shuffled grows with the input.
    held = scratch.write(rows.join(firsts.hint("merge"), (F.col("class") == F.col("_class")) & same("more", "_more")).select("_doc", "no", "class", "more", "first_doc"), "held")
    scratch.drop(rows)
    within = held.groupBy(F.col("_doc").alias("_d"), F.col("class").alias("_c"), F.col("more").alias("_e")).agg(F.count(F.lit(1)).alias("_n"), F.min("no").alias("first_no")).where("_n > 1").drop("_n")
    # Families: documents of one text, called by the first one.
    texts = scratch.write(docs.where(F.col(f"`{text}`").isNotNull()).select("_doc", F.sha2("_text", 256).alias("_sha")), "shas")
    lows = texts.groupBy("_sha").agg(F.min("_doc").alias("family"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    families = scratch.write(texts.join(lows, "_sha").select(F.col("_doc").alias("member"), "family"), "families")
    of = lambda d, f: families.select(F.col("member").alias(d), F.col("family").alias(f))
    judged = held.join(of("_m1", "f1"), F.col("_doc") == F.col("_m1"), "left").join(of("_m2", "f2"), F.col("first_doc") == F.col("_m2"), "left")
    judged = judged.join(within.hint("merge"), (F.col("_doc") == F.col("_d")) & (F.col("class") == F.col("_c")) & same("more", "_e"), "left")
    gone = (F.col("no") > F.coalesce("first_no", F.lit(1 << 30))) | (F.coalesce("f1", "_doc") != F.coalesce("f2", "first_doc"))
    out = scratch.write(judged.where(gone).groupBy(F.col("_doc").alias("_of")).agg(F.sort_array(F.collect_set("no")).alias("_gone")), "gone")
    scratch.drop(held, texts, families)
    both = docs.join(out.hint("merge"), F.col("_doc") == F.col("_of"), "left")
    ends = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.size(F.split("_text", "\n", -1))))
    n_lines = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(F.split("_text", "\n", -1)))
    both = both.withColumn("_ends", ends).withColumn("_parts", F.when(F.col("_gone").isNotNull(), F.split("_text", "\n", -1)))
    kept = F.transform(F.sequence(F.lit(0), F.size("_gone")), lambda i: F.slice("_parts", F.get("_ends", i) + 2, F.get("_ends", i + 1) - F.get("_ends", i) - 1))
    columns = [F.when(F.col("_gone").isNotNull(), F.array_join(F.flatten(kept), "\n")).otherwise(F.col(f"`{text}`")).alias(text) if c == text else F.col(f"`{c}`") for c in names]
    return both.select(*columns, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
