"""Exact substring dedup: maximal repeats from enhanced suffix arrays, over all documents.

A byte is removed if a string of LENGTH bytes covers it that also starts earlier (in a document of smaller id, or
earlier in the same one). Matches never cross documents; strings are judged on the input.

1. Anchors. Every window of LENGTH bytes picks the k-gram of least hash in it, the rightmost on ties. Equal windows pick
   equal k-grams at equal offsets, so all that matches meets under one k-gram. Consecutive windows with one pick form a
   run; its bytes are the run's context. There is an anchor for about 40 bytes of text.
2. Anchors are shuffled once, by k-gram. Of runs with equal contexts (64-bit hash, beside the k-gram's) all but the first
   repeat as a whole. The first ones are needed further only where a k-gram has different contexts: at the ends of repeats.
3. Those contexts are fetched from the texts and dealt by k-gram. Each task sorts the suffixes that begin its windows,
   takes the common prefixes of neighbours, and a stack scan gives the tree of common-prefix intervals of at least LENGTH
   bytes. An interval whose occurrences have different bytes before them (or reach a context's start) is a maximal
   repeat: all its occurrences come out, the first marked.
4. A k-gram with very many contexts (a phrase that much of the corpus goes on from in its own ways) would fill one task.
   Above HOT of them, whatever the input's size, its windows go one by one, by k-gram and a hash of the whole, through an
   aggregation with partial results, and come back by a join that adaptive execution splits.
5. The spans of all occurrences but the first are joined to the texts and cut out.

`repeat_groups` gives the groups themselves. Runs that repeat as a whole, intervals of the tree and hot windows are all
pieces of groups; an occurrence that stands for a class of equal runs is spread to all of them. Pieces whose occurrences lie
alike (the same documents at the same distances, told by their number and two sums of hashes) and overlap are one repeat.
Where a stretch inside a repeat stands in more places, it is a group of its own, and may part the longer one in two.

Runs and windows are told apart by 128 bits of hashes. Null texts are empty; texts shorter than LENGTH lose nothing; texts
longer than PIECE are worked through in pieces that overlap by a window. Ids that repeat or are null: rows are ordered by id
(nulls last) and text, and each counts as a document of its own. Other columns are dropped but for those asked for, whatever
they are called. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import numbered, release, small_batches, write_out

LENGTH, GRAM = 100, 24
CHUNK, SHARD = 1 << 20, 1 << 20
#: Contexts of one k-gram that a suffix array takes: some tens of megabytes.
HOT = 4096
#: Bytes of a text that are worked through at a time; each piece goes on for the bytes of a window.
PIECE = 4 << 20
#: Windows whose k-grams are picked at a time; with a window's length less than 2^24.
PLACES = 1 << 23
_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(int(_B), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _C
    x = (x ^ (x >> _U(29))) * _A
    return x ^ (x >> _U(32))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate((one, np.cumprod(np.full(n, b, np.uint64)))) for b in (_B, _INVERSE))


class Hashed:
    """Texts put together, with hashes of their k-grams and of any longer stretch."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        data = b"".join(texts) + bytes(GRAM + 8)
        n = self.n = int(self.sizes.sum())
        words = np.empty(n + GRAM, np.uint64)
        for o in range(8):
            part = np.frombuffer(data, "<u8", (n + GRAM - o + 7) // 8, o)
            words[o::8] = part[: len(words[o::8])]
        words = _mix(words)
        self.grams = _mix((words[:n] * _B + words[8 : n + 8]) * _B + words[16 : n + 16])
        power, self.inverse = _powers(1 << max(20, (n + GRAM).bit_length()))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)])))

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the bytes from a to b, at least 8."""
        return _mix((self.sums[b - 7] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64))

    def windows(self) -> np.ndarray:
        counts = np.maximum(self.sizes - LENGTH + 1, 0)
        return np.repeat(self.starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window of each run, and where its k-gram is."""
        at = self.windows()
        if not len(at):
            return at, at, at
        parts = [self._picks(a, min(a + PLACES, self.n)) for a in range(0, self.n, PLACES)]
        pick = np.concatenate(parts)[at]
        begin = np.flatnonzero(np.concatenate(([True], (pick[1:] != pick[:-1]) | (at[1:] != at[:-1] + 1))))
        last = np.concatenate((begin[1:], [len(at)])) - 1
        return at[begin], at[last], pick[begin]

    def _picks(self, first: int, last: int) -> np.ndarray:
        """Where the k-gram is that each of the windows from first to last picks. Places count from `first`, so that they fit beside the hashes however long a text is."""
        low, most = _U(0xFFFFFF), LENGTH - GRAM + 1
        grams = self.grams[first : last + most]
        least = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
        width = 1
        while width < most:
            step = min(width, most - width)
            np.minimum(least[:-step], least[step:], out=least[:-step])
            width += step
        return first + 0xFFFFFF - (least[: last - first] & low).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], key: str = "_doc") -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """Keys, texts or pieces of long ones, and where in its text each begins."""
    keys, texts, begins, size = [], [], [], 0
    for batch in batches:
        for k, text in zip(batch.column(key).to_pylist(), batch.column("_text")):
            data = (text.cast(pa.binary()).as_py()) or b""
            for a in range(0, max(1, len(data) - LENGTH + 1), PIECE):
                keys.append(k)
                texts.append(data if len(data) <= PIECE else data[a : a + PIECE + LENGTH - 1])
                begins.append(a)
                size += len(texts[-1])
                if size > CHUNK:
                    yield np.array(keys, np.int64), texts, np.array(begins, np.int64)
                    keys, texts, begins, size = [], [], [], 0
    if keys:
        yield np.array(keys, np.int64), texts, np.array(begins, np.int64)


def _span(a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A run in one number: where it begins, its k-gram's offset, its windows but one."""
    return (a << 16) | ((q - a) << 8) | (b - a)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts, begins in _chunks(batches):
        hashed = Hashed(texts)
        a, b, q = hashed.runs()
        own = np.searchsorted(hashed.ends, a, side="right")
        base = hashed.starts[own] - begins[own]
        columns = [hashed.grams[q].view(np.int64), hashed.stretch(a, b + LENGTH).view(np.int64), keys[own], _span(a - base, b - base, q - base)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "context", "doc", "span"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts (gram, doc, span, bytes) -> (k-gram, hash of the window, doc, span, place) for each of their windows."""
    for batch in batches:
        gram, doc, span = (batch.column(c).to_numpy() for c in ("gram", "doc", "span"))
        hashed = Hashed(batch.column("bytes").to_pylist())
        counts = (span & 0xFF) + 1
        own = np.repeat(np.arange(len(doc)), counts)
        step = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = hashed.starts[own] + step
        columns = [gram[own], hashed.stretch(at, at + LENGTH).view(np.int64), doc[own], span[own], (span[own] >> 16) + step]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "window", "doc", "span", "at"])


def _whole_groups(batches: Iterator[pa.RecordBatch], enough: int = 1) -> Iterator[pa.Table]:
    """Tables of rows ordered by their first column that never part equal values; of `enough` bytes or more where there are."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(0).to_numpy()
        cut = int(np.searchsorted(first == first[-1], True))
        if cut == 0 and held and held[-1].column(0)[-1].as_py() == first[0]:
            held.append(batch)
            continue
        if cut or held:
            rest = batch.slice(cut)
            if cut:
                held.append(batch.slice(0, cut))
            if sum(b.nbytes for b in held) >= enough:
                yield pa.Table.from_batches(held)
                held = []
            held.append(rest)
        else:
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors ordered by k-gram, context, document and place: (doc, begin, end, 0) of runs that repeat as a whole, and (doc, span, k-gram, 1) of the first runs of k-grams with several contexts.

    Between batches no more is kept than the last k-gram and context, and the k-gram's first run as long as it is its only one."""
    last, only = None, None  # (k-gram, context); (doc, span) not yet told to be one of several
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, context, doc, span = (batch.column(i).to_numpy() for i in range(4))
        same = last is not None and gram[0] == last[0]
        new_gram = np.concatenate(([not same], gram[1:] != gram[:-1]))
        first = new_gram | np.concatenate(([not (same and context[0] == last[1])], context[1:] != context[:-1]))
        again = ~first
        begin = span[again] >> 16
        group = np.cumsum(new_gram)  # 0: goes on from the batch before
        counts = np.bincount(group, weights=first, minlength=int(group[-1]) + 1)
        many = counts > 1
        many[0] = counts[0] > 0  # one more than those before
        edge = first & many[group]
        docs, xs, ys, kinds = [doc[again], doc[edge]], [begin, span[edge]], [begin + (span[again] & 0xFF) + LENGTH, gram[edge]], [np.zeros(again.sum(), np.int64), np.ones(edge.sum(), np.int64)]
        if only is not None and counts[0] > 0:
            for out, v in ((docs, only[0]), (xs, only[1]), (ys, last[0]), (kinds, 1)):
                out.append(np.array([v], np.int64))
        if group[-1] > 0:
            one = np.flatnonzero(first & (group == group[-1]))
            only = (doc[one[0]], span[one[0]]) if len(one) == 1 else None
        elif counts[0] > 0:
            only = None
        last = (gram[-1], context[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (docs, xs, ys, kinds)], ["doc", "x", "y", "kind"])


def intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (first suffix, last suffix, length) of at least `least`, by a stack scan.

    common[i]: common prefix of the suffixes i - 1 and i in sorted order; common[0] means nothing."""
    out, stack = [], []
    values = common.tolist()
    for i in range(1, len(values) + 1):
        now = values[i] if i < len(values) else -1
        left = i - 1
        while stack and stack[-1][1] > now:
            left, length = stack.pop()
            out.append((left, i - 1, length))
        if now >= least and (not stack or stack[-1][1] < now):
            stack.append((left, now))
    return out


def maximal_repeats(contexts: list[bytes], windows: np.ndarray, order: np.ndarray, least: int = LENGTH) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of suffixes that begin in the first `windows` places of each context: (length, context and place of each occurrence), the first occurrence in front.

    order: rank of each context's start among all; an occurrence's rank is (order, place)."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    width = int(sizes.max())
    data = np.frombuffer(b"".join(contexts) + bytes(width), np.uint8)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(contexts)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[owner] + place
    room = sizes[owner] - place
    rows = np.lib.stride_tricks.sliding_window_view(data, width)[at]
    rows[np.arange(width) >= room[:, None]] = 0
    sort = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    rows, owner, place, at, room = rows[sort], owner[sort], place[sort], at[sort], room[sort]
    differs = rows[1:] != rows[:-1]
    common = np.where(differs.any(1), differs.argmax(1), width)
    common = np.concatenate(([0], np.minimum(common, np.minimum(room[1:], room[:-1]))))
    before = np.where(place > 0, data[np.maximum(at - 1, 0)].astype(np.int64), -1 - np.arange(len(at)))
    changes = np.cumsum(np.concatenate(([False], before[1:] != before[:-1])))
    rank, out = np.lexsort((place, order[owner])), []
    position = np.empty(len(rank), np.int64)
    position[rank] = np.arange(len(rank))
    edges = np.flatnonzero(common < least)
    for a, b in zip(edges, [*edges[1:], len(common)]):
        if b - a > 1:
            for first, last, length in intervals(common[a:b], least):
                i, j = a + first, a + last
                if changes[j] > changes[i]:
                    own = np.arange(i, j + 1)
                    own = own[np.argsort(position[own])]
                    out.append((length, owner[own], place[own]))
    return out


def _merged(own: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Indices of the first row of each maximal run, and where the runs end, of spans of the same owner."""
    sort = np.lexsort((begin, own))
    own, begin, end = own[sort], begin[sort], end[sort]
    lift = own.astype(np.int64) << 40
    reach = np.maximum.accumulate(lift + end - end.min()) - lift + end.min()
    first = np.concatenate(([True], (own[1:] != own[:-1]) | (begin[1:] > reach[:-1])))
    last = np.concatenate((np.flatnonzero(first)[1:], [len(own)])) - 1
    return own[first], begin[first], reach[last]


def _repeats(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Contexts (gram, doc, span, bytes) ordered by k-gram -> all occurrences of maximal repeats (whole), or for each context the spans that repeat something earlier, put together."""
    for table in _whole_groups(batches, SHARD):
        doc, span, contexts = table.column("doc").to_numpy(), table.column("span").to_numpy(), table.column("bytes").to_pylist()
        gram = table.column("gram").to_numpy()
        begin = span >> 16
        order = np.empty(len(doc), np.int64)
        order[np.lexsort((begin, doc))] = np.arange(len(doc))
        cuts = [0]
        size = np.cumsum([len(c) for c in contexts])
        for i in np.flatnonzero(gram[1:] != gram[:-1]) + 1:
            if size[i - 1] - (size[cuts[-1] - 1] if cuts[-1] else 0) >= SHARD:
                cuts.append(int(i))
        for a, b in zip(cuts, [*cuts[1:], len(doc)]):
            found = maximal_repeats(contexts[a:b], (span[a:b] & 0xFF) + 1, order[a:b])
            if not found:
                continue
            own = np.concatenate([o for _, o, _ in found]) + a
            at = begin[own] + np.concatenate([p for _, _, p in found])
            end = at + np.repeat([n for n, _, _ in found], [len(o) for _, o, _ in found])
            first = np.zeros(len(own), bool)
            first[np.cumsum([0, *(len(o) for _, o, _ in found[:-1])])] = True
            if whole:
                leader = np.flatnonzero(first)[np.cumsum(first) - 1]
                columns, names = [gram[own], doc[own[leader]], at[leader], doc[own], span[own], at, end - at], ["gram", "first_doc", "first_begin", "doc", "span", "begin", "length"]
            else:
                own, at, end = _merged(own[~first], at[~first], end[~first])
                columns, names = [doc[own], at, end], ["doc", "begin", "end"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _dealt(docs: DataFrame) -> DataFrame:
    """Anchors, together by k-gram, ordered by k-gram, context, document and place."""
    anchors = docs.select("_doc", "_text").mapInArrow(_anchors, "gram long, context long, doc long, span long")
    return anchors.repartition("gram").sortWithinPartitions("gram", "context", "doc", "span")


def _met(docs: DataFrame) -> DataFrame:
    """What anchors say when they meet (see _meet), written out."""
    small_batches(docs.sparkSession)
    met, _ = write_out(_dealt(docs).mapInArrow(_meet, "doc long, x long, y long, kind long"), "anchors")
    release(docs.sparkSession)
    return met


def _contexts(docs: DataFrame, met: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """The bytes of the contexts that need comparing, together by k-gram; and the windows of k-grams that have more than `hot` of them."""
    edges = met.where("kind = 1").select("doc", F.col("x").alias("span"), F.col("y").alias("gram"))
    crowds, _ = write_out(edges.groupBy(F.col("gram").alias("_gram")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select("_gram"), "crowds")
    asked = edges.groupBy("doc").agg(F.collect_list(F.struct("gram", "span")).alias("asked"))
    pairs = asked.join(docs.select("_doc", "_text"), F.col("doc") == F.col("_doc")).select("doc", "_text", "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].cast(pa.binary()).as_py()
                own = batch.column(2).slice(i, 1).flatten()
                span = own.field("span").to_numpy()
                parts = [text[a : a + n + LENGTH] for a, n in zip((span >> 16).tolist(), (span & 0xFF).tolist())]
                yield pa.RecordBatch.from_arrays([own.field("gram"), pa.array(np.full(len(span), batch.column(0)[i].as_py())), own.field("span"), pa.array(parts, pa.binary())], ["gram", "doc", "span", "bytes"])

    found = pairs.mapInArrow(cut, "gram long, doc long, span long, bytes binary")
    if crowds.isEmpty():
        windows = docs.sparkSession.createDataFrame([], _WINDOWS)
    else:
        found, _ = write_out(found, "contexts")
        windows = found.join(crowds, F.col("gram") == F.col("_gram"), "left_semi").mapInArrow(_windows, _WINDOWS)
        found = found.join(crowds, F.col("gram") == F.col("_gram"), "left_anti")
    return found.repartition("gram").sortWithinPartitions("gram", "doc", "span"), windows


_WINDOWS = "gram long, window long, doc long, span long, at long"


def repeat_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """The maximal repeats with all their occurrences: first_doc, first_begin, doc, begin, length, a row for each occurrence.

    A repeat is named by its first occurrence and its length; documents go by key, or by number where keys repeat or are null."""
    docs = numbered(docs, key, text)
    met = _met(docs)
    contexts, windows = _contexts(docs, met, hot)
    anchors, _ = write_out(_dealt(docs), "anchors")
    spread = anchors.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "span")).alias("first")).where("n > 1")
    spread, _ = write_out(spread.select(F.col("gram").alias("_gram"), F.col("context").alias("_context"), F.col("first.doc").alias("low_doc"), F.col("first.span").alias("low_span")), "classes")
    member = anchors.join(spread, (F.col("gram") == F.col("_gram")) & (F.col("context") == F.col("_context"))).select("gram", "low_doc", "low_span", "doc", "span")
    member, _ = write_out(member, "members")
    start, size = F.shiftright("span", 16), F.col("span").bitwiseAND(F.lit(0xFF)) + LENGTH
    found = contexts.mapInArrow(lambda b: _repeats(b, True), "gram long, first_doc long, first_begin long, doc long, span long, begin long, length long")
    found = found.select("gram", F.xxhash64("gram", "first_doc", "first_begin", "length").alias("piece"), "doc", "span", "begin", "length")
    often = windows.groupBy(F.col("gram").alias("_gram"), F.col("window").alias("_window")).count().where("count > 1")
    crowded = windows.join(often, (F.col("gram") == F.col("_gram")) & (F.col("window") == F.col("_window"))).select("gram", F.xxhash64("gram", "window").alias("piece"), "doc", "span", F.col("at").alias("begin"), F.lit(LENGTH).cast("long").alias("length"))
    found, _ = write_out(found.unionByName(crowded), "tree")
    # A run whose bytes stand within a longer run of its k-gram too is in the tree with all its places.
    within = found.where((F.col("begin") == start) & (F.col("length") == size)).select(F.col("gram").alias("_g"), F.col("doc").alias("_d"), F.col("span").alias("_s")).distinct()
    alone = member.join(within, (F.col("gram") == F.col("_g")) & (F.col("low_doc") == F.col("_d")) & (F.col("low_span") == F.col("_s")), "left_anti")
    runs = alone.select(F.xxhash64("gram", "low_doc", "low_span").alias("piece"), "doc", start.alias("begin"), size.alias("length"))
    whole = member.select(F.col("gram").alias("_g"), F.col("low_doc").alias("_d"), F.col("low_span").alias("_s"), F.col("doc").alias("_doc2"), F.shiftright("span", 16).alias("_start"))
    of_class = found.join(whole, (F.col("gram") == F.col("_g")) & (F.col("doc") == F.col("_d")) & (F.col("span") == F.col("_s")), "left")
    tree = of_class.select("piece", F.coalesce("_doc2", "doc").alias("doc"), (F.col("begin") - start + F.coalesce("_start", start)).alias("begin"), "length")
    pieces, _ = write_out(runs.unionByName(tree), "pieces")
    first = pieces.groupBy("piece").agg(F.min(F.struct("doc", "begin")).alias("first"))
    placed = pieces.join(first, "piece")
    way = lambda seed: F.sum(F.xxhash64("doc", F.col("begin") - F.col("first.begin"), F.lit(seed)).cast("decimal(38,0)"))  # noqa: E731  occurrences lie alike
    shapes = placed.groupBy("piece", "first", "length").agg(way(1).alias("s1"), way(2).alias("s2"), F.count(F.lit(1)).alias("n"))
    alike = ["first_doc", "s1", "s2", "n"]
    shapes = shapes.select("piece", F.col("first.doc").alias("first_doc"), F.col("first.begin").alias("at"), (F.col("first.begin") + F.col("length")).alias("end"), "s1", "s2", "n")
    w = Window.partitionBy(*alike).orderBy("at", "end", "piece")
    shapes = shapes.withColumn("_new", (F.col("at") > F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")).withColumn("part", F.sum("_new").over(w))
    groups = shapes.groupBy(*alike, "part").agg(F.min("at").alias("first_begin"), F.max("end").alias("_end"), F.min_by("piece", F.struct("at", "piece")).alias("_piece"))
    named = groups.select("_piece", "first_doc", "first_begin", (F.col("_end") - F.col("first_begin")).alias("length"))
    return pieces.drop("length").join(named, F.col("piece") == F.col("_piece")).select("first_doc", "first_begin", "doc", "begin", "length").distinct()


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs: _doc long (unique; the order of documents), _text. Returns doc, begin, end: spans that repeat what starts earlier."""
    met = _met(docs)
    contexts, windows = _contexts(docs, met, hot)
    occurrences, _ = write_out(contexts.mapInArrow(lambda b: _repeats(b, False), "doc long, begin long, end long"), "occurrences")
    release(docs.sparkSession)
    firsts = windows.groupBy(F.col("gram").alias("_gram"), F.col("window").alias("_window")).agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = windows.join(firsts, (F.col("gram") == F.col("_gram")) & (F.col("window") == F.col("_window"))).where((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")))
    crowded = again.select("doc", F.col("at").alias("begin"), (F.col("at") + LENGTH).alias("end"))
    return met.where("kind = 0").selectExpr("doc", "x as begin", "y as end").unionByName(occurrences).unionByName(crowded)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """key, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: the bytes that remain) of every row."""
    docs = numbered(docs, key, text).select(F.col(key).alias("_key"), "_doc", "_text")
    spans = repeated_spans(docs, hot).groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    both = docs.join(spans, F.col("_doc") == F.col("doc"), "left").select("_key", "_text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                data = batch.column(1)[i].cast(pa.binary()).as_py()
                lists = batch.column(2).slice(i, 1)
                runs = []
                if lists.null_count == 0:
                    own = lists.flatten()
                    begin, end = own.field("begin").to_numpy(), own.field("end").to_numpy()
                    _, begin, end = _merged(np.zeros(len(begin), np.int64), begin, end)
                    runs = list(zip(begin.tolist(), end.tolist()))
                kept = b"".join(data[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(data)])) if runs else data
                rows.append((batch.column(0)[i].as_py(), len(data), len(data) - len(kept), len(runs), kept))
                size += len(kept)
                if size > CHUNK or i + 1 == batch.num_rows:
                    kinds = [pa.int64()] * 4 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [key, "n_bytes", "n_removed", "n_spans", "kept"])
                    rows, size = [], 0

    return both.mapInArrow(run, f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept binary")
