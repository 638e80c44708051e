"""Byte-level BPE: encoding to ranks and decoding.

Pre-tokenisation finds the matches of the split pattern without a regular expression. Every code point gets a class
from a table (letter, number, white space, plain space, other, apostrophe before a contraction's ending); a class
stands for a transition function of a small automaton. Functions compose associatively, so the state before every
code point of a batch comes from a blocked prefix scan over indices into a table of composed functions, and whether
a token begins there depends on that state, the class and the next class alone. The slices between those places go
through a cache of merged pieces; a miss merges pairs by rank. Offsets are kept, so decoding puts the bytes of each
token at its place.

Nulls are taken as empty texts: no tokens, empty bytes. Texts of any length work; a batch is cut between documents
into pieces of about CHUNK bytes, and a piece of one word of any length merges in O(n log n). Repeated rows are
encoded each on its own. Other columns pass through untouched; a column that is called like an output is an error.
A worker holds the vocabulary once, for encoding and decoding, and remembers at most CACHED pieces of at most LONGEST
bytes, so its memory doesn't depend on the input.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import small_batches

CHUNK = 1 << 20
#: Pieces that a worker remembers at most, and the longest that it remembers.
CACHED, LONGEST = 150_000, 64

# Classes of code points. FIRST is added to the class of a document's first code point.
LETTER, NUMBER, OTHER, BLANK, SPACE, APOSTROPHE1, APOSTROPHE2, FIRST = range(8)
# States after a code point. FRESH: a token has ended for certain; HOLDS: an apostrophe would go on with the token;
# OPEN: it would begin one; TAIL1, TAIL2: so many code points of a contraction are to come.
FRESH, OPEN, HOLDS, TAIL1, TAIL2 = STATES = range(5)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the library whose results are to be matched."""
    import tiktoken

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    text, single = points.tobytes().decode("utf-32-le"), {bytes([i]): i for i in range(256)}
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        found = bytes(tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text))
        table[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = kind
    table[0x20] = SPACE
    return table


def _step(state: int, kind: int) -> int:
    if kind >= FIRST:
        state, kind = FRESH, kind - FIRST
    if state == TAIL2:
        return TAIL1
    if state == TAIL1:
        return FRESH
    if kind in (APOSTROPHE1, APOSTROPHE2):
        return HOLDS if state == HOLDS else TAIL1 if kind == APOSTROPHE1 else TAIL2
    return HOLDS if kind in (OTHER, SPACE) else OPEN


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    """compose[f, g]: the function that applies f, then g; apply[f, state]. The first 14 functions are the classes'."""
    known = [tuple(_step(s, k) for s in STATES) for k in range(2 * FIRST)]
    index = {}
    for i, f in enumerate(known):
        index.setdefault(f, i)
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in known[: 2 * FIRST]:
            if (h := tuple(g[s] for s in f)) not in index:
                index[h] = len(known)
                known.append(h)
                todo.append(h)
    compose = np.array([[index.get(tuple(g[s] for s in f), 0) for g in known] for f in known], np.uint8)
    return compose, np.array(known, np.uint8)


def _scan(f: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive prefix composition of function indices."""
    compose, _ = _functions()
    flat, size = compose.ravel(), np.uint16(len(compose))
    if len(f) <= block:
        out = f.copy()
        for i in range(1, len(out)):
            out[i] = compose[out[i - 1], out[i]]
        return out
    rows = -(-len(f) // block)
    padded = np.zeros(rows * block, np.uint8)
    padded[: len(f)] = f
    lanes = np.ascontiguousarray(padded.reshape(rows, block).T)
    for j in range(1, block):
        lanes[j] = flat[lanes[j - 1].astype(np.uint16) * size + lanes[j]]
    totals = _scan(lanes[-1], block)
    carried = totals[:-1].astype(np.uint16) * size
    for j in range(block):
        lanes[j, 1:] = flat[carried + lanes[j, 1:]]
    return np.ascontiguousarray(lanes.T).ravel()[: len(f)]


def token_starts(points: np.ndarray, firsts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """True where a match of the split pattern begins. firsts: indices of the documents' first code points."""
    n = len(points)
    kind = table[points]
    is_first = np.zeros(n + 1, bool)
    is_first[firsts] = True
    is_first[n] = True
    at = np.flatnonzero(points == 0x27)
    if len(at):
        after = np.zeros(len(at), np.uint32)
        second = np.zeros(len(at), np.uint32)
        has1 = (at + 1 < n) & ~is_first[at + 1]
        has2 = has1 & (at + 2 < n) & ~is_first[np.minimum(at + 2, n)]
        after[has1] = points[at[has1] + 1]
        second[has2] = points[at[has2] + 2]
        one = np.isin(after, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        two = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (after == ord(a)) & (second == ord(b))
        kind[at[one]], kind[at[two]] = APOSTROPHE1, APOSTROPHE2
    f = kind + np.where(is_first[:n], np.uint8(FIRST), np.uint8(0))
    states = _functions()[1][_scan(f), FRESH]
    before = np.empty(n, np.uint8)
    before[0] = FRESH
    before[1:] = states[:-1]
    before[firsts] = FRESH
    white = (kind == BLANK) | (kind == SPACE)
    next_dark = np.zeros(n, bool)
    next_dark[:-1] = ~white[1:] & ~is_first[1:n]
    last = np.empty(n, np.uint8)
    last[0] = BLANK
    last[1:] = np.where(kind[:-1] > SPACE, OTHER, kind[:-1])
    same = np.where(kind > SPACE, OTHER, kind) == last
    begins = np.where(white, ~((last == BLANK) | (last == SPACE)) | next_dark, ~same & (last != SPACE))
    return (begins | (before == FRESH)) & (before != TAIL1) & (before != TAIL2)


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of least rank, the leftmost on ties, until no pair has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    ends, back, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)

    def pair(i: int) -> int | None:
        return ranks.get(piece[i : ends[ends[i]]]) if ends[i] < n else None

    heap = [(r, i, ends[i + 1]) for i in range(n - 1) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
            continue
        alive[ends[i]] = 0
        ends[i] = end
        if end < n:
            back[end] = i
            if (r := pair(i)) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (b := back[i]) >= 0 and (r := pair(b)) is not None:
            heapq.heappush(heap, (r, b, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Vocabulary:
    """Pieces by rank, end to end, and the pairs that merge: arrays, so that sending and holding them costs what they measure."""

    def __init__(self, ranks: dict[bytes, int]):
        self.base = np.int64(max(ranks.values()) + 1)
        self.lengths = np.zeros(self.base, np.int64)
        pieces, pairs = [b""] * int(self.base), {}
        for piece, rank in ranks.items():
            self.lengths[rank], pieces[rank] = len(piece), piece
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * int(self.base) + right] = rank
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def ranks(self) -> dict[bytes, int]:
        data, begins, lengths = self.data.tobytes(), self.begins.tolist(), self.lengths.tolist()
        return {data[a : a + n]: rank for rank, (a, n) in enumerate(zip(begins, lengths)) if n}

    def decode(self, ids: np.ndarray, counts: np.ndarray, offsets: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, end to end, and how many each has. offsets: where in its text each token goes; None: end to end."""
        wide = self.lengths[ids]
        owner = np.repeat(np.arange(len(counts)), counts)
        sizes = np.bincount(owner, weights=wide, minlength=len(counts)).astype(np.int64)
        text_at = np.cumsum(sizes) - sizes
        at = np.cumsum(wide) - wide if offsets is None else offsets + text_at[owner]
        step = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        got = np.empty(len(step), np.uint8)
        got[np.repeat(at, wide) + step] = self.data[np.repeat(self.begins[ids], wide) + step]
        return got, sizes


class Merger:
    """Merges many short pieces at once: each round merges in every piece its pair of least rank, the leftmost on ties."""

    NONE = np.int64(1 << 40)

    def __init__(self, words: Vocabulary):
        self.base, self.keys, self.merged = words.base, words.keys, words.merged
        self.single = np.zeros(256, np.int64)
        for rank in np.flatnonzero(words.lengths == 1).tolist():
            self.single[words.data[words.begins[rank]]] = rank

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged pair's rank; NONE if it has none. A side of -1 is past the end."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], self.NONE)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for low, high in ((0, 8), (8, 16), (16, 32), (32, LONGEST)):
            if not len(own := np.flatnonzero((sizes > low) & (sizes <= high))):
                continue
            raw = np.frombuffer(b"".join(pieces[i].ljust(high, b"\0") for i in own.tolist()), np.uint8).reshape(len(own), high)
            parts = np.full((len(own), high + 1), -1, np.int64)
            parts[:, :high] = np.where(np.arange(high) < sizes[own, None], self.single[raw], -1)
            ranks = np.full((len(own), high + 1), self.NONE)
            ranks[:, :high] = self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(own), high)
            column = np.arange(high + 1)
            while len(own):
                at = ranks.argmin(1)
                row = np.arange(len(own))
                least = ranks[row, at]
                if (done := least == self.NONE).any():
                    for i, ids in zip(own[done].tolist(), parts[done].tolist()):
                        out[i] = ids[: ids.index(-1)]
                    own, parts, ranks, at, least = own[~done], parts[~done], ranks[~done], at[~done], least[~done]
                    row = np.arange(len(own))
                moved = column[:-1] > at[:, None]
                parts[:, :-1] = np.where(moved, parts[:, 1:], parts[:, :-1])
                ranks[:, :-1] = np.where(moved, ranks[:, 1:], ranks[:, :-1])
                parts[row, at] = least
                ranks[row, at] = self.rank(least, parts[row, at + 1])
                if (inner := at > 0).any():
                    ranks[row[inner], at[inner] - 1] = self.rank(parts[row[inner], at[inner] - 1], least[inner])
        return out


class Encoder:
    """Encodes texts of a worker; remembers at most CACHED pieces."""

    def __init__(self, words: Vocabulary, table: np.ndarray):
        self.words, self.ranks, self.table, self.merger = words, words.ranks(), table, Merger(words)
        self.forget()

    def forget(self) -> None:
        self.flat, self.offsets, self.known = array("i"), array("q", [0]), {}

    def learn(self, pieces: list[bytes]) -> dict[bytes, int]:
        """Numbers of pieces not met before; long ones are forgotten at once."""
        short = [p for p in pieces if len(p) <= LONGEST]
        long = [p for p in pieces if len(p) > LONGEST]
        new = {}
        for piece, ids in zip([*short, *long], [*self.merger.merge(short), *(merge_piece(p, self.ranks) for p in long)]):
            self.flat.extend(ids)
            self.offsets.append(len(self.flat))
            new[piece] = len(self.offsets) - 2
        self.known.update((p, new[p]) for p in short)
        return new

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, how many each has, and where in its text each token's bytes begin."""
        if len(self.known) > CACHED or len(self.flat) > 8 * CACHED:
            self.forget()
        data = b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not data:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=place[1:])
        text_at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes, out=text_at[1:])
        firsts = np.searchsorted(place[:-1], text_at[:-1][sizes > 0])
        starts = place[:-1][token_starts(points, firsts, self.table)]
        cuts = [*starts.tolist(), len(data)]
        pieces = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        found = list(map(self.known.get, pieces))
        if missing := [i for i, x in enumerate(found) if x is None]:
            new = self.learn(list({pieces[i] for i in missing}))
            for i in missing:
                found[i] = new[pieces[i]]
        words = np.array(found, np.int64)
        offsets, flat = np.frombuffer(self.offsets, np.int64), np.frombuffer(self.flat, np.int32)
        counts = offsets[words + 1] - offsets[words]
        ends = np.cumsum(counts)
        ids = flat[np.repeat(offsets[words] - (ends - counts), counts) + np.arange(ends[-1])]
        wide = self.words.lengths[ids]
        token_at = np.cumsum(wide) - wide
        first_word = np.searchsorted(starts, text_at)
        tokens_to = np.concatenate(([0], ends))[first_word]
        per_text = np.diff(tokens_to)
        return ids, per_text, (token_at - np.repeat(text_at[:-1], per_text)).astype(np.int32)


_ENCODERS: dict[str, Encoder] = {}


@lru_cache(maxsize=2)
def _vocabulary(ranks_path: str) -> Vocabulary:
    return Vocabulary(read_ranks(ranks_path))


def share(spark: SparkSession, ranks_path: str) -> Broadcast:
    """One vocabulary for all tasks: some megabytes, whatever the input."""
    return spark.sparkContext.broadcast((_vocabulary(ranks_path), class_table()))


def encoder_of(name: str, shared: Broadcast) -> Encoder:
    """The worker's encoder, which it keeps from task to task."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(*shared.value)
    return _ENCODERS[name]


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _chunks(sizes: list[int], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    yield start, len(sizes)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.astype(np.int32)))


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def encode(docs: DataFrame, ranks_path: str, text: str = "text", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """Add token_ids and token_offsets (array<int>; byte offsets into the UTF-8 text) to the columns `keep` (default: all).

    decoded: name of a further column, the bytes that the ids decode to at their offsets. It comes from the ids alone, as
    `decode` would make it, in the same pass over the rows."""
    keep = docs.columns if keep is None else keep
    added = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("token_ids", "token_offsets")] + [T.StructField(c, T.BinaryType()) for c in (decoded,) if c]
    if clash := {f.name for f in added} & set(keep):
        raise ValueError(f"a kept column is called {', '.join(sorted(clash))}")
    names = [*keep, *(f.name for f in added)]
    shared = share(docs.sparkSession, ranks_path)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks_path, shared)
        for batch in batches:
            texts = _bytes_of(batch.column(len(keep)))
            for a, b in _chunks([len(t) for t in texts]):
                ids, counts, offsets = encoder.encode(texts[a:b])
                rows = batch.slice(a, b - a)
                columns = [*(rows.column(i) for i in range(len(keep))), _lists(ids, counts), _lists(offsets, counts)]
                if decoded:
                    columns.append(_binaries(*encoder.words.decode(ids, counts, offsets)))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + added))


def decode(tokens: DataFrame, ranks_path: str, out: str = "decoded") -> DataFrame:
    """Add the bytes that token_ids stand for, each put at its offset (token_offsets; without them, end to end)."""
    names = tokens.columns
    if out in names:
        raise ValueError(f"a column is called {out}")
    shared = share(tokens.sparkSession, ranks_path)
    small_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder_of(ranks_path, shared).words
        for batch in batches:
            column = batch.column(names.index("token_ids"))
            for a, b in _chunks(pc.fill_null(pc.list_value_length(column), 0).to_pylist(), CHUNK // 4):
                rows = batch.slice(a, b - a)
                lists = rows.column(names.index("token_ids"))
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                offsets = rows.column(names.index("token_offsets")).flatten().to_numpy(zero_copy_only=False) if "token_offsets" in names else None
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(names))), _binaries(*words.decode(ids, counts, offsets))], [*names, out])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(out, T.BinaryType())]))
