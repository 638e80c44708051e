"""Alignment of the tokens of two tokenizers: byte-level BPE (A) and pieces with byte fallback (B) over the same text.

Both read a space before the text, so their tokens' bytes are the same line of bytes, cut in different places. The ends of
A's and of B's tokens are marked in two packed bitsets. AND gives the shared cuts, which part the text into groups; the
rank of a cut in either bitset, a running sum of popcounts and the popcount of a masked word, says which tokens lie before
it. OR gives the stretches that one token of each side shares: each is one link, and the ranks of its end are its two
tokens. A link's count is the number of documents that hold the same pair of ids linked.

Texts are parted at spaces after something else than white space, where tokens of both kinds always end (tested when the
tokenizers are read), so that a worker tokenises a stretch once and finds it again; the cache is bounded. Documents that
are null or empty, or whose tokens of either side don't join to a space and the text, have no tokens. Texts may be of any length:
a batch is cut between texts into pieces of about CHUNK bytes, and a text takes some hundred bytes for each token. Repeated
rows are aligned each on its own; a kept column called like an output is an error; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import byte_cuts, small_batches

CHUNK = 1 << 21
#: Pairs of ids up to this many (some 24 bytes each) are sent to all executors; more are joined by a shuffle.
PAIRS_SENT = 2_000_000
CACHED, CACHED_TOKENS = 300_000, 4_000_000
# The pattern that byte-level pre-tokenizers split by, and the sign that stands for a space in pieces.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"
_STRETCH = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+")
OUTPUTS = {
    "n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "a_ids": T.ArrayType(T.IntegerType()), "b_ids": T.ArrayType(T.IntegerType()), "a_cuts": T.ArrayType(T.IntegerType()), "b_cuts": T.ArrayType(T.IntegerType()),
    "link_a": T.ArrayType(T.IntegerType()), "link_b": T.ArrayType(T.IntegerType()), "groups": T.StringType(), "pairs": T.ArrayType(T.LongType()), "pair_links": T.ArrayType(T.LongType()),
}


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        import tiktoken

        said = json.loads(a_json)
        alphabet, vocabulary = byte_alphabet(), said["model"]["vocab"]
        special = {t["content"] for t in said.get("added_tokens", [])}
        of = {t: bytes(alphabet[c] for c in t) for t in vocabulary if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        ranks = [vocabulary["".join(m)] for m in merges]
        if ranks != sorted(ranks) or said.get("normalizer") or said["pre_tokenizer"].get("type") != "ByteLevel":
            raise ValueError("A must be byte-level BPE without normalizer, its ids in the order of its merges")
        a = {b: vocabulary[t] for t, b in of.items()}
        self.a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=a, special_tokens={}) if set(range(256)) <= {b[0] for b in a if len(b) == 1} else None
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in names):
            raise ValueError("B has pieces that go on beyond a space")
        self.space = self.b.piece_to_id(SPACE)
        self.a_bytes = [b""] * (max(a.values()) + 1)
        for b, i in a.items():
            self.a_bytes[i] = b
        plain = lambda i, p: b"" if self.b.is_control(i) or self.b.is_unknown(i) else bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
        self.b_bytes = [plain(i, p) for i, p in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([len(b) for b in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.at, self.good = [array("i"), array("i")], [array("q", [0]), array("q", [0])], array("b")

    def learn(self, stretches: list[str]) -> None:
        """Tokenise stretches, each with a space before it."""
        pieces = self.b.encode(stretches, num_threads=1)
        for s, b in zip(stretches, pieces):
            a, whole = self.a.encode_ordinary(" " + s), (" " + s).encode()
            b = b or [self.space]
            self.good.append(all(b"".join(parts) == whole and b"" not in parts for parts in ([self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b])))
            for ids, flat, at in zip((a, b), self.flat, self.at):
                flat.extend(ids)
                at.append(len(flat))
            self.known[s] = len(self.known)

    def tokenise(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B over all texts, and how many each text has of either; none where they don't join to the text."""
        if len(self.known) > CACHED or len(self.flat[0]) + len(self.flat[1]) > CACHED_TOKENS:
            self.forget()
        parted, sizes = [], []
        for t in texts:
            own = [] if not t else t.split(" ") if not re.search(r"^\s|\s ", t) else [x[1:] for x in _STRETCH.findall(" " + t)]
            parted += own
            sizes.append(len(own))
        if missing := [s for s in dict.fromkeys(parted) if s not in self.known]:
            self.learn(missing)
        words = np.fromiter(map(self.known.__getitem__, parted), np.int64, len(parted))
        of = np.repeat(np.arange(len(texts)), sizes)
        bad = np.bincount(of, np.frombuffer(self.good, np.int8)[words] == 0, len(texts)) > 0
        words, of = words[~bad[of]], of[~bad[of]]
        out = []
        for flat, at in zip(self.flat, self.at):
            at, flat = np.frombuffer(at, np.int64), np.frombuffer(flat, np.int32)
            counts = at[words + 1] - at[words]
            ends = np.cumsum(counts)
            out += [flat[np.repeat(at[words] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], np.bincount(of, counts, len(texts)).astype(np.int64)]
        return out[0], out[2], out[1], out[3]


class Bits:
    """A packed bitset with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @staticmethod
    def of(places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-size // 64) * 64, bool)
        marks[places] = True
        return Bits(np.packbits(marks, bitorder="little").view(np.uint64))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        inside = np.append(self.words, np.uint64(0))[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def select(self) -> np.ndarray:
        """The places of all bits that are set."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def cuts_and_links(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two cuttings of one line of bytes: the numbers of tokens before each shared cut, and the tokens of each link."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    size = int(a_ends[-1]) if len(a_ends) else 0
    a, b = Bits.of(a_ends - 1, size), Bits.of(b_ends - 1, size)
    cuts, links = Bits(a.words & b.words).select() + 1, Bits(a.words | b.words).select()
    return a.rank(cuts), b.rank(cuts), a.rank(links), b.rank(links)


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to most, from the left, and how many each has; one more place for the sign after them."""
    text = np.array([str(i) for i in range(most + 1)], "S")
    width = text.dtype.itemsize
    return np.concatenate([text.view(np.uint8).reshape(-1, width), np.zeros((most + 1, 1), np.uint8)], 1), np.char.str_len(text)


class Aligner:
    def __init__(self, a_json: bytes, b_model: bytes):
        self.pair = Pair(a_json, b_model)
        self.digits, self.width = _digits(max(len(self.pair.a_sizes), len(self.pair.b_sizes)))

    def texts_of_groups(self, a_ids, b_ids, a_cuts, b_cuts, per_a, per_b) -> list[str]:
        """For each text its groups: a1,a2|b1;a3|b2,b3."""
        a_before, b_before = np.concatenate(([0], a_cuts[:-1])), np.concatenate(([0], b_cuts[:-1]))
        a_at = np.arange(len(a_ids)) + np.repeat(b_before, a_cuts - a_before)
        b_at = np.arange(len(b_ids)) + np.repeat(a_cuts, b_cuts - b_before)
        ids, sign = np.empty(len(a_ids) + len(b_ids), np.int64), np.full(len(a_ids) + len(b_ids), ord(","), np.uint8)
        ids[a_at], ids[b_at] = a_ids, b_ids
        sign[a_at[a_cuts - 1]], sign[b_at[b_cuts - 1]] = ord("|"), ord(";")
        rows, width = self.digits[ids], self.width[ids]
        rows[np.arange(len(ids)), width] = sign
        said = rows[np.arange(rows.shape[1]) <= width[:, None]].tobytes().decode()
        ends = np.concatenate(([0], np.cumsum(width + 1)))[np.cumsum(per_a + per_b)].tolist()
        return [said[a : b - 1] if b > a else "" for a, b in zip([0, *ends], ends)]

    def align(self, texts: list[str], wanted: list[str]) -> list[pa.Array]:
        """The wanted outputs of the texts."""
        a_ids, b_ids, per_a, per_b = self.pair.tokenise(texts)
        a_cuts, b_cuts, link_a, link_b = cuts_and_links(self.pair.a_sizes[a_ids], self.pair.b_sizes[b_ids])
        a_ends, a_starts, b_starts = np.cumsum(per_a), np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        cut_text, link_text = np.searchsorted(a_ends, a_cuts - 1, side="right"), np.searchsorted(a_ends, link_a, side="right")
        per_cut, per_link = (np.bincount(x, minlength=len(texts)) for x in (cut_text, link_text))
        lists = lambda v, n, kind=pa.int32(): pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(v, kind))
        made = {
            "n_a": lambda: pa.array(per_a), "n_b": lambda: pa.array(per_b), "n_groups": lambda: pa.array(per_cut), "n_links": lambda: pa.array(per_link),
            "a_ids": lambda: lists(a_ids, per_a), "b_ids": lambda: lists(b_ids, per_b), "a_cuts": lambda: lists(a_cuts - a_starts[cut_text], per_cut), "b_cuts": lambda: lists(b_cuts - b_starts[cut_text], per_cut),
            "link_a": lambda: lists(link_a - a_starts[link_text], per_link), "link_b": lambda: lists(link_b - b_starts[link_text], per_link),
            "groups": lambda: pa.array(self.texts_of_groups(a_ids, b_ids, a_cuts, b_cuts, per_a, per_b) if len(a_ids) else [""] * len(texts), pa.string()),
        }
        if {"pairs", "pair_links"} & set(wanted):
            many_a, many_b = len(self.pair.a_sizes), len(self.pair.b_sizes)
            held, times = np.unique((link_text * many_a + a_ids[link_a]) * many_b + b_ids[link_b], return_counts=True)
            per_pair = np.bincount(held // (many_a * many_b), minlength=len(texts))
            made["pairs"] = lambda: lists((held // many_b % many_a << 32) | held % many_b, per_pair, pa.int64())
            made["pair_links"] = lambda: lists(times, per_pair, pa.int64())
        return [made[w]() for w in wanted]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def align(docs: DataFrame, a_path: str, b_path: str, wanted: list[str], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The wanted OUTPUTS of each text beside the columns `keep` (default: all).

    Token numbers count from 0 in each text. a_cuts and b_cuts: tokens before each shared cut; link_a, link_b: the tokens of each link; pairs: the different linked pairs, A's id * 2^32 + B's id, and how many links each has."""
    keep = docs.columns if keep is None else keep
    if clash := set(wanted) & set(keep):
        raise ValueError(f"a kept column is called {', '.join(sorted(clash))}")
    small_batches(docs.sparkSession)
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        shared = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))  # two vocabularies of some megabytes
    names = [*keep, *wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _ALIGNERS:
            _ALIGNERS.clear()
            _ALIGNERS[a_path, b_path] = Aligner(*shared.value)
        aligner = _ALIGNERS[a_path, b_path]
        for batch in batches:
            texts = [x or "" for x in batch.column(len(keep)).to_pylist()]
            for a, b in byte_cuts([len(t) for t in texts], CHUNK):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), *aligner.align(texts[a:b], wanted)], names)

    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(w, OUTPUTS[w]) for w in wanted)])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked), best: whether no pair of the same id of A has a higher count. Of align's rows with `pairs`."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))  # rows of one id: B's vocabulary at most
    return counts.withColumn("best", F.col("count") == highest)


def add_link_counts(aligned: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """`by`, n_best (links whose pair is best), count_sum (counts over all links): of align's rows with pairs and pair_links. `by` must tell documents apart; counts: a written table of pair_counts."""
    links = aligned.select(*by, F.explode_outer(F.arrays_zip("pairs", "pair_links")).alias("_l")).select(*by, F.col("_l.pairs").alias("pair"), F.col("_l.pair_links").alias("_n"))
    near = F.broadcast(counts) if counts.count() <= PAIRS_SENT else counts
    found = links.join(near, "pair", "left")
    sums = {"n_best": F.when(F.col("best"), F.col("_n")), "count_sum": F.col("_n") * F.col("count")}
    return found.groupBy(*by).agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(c) for c, v in sums.items()])
