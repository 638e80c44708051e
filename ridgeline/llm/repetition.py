"""Quality rules by repetition coverage: how much of a text stands inside repeated n-grams of words and repeated lines.

Words are the stretches without ASCII white space. Rolling hashes of the n-grams of every length in LENGTHS come one from
the other by a multiplication and an addition, over all texts of a batch at once; equal hashes are held against the
words themselves, so that a collision costs time and never a wrong figure. Only places whose shorter n-gram is repeated
are asked for the longer one. Characters are code points of words, each counted once, however many n-grams cover it.

A null is an empty text; it has no words and fails the base rules, as any text of under LEAST_WORDS words does. Texts may
be of any length: a batch is cut between texts into pieces of about CHUNK bytes, and a text takes some dozens of bytes
for each of its own. Repeated rows are judged each on its own, other columns pass through, and one that is called like a
figure is an error. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import byte_cuts, small_batches

# N-gram lengths in words, and the percentage of characters that may stand in repeated n-grams of each.
LENGTHS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
# Percentages of a text's lines, and of its characters, that may stand in lines that repeat an earlier one.
LINES, LINE_CHARS = 30, 20
LEAST_WORDS, REPEATED_WORDS = 10, 20
CHUNK = 1 << 22
FIGURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", *[f"repeat_chars_{n}" for n in LENGTHS]]

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _numbers(values: list[bytes]) -> np.ndarray:
    """A number for each value, the same for equal ones."""
    table = dict.fromkeys(values)
    for i, v in enumerate(table):
        table[v] = i
    return np.fromiter(map(table.__getitem__, values), np.int64, len(values))


def _same(at: np.ndarray, keys: np.ndarray, words: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    """Class numbers of the n-grams of words that begin at the places `at`, of one text each: by hash, held against the words."""
    order = np.argsort(keys, kind="stable")
    a, b = at[order[:-1]], at[order[1:]]
    equal = keys[order[1:]] == keys[order[:-1]]
    near = np.flatnonzero(equal)
    true = text_of[a[near]] == text_of[b[near]]
    for k in range(n):
        true &= words[a[near] + k] == words[b[near] + k]
    if not true.all():  # two different n-grams of one hash
        rows = np.column_stack([text_of[at], *(words[at + k] for k in range(n))])
        return np.unique(rows, axis=0, return_inverse=True)[1].ravel()
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], ~equal)))
    return out


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` words stand inside the n-grams that begin at the places `at`."""
    cover = np.bincount(at, minlength=size + 1) - np.bincount(at + n, minlength=size + 1)
    return np.cumsum(cover)[:size] > 0


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The figures of each text. n_repeat_words counts the words inside 5-grams that stand twice or more in the text, first ones too; repeat_chars_n the characters of words inside n-grams that stand in the text before."""
    count = len(texts)
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, count)
    ends = np.cumsum(sizes + 1)
    per_text = lambda marks: np.diff(np.concatenate(([0], np.cumsum(marks, dtype=np.int64)[ends - 1])))
    space = _SPACE[raw]
    edges = np.diff(np.concatenate(([1], space.view(np.int8))))
    starts, stops = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    leads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    chars = leads[stops] - leads[starts]
    text_of = np.searchsorted(ends, starts, side="right")
    words = _numbers(data.split())
    total = lambda of, weights=None: np.bincount(of, weights, count).astype(np.int64)
    out = {"n_words": total(text_of), "word_chars": total(text_of, chars), "n_symbols": per_text(_SYMBOL[raw])}

    # Lines: those with a word, told apart by their bytes; the first of each text's equal ones is no repeat.
    line_ends = np.flatnonzero(raw == 10)
    line_of_word = np.searchsorted(line_ends, starts)
    held = np.unique(line_of_word)
    lines = data.split(b"\n")
    number, owner = _numbers([lines[i] for i in held.tolist()]), np.searchsorted(ends, line_ends[held] + 1)
    first = np.zeros(len(held), bool)
    if len(held):
        first[np.unique(owner * (number.max() + 1) + number, return_index=True)[1]] = True
    repeats = np.zeros(len(line_ends) + 1, bool)
    repeats[held] = ~first
    out |= {"n_lines": total(owner), "n_dup_lines": total(owner, ~first), "dup_line_chars": total(text_of, chars * repeats[line_of_word])}

    # n-grams: the hash of each length from that of the length before.
    left = np.cumsum(out["n_words"])[text_of] - np.arange(len(words))  # words from here to the text's end
    mixed = (words.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    at, rolled, grown = np.arange(len(words)), (text_of.astype(np.uint64) + np.uint64(1)) * _BASE, 0
    for n in LENGTHS:
        fits = left[at] >= n
        at, rolled = at[fits], rolled[fits]
        for k in range(grown, n):
            rolled = rolled * _BASE + mixed[at + k]
        grown = n
        again = np.zeros(0, bool)
        if len(at):
            classes = _same(at, rolled ^ (rolled >> np.uint64(31)), words, text_of, n)
            firsts = np.empty(classes.max() + 1, np.int64)
            firsts[classes[::-1]] = at[::-1]  # of a class the last one written, which is the first in the text, stays
            twice = np.bincount(classes)[classes] > 1
            at, rolled, again = at[twice], rolled[twice], (firsts[classes] != at)[twice]
        if n == 5:
            out["n_repeat_words"] = total(text_of, _covered(at, n, len(words)))
        out[f"repeat_chars_{n}"] = total(text_of, chars * _covered(at[again], n, len(words)))
    return out


def add_figures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The figures of each text, beside the columns `keep` (default: all)."""
    keep = docs.columns if keep is None else keep
    if clash := set(FIGURES) & set(keep):
        raise ValueError(f"a kept column is called {', '.join(sorted(clash))}")
    small_batches(docs.sparkSession)
    names = [*keep, *FIGURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(len(keep)).cast(pa.binary()).to_pylist()]
            for a, b in byte_cuts([len(t) for t in texts], CHUNK):
                got, rows = measure(texts[a:b]), batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), *(pa.array(got[f], pa.int64()) for f in FIGURES)], names)

    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(f, T.LongType()) for f in FIGURES)])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, schema)


def base_failed() -> Column:
    """Too few words, or more than a fifth of them in repeated 5-grams."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_WORDS * F.col("n_words"))


def repetitive() -> Column:
    """More characters than may be stand in repeated n-grams of some length, or more lines or characters in repeated lines."""
    share = lambda part, of, most: 100 * F.col(part) > most * F.col(of)
    found = share("n_dup_lines", "n_lines", LINES) | share("dup_line_chars", "word_chars", LINE_CHARS)
    for n, most in LENGTHS.items():
        found = found | share(f"repeat_chars_{n}", "word_chars", most)
    return found


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """add_figures with base_failed and kept: false where the base rules fail or the text is repetitive."""
    if clash := {"base_failed", "kept"} & set(docs.columns if keep is None else keep):
        raise ValueError(f"a kept column is called {', '.join(sorted(clash))}")
    return add_figures(docs, text, keep).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~repetitive())
