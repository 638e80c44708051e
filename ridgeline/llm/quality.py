"""Quality classifier: interpolated modified Kneser-Ney models of character n-grams, trained on trusted text.

Words of noisy text are open-ended, so the units are characters: every code point is a symbol of its own, in lower case,
but for digits and white space, which are one symbol each. Counts of the n-grams of ORDER are summed by shards of (model,
n-gram); continuation counts, context totals and the interpolated probabilities of each order are joins and aggregations
of those count tables, which grow with the trusted text and know no alphabet beforehand. For scoring, n-grams go by a
64-bit polynomial of their code points. A model of at most MODEL_ROWS rows is sent to every task; a larger one is joined
by shards: each block of documents asks for the n-grams that it holds, and is scored by those rows alone.

A document has a perplexity, and a peak: the perplexity of the stretches of WINDOW symbols that only one in a hundred of
its stretches exceeds, which a few foreign words raise where the mean does not move. Toxic text is made like good text,
so perplexity under trusted text alone hardly tells it. So a second
model of the same kind is trained on text labelled bad, and the ratio of the two perplexities gives two figures more:
contrast, by how many bits a symbol the stretches of CONTRAST_WINDOW are likelier as bad text, at the same rank; and
passage, the greatest mean of those bits over any stretch of PASSAGE symbols (a shorter text counts as one), which
does not thin out with a document's length. One good model holds the trusted text of all languages, as documents mix them.

All figures are held against quantiles of trusted documents of the same language and about the same length that the
models have not seen (a fifth, by a hash of the text; lengths by fifths), as short texts scatter more and the greatest of
many stretches is greater. Documents above any are rejected.

Trusted and bad text is all of it, not a sample. Where a language has fewer than HELD_ALIKE unseen documents
of a length, the threshold is that of the language if it has HELD, then that of the length if it has HELD_ALIKE, then that of
all. Null is no language of its own. Null and empty texts have perplexity and peak 1, the rest 0, and stay. Texts may
be of any length. Without trusted documents nothing can be judged, and all stay. Repeated rows are scored each; ties at a
threshold stay; repeated labels of a document must all be good. Columns of the documents may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import release, small_batches, write_out

ORDER, WINDOW, CONTRAST_WINDOW, PASSAGE = 5, 6, 3, 12
HELD, HELD_ALIKE, MODEL_ROWS = 40, 100, 8_000_000
QUANTILES = {"perplexity": 0.998, "peak": 0.997, "contrast": 0.985, "passage": 0.997}
FIGURES = list(QUANTILES)
CHUNK, BLOCK = 1 << 20, 16 << 20
#: Labels are sent to all tasks up to this number (16 bytes each), so that no text is shuffled to find its label; beyond it they are joined by a shuffle.
LABELS_SENT = 2_000_000
#: Stands before a text's first symbol.
PAD = "\x02"
_B = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """The symbol of each code point of lower-case text."""
    table = np.arange(0x110000, dtype=np.uint32)
    table[[c for c in range(0x110000) if chr(c).isspace()]] = ord(" ")
    table[[c for c in range(0x110000) if chr(c).isdigit()]] = ord("0")
    return table


def symbols_of(text: str) -> np.ndarray:
    return _table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]


def _powers() -> np.ndarray:
    return np.array([pow(_B, i, 1 << 64) for i in range(ORDER)], np.uint64)


class Grams:
    """The n-grams that end at each symbol of some texts (blanks stand before a text)."""

    def __init__(self, texts: list[str]):
        points = [symbols_of(t) for t in texts]
        sizes = np.fromiter(map(len, points), np.int64, len(points))
        pad = np.full(ORDER - 1, ord(PAD), np.uint32)
        self.line = np.concatenate([x for p in points for x in (pad, p)] or [pad])
        self.cut = np.concatenate(([0], np.cumsum(sizes)))
        own = self.cut[:-1] + np.arange(1, len(texts) + 1) * (ORDER - 1)
        self.at = np.repeat(own - self.cut[:-1], sizes) + np.arange(self.cut[-1])
        wide, power = self.line.astype(np.uint64), _powers()
        self.keys = [wide]  # keys[n - 1]: of the n-gram that ends at each place
        for n in range(1, ORDER):
            longer = self.keys[-1].copy()
            longer[n:] += power[n] * wide[:-n]
            self.keys.append(longer)

    def different(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the different n-grams of ORDER, which of them each symbol ends, and how often each stands."""
        _, first, which, n = np.unique(self.keys[-1][self.at], return_index=True, return_inverse=True, return_counts=True)
        return self.at[first], which, n

    def asked(self, places: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, keys of the n-grams that end at the places, keys of their contexts)."""
        for n in range(1, ORDER + 1):
            yield n, self.keys[n - 1][places].view(np.int64), (self.keys[n - 2][places - 1].view(np.int64) if n > 1 else np.zeros(len(places), np.int64))


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > CHUNK or i + 1 == len(texts):
            yield start, i + 1
            start, size = i + 1, 0


def count_ngrams(texts: DataFrame) -> DataFrame:
    """model, text -> model, gram, n of the n-grams of the highest order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for model in sorted(set(models.tolist())):
                own = [texts[i] or "" for i in np.flatnonzero(models == model).tolist()]
                for a, b in _chunks(own):
                    grams = Grams(own[a:b])
                    places, _, n = grams.different()
                    line = grams.line.tobytes().decode("utf-32-le", "replace")
                    found = [line[i - ORDER + 1 : i + 1] for i in places.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([model] * len(n)), pa.array(found, pa.string()), pa.array(n)], ["model", "gram", "n"])

    small_batches(texts.sparkSession)
    return texts.select("model", "text").mapInArrow(run, "model string, gram string, n long").groupBy("model", "gram").agg(F.sum("n").alias("n"))


def train(counts: DataFrame) -> DataFrame:
    """model, size, key, p, back: for each n-gram its interpolated probability; for each context (p null) its weight of the order below. Size 0: the even chance of a symbol."""
    levels, parts = {ORDER: counts}, []
    for size in range(ORDER - 1, 0, -1):
        levels[size] = levels[size + 1].groupBy("model", F.substring("gram", 2, size).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("double")
    even = levels[1].groupBy("model").agg((1.0 / (F.count(F.lit(1)) + 1)).alias("p"))  # a symbol more for all that was not met
    below = even.select(F.col("model").alias("_below"), F.lit("").alias("_suffix"), F.col("p").alias("_p"))
    parts.append(even.select("model", F.lit(0).alias("size"), F.lit("").alias("gram"), "p", none.alias("back")))
    for size in range(1, ORDER + 1):
        level = levels[size].select("model", "gram", "n", F.substring("gram", 1, size - 1).alias("context"))
        times = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)]
        share = F.col("t1") / F.greatest(F.col("t1") + 2 * F.col("t2"), F.lit(1.0))
        discount = lambda i: F.least(F.greatest(i - (i + 1) * share * F.col(f"t{i + 1}") / F.greatest(F.col(f"t{i}"), F.lit(1.0)), F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{i}")
        discounts = level.groupBy("model").agg(*times).select(F.col("model").alias("_m"), discount(1), discount(2), discount(3))  # two rows
        level = level.join(F.broadcast(discounts), F.col("model") == F.col("_m")).withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))).select("model", "gram", "n", "context", "d")
        contexts = level.groupBy(F.col("model").alias("_model"), F.col("context").alias("_context")).agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        level = level.join(contexts, (F.col("model") == F.col("_model")) & (F.col("context") == F.col("_context")))
        level = level.join(below, (F.col("model") == F.col("_below")) & (F.substring("gram", 2, size - 1) == F.col("_suffix")))
        level, _ = write_out(level.select("model", "gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("left") / F.col("total") * F.col("_p")).alias("p")), "ngrams")
        below = level.select(F.col("model").alias("_below"), F.col("gram").alias("_suffix"), F.col("p").alias("_p"))
        number = F.lit(size).alias("size")
        parts += [level.select("model", number, "gram", "p", none.alias("back")), contexts.select(F.col("_model").alias("model"), number, F.col("_context").alias("gram"), none.alias("p"), (F.col("left") / F.col("total")).alias("back"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = _powers()
        for batch in batches:
            grams = batch.column(2).to_pylist()
            wide, keys = np.fromiter(map(len, grams), np.int64, len(grams)), np.zeros(len(grams), np.uint64)
            for n in range(1, ORDER + 1):
                own = np.flatnonzero(wide == n)
                points = np.frombuffer("".join(grams[i] for i in own.tolist()).encode("utf-32-le"), np.uint32).reshape(-1, n)
                keys[own] = (points.astype(np.uint64) * power[:n][::-1]).sum(1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys.view(np.int64)), batch.column(3), batch.column(4)], ["model", "size", "key", "p", "back"])

    return out.select("model", "size", "gram", "p", "back").mapInArrow(keyed, "model string, size int, key long, p double, back double")


class Model:
    """One model's tables as sorted arrays."""

    def __init__(self, rows: pa.Table, even: float | None = None):
        size, key, p, back = (rows.column(c).to_numpy() for c in ("size", "key", "p", "back"))
        self.even, self.levels = float(p[size == 0].max(initial=0.0)) if even is None else even, []
        for n in range(1, ORDER + 1):
            level = []
            for own, value in (((size == n) & ~np.isnan(p), p), ((size == n) & ~np.isnan(back), back)):
                sort = np.argsort(key[own])
                level += [key[own][sort], value[own][sort].astype(np.float32)]
            self.levels.append(level)

    @staticmethod
    def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return i, keys[i] == wanted

    def bits(self, grams: Grams, places: np.ndarray) -> np.ndarray:
        """Surprise at the symbol at each place."""
        p = np.full(len(places), self.even)
        for (known, own, contexts, back), (_, gram, context) in zip(self.levels, grams.asked(places)):
            j, seen = self._at(contexts, context)
            if seen.any():
                p[seen] *= back[j[seen]]
                i, has = self._at(known, gram)
                p[has] = own[i[has]]
        return -np.log2(p)


class Scorer:
    """The good model, and the bad one if there is one."""

    def __init__(self, rows: pa.Table, evens: dict[str, float] | None = None):
        """evens: the even chances, where rows don't hold them."""
        own = ((n, rows.filter(pc.equal(rows.column("model"), n)).drop_columns(["model"])) for n in ("good", "bad"))  # one at a time
        self.good, self.bad = (Model(t, evens and evens[n]) if t.num_rows else None for n, t in own)

    @staticmethod
    def _upper(total: np.ndarray, cut: np.ndarray, width: int, mean: np.ndarray, rank: float) -> np.ndarray:
        """Of each text the mean of the stretches of `width` at this rank among its stretches."""
        out = mean.copy()
        for i in np.flatnonzero(np.diff(cut) > width).tolist():
            own = total[cut[i] : cut[i + 1] + 1]
            stretch = (own[width:] - own[:-width]) / width
            at = min(len(stretch) - 1, int(rank * len(stretch)))
            out[i] = np.partition(stretch, at)[at]
        return out

    def score(self, texts: list[str]) -> list[np.ndarray]:
        """The FIGURES of each text."""
        grams = Grams(texts)
        cut, sizes = grams.cut, np.diff(grams.cut)
        if not cut[-1]:
            return [np.ones(len(texts))] * 2 + [np.zeros(len(texts))] * 2
        places, which, _ = grams.different()
        good = self.good.bits(grams, places)
        more = good - self.bad.bits(grams, places) if self.bad else np.zeros(len(places))
        totals = [np.concatenate(([0.0], np.cumsum(bits[which]))) for bits in (good, more)]
        means = [(t[cut[1:]] - t[cut[:-1]]) / np.maximum(sizes, 1) for t in totals]
        peak = self._upper(totals[0], cut, WINDOW, means[0], 0.99)
        contrast, passage = (self._upper(totals[1], cut, width, means[1], rank) for width, rank in ((CONTRAST_WINDOW, 0.99), (PASSAGE, 1.0)))
# Rounded, so that a text has the same figures beside whatever others it is scored, and ties at a threshold stay.
        return [np.round(x, 6) for x in (2.0 ** means[0], 2.0**peak, contrast, passage)]


def _scored(batch: pa.RecordBatch, scorer: Scorer, first: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns from `first` on, and the figures of the texts in column 0."""
    texts = batch.column(0).to_pylist()
    for a, b in _chunks(texts):
        rows = batch.slice(a, b - a)
        yield pa.RecordBatch.from_arrays([*rows.columns[first:], *map(pa.array, scorer.score([t or "" for t in texts[a:b]]))], names)


def _shared(spark: SparkSession, model: DataFrame) -> Broadcast:
    """The scorer of a model, for all tasks. Its rows come to the driver no wider than the scorer keeps them, and Arrow gives back what they took there."""
    narrow = model.where("size > 0").select("model", *[F.col(c).cast(kind).alias(c) for c, kind in (("size", "byte"), ("key", "long"), ("p", "float"), ("back", "float"))])
    evens = {r.model: r.p for r in model.where("size = 0").select("model", "p").collect()}  # two rows
    shared = spark.sparkContext.broadcast(Scorer(narrow.toArrow(), evens))
    release(spark)
    pa.default_memory_pool().release_unused()
    return shared


def score(docs: DataFrame, model: DataFrame, text: str = "text", whole: bool = False, most: int = MODEL_ROWS) -> DataFrame:
    """docs with the FIGURES; without the text, unless `whole`. Texts cross to Python and back once."""
    spark, others = docs.sparkSession, [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in ([text] * whole + others)), *(T.StructField(f, T.DoubleType()) for f in FIGURES)])
    docs, first, names = docs.select(*[F.col(f"`{c}`") for c in (text, *others)]), int(not whole), schema.names
    small_batches(spark)

    if model.count() <= most:
        shared = _shared(spark, model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _scored(batch, shared.value, first, names)

        return docs.mapInArrow(run, schema)

    size = docs.agg(F.coalesce(F.sum(F.octet_length(f"`{text}`")), F.lit(0))).first()[0]
    # Written, as both sides read it: a block that was dealt anew would be scored by another block's n-grams. Numbers of rows deal equal rows out too.
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 + size // BLOCK))
    dealt, _ = write_out(docs.select(F.col(f"`{docs.columns[0]}`").alias("_text"), *docs.columns[1:], block.alias("_block")), "dealt")
    dealt = dealt.select(F.col("_text").alias(text), *docs.columns[1:], "_block")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which rows of the model each block needs."""
        for batch in batches:
            blocks, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for b in np.unique(blocks):
                own = [texts[i] or "" for i in np.flatnonzero(blocks == b).tolist()]
                for i, j in _chunks(own):
                    grams = Grams(own[i:j])
                    if not grams.cut[-1]:
                        continue
                    for n, gram, context in grams.asked(grams.different()[0]):
                        for key, kind in ((np.unique(gram), 0), (np.unique(context), 1)):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), x, t)) for x, t in ((b, np.int64), (n, np.int32), (kind, np.int32))] + [pa.array(key)], ["_block", "_size", "_kind", "_key"])

    wanted = dealt.select("_block", F.col(f"`{text}`")).mapInArrow(asked, "_block long, _size int, _kind int, _key long").distinct()
    kind = F.col("p").isNull().cast("int")
    part = model.where("size > 0").join(wanted, (F.col("size") == F.col("_size")) & (F.col("key") == F.col("_key")) & (kind == F.col("_kind"))).select("_block", "model", "size", "key", "p", "back")
    even = model.where("size = 0").crossJoin(spark.range(1 + size // BLOCK).select(F.col("id").alias("_block"))).select("_block", "model", "size", "key", "p", "back")  # two rows a block
    empty = docs.limit(0).select(*[F.col(f"`{c}`") for c in docs.columns[first:]], *[F.lit(0.0).alias(f) for f in FIGURES]).toArrow()

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        scorer = Scorer(right)
        return pa.Table.from_batches([r for b in left.drop_columns(["_block"]).combine_chunks().to_batches() for r in _scored(b, scorer, first, names)])

    return dealt.groupBy("_block").cogroup(part.unionByName(even).groupBy("_block")).applyInArrow(pair, schema)


def _judged(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, model_rows: int, whole: bool) -> DataFrame:
    """Columns of docs under their places' names (c0, ...), the FIGURES, and keep; without the text, unless `whole`."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    key_of, text_of, lang_of = (names[c] for c in (key, text, lang))
    marks = labels.groupBy(F.col(f"`{key}`").alias("_of")).agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("_good"))
    marks, _ = write_out(marks.where("_of is not null and _good is not null"), "marks")
    marks = F.broadcast(marks) if marks.count() <= LABELS_SENT else marks
    plain = rows.select(F.col(key_of).alias("_key"), F.coalesce(text_of, F.lit("")).alias("text"), F.col(lang_of).cast("string").alias("_lang"))
    marked, _ = write_out(plain.join(marks, F.col("_key") == F.col("_of")).select("text", "_lang", "_good", F.pmod(F.xxhash64("text", F.lit(11)), F.lit(5)).alias("fold")), "marked")
    trusted = marked.where("_good = 1")
    if trusted.where("fold <> 0 and text <> ''").isEmpty():
        out = rows.select(*[c for c in rows.columns if whole or c != text_of])
        return out.select("*", *[F.lit(1.0 if f in ("perplexity", "peak") else 0.0).alias(f) for f in FIGURES], F.lit(True).alias("keep"))
    seen = marked.where("fold <> 0").select(F.when(F.col("_good") == 1, "good").otherwise("bad").alias("model"), "text")
    counts, _ = write_out(count_ngrams(seen), "counts")
    model, _ = write_out(train(counts), "model")
    release(docs.sparkSession)
    held = trusted.where("fold = 0")
    edges = held.agg(F.percentile_approx(F.char_length("text"), [0.2, 0.4, 0.6, 0.8], 100_000)).first()[0] or []
    length = lambda c: sum((F.when(F.char_length(c) > e, 1).otherwise(0) for e in edges), F.lit(0))
    held, _ = write_out(score(held.select("text", "_lang", length("text").alias("length")), model, most=model_rows), "held")
    keep = _within(held)
    scored = score(rows.withColumns({"_lang": F.col(lang_of).cast("string"), "_length": length(F.coalesce(text_of, F.lit("")))}), model, text_of, whole, model_rows)
    return scored.withColumn("keep", keep(F.col("_lang"), F.col("_length"))).drop("_lang", "_length")


def _within(held: DataFrame) -> Callable[[Column, Column], Column]:
    """held: _lang, length and the FIGURES of unseen trusted documents. Returns what says, of a language and a length, whether the figures are within the thresholds.

    What reaches the driver is a row for each language of at least HELD of them and each of five lengths."""
    each = held.withColumn("lang", F.explode(F.array_distinct(F.array(F.coalesce("_lang", F.lit("")), F.lit(""))))).withColumn("length", F.explode(F.array("length", F.lit(-1))))
    limits = each.groupBy("lang", "length").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(f, QUANTILES[f], 100_000).alias(f) for f in FIGURES])
    found = limits.where((F.col("n") >= F.when(F.col("length") < 0, HELD).otherwise(HELD_ALIKE)) | ((F.col("lang") == "") & (F.col("length") < 0))).collect()

    def keep(lang: Column, length: Column) -> Column:
        out = F.lit(True)
        for r in sorted(found, key=lambda r: (r.lang != "", r.length >= 0)):  # the nearest last, which is asked first
            own = F.lit(True) if r.length < 0 else length == r.length
            own = own & (F.lit(True) if r.lang == "" else lang.eqNullSafe(F.lit(r.lang)))
            out = F.when(own, (F.col("perplexity") <= r.perplexity) & (F.col("peak") <= r.peak) & (F.col("contrast") <= r.contrast) & (F.col("passage") <= r.passage)).otherwise(out)
        return out

    return keep


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model_rows: int = MODEL_ROWS) -> DataFrame:
    """key, lang, the FIGURES and keep of every row. labels: key, quality, toxic (good: 1 and 0)."""
    docs = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((key, text, lang))])
    judged = _judged(docs, labels, key, text, lang, model_rows, False)
    return judged.select(*[F.col(f"c{docs.columns.index(c)}").alias(c) for c in (key, lang)], *FIGURES, "keep")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model_rows: int = MODEL_ROWS) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns."""
    judged = _judged(docs, labels, key, text, lang, model_rows, True)
    return judged.where("keep").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
