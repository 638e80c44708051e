"""One query for each numbered operator, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import alignment, bpe, decontaminate, lines, quality, repeats, repetition, search, sharding, simhash, token_counts, warc, winnow
from ridgeline.llm.common import new_path, numbered, read_table, text_of, write_out


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.encode(read_table(spark, sf_dir, "documents"), ranks_path(), keep=["doc_id"], decoded="decoded")
    return tokens.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    judged = quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.where("keep").select("doc_id", "lang", *[F.round(f, 4).alias(f) for f in quality.FIGURES])


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = winnow.compare_with_next(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text_of(), 256)).alias("same"),
    )
    return sharding.shard(docs, "doc_id", "size", "same", shards=16).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed, _ = write_out(simhash.fingerprint(read_table(spark, sf_dir, "documents"), keep=["doc_id"]), "hashed")
    return simhash.near_duplicates(hashed).select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after seven commits: all documents with their sizes in bytes, which are revised to what op1's tokenizer counts; copies of earlier texts deleted; the rest counted under a further version, which sets a token before each text; and the last two once more, before and after a compaction, which must change nothing."""
    docs = read_table(spark, sf_dir, "documents")
    store = token_counts.Store(spark, new_path(spark, "rollup"))
    tokens = bpe.encode(docs.select("doc_id", "source", "lang", "text"), ranks_path(), keep=["doc_id", "source", "lang"])
    first = docs.select("doc_id", "source", "lang", F.octet_length(text_of()).cast("long").alias("n_tokens"), F.lit("byte_bpe_multi_50k").alias("tokenizer"))
    counted, _ = write_out(tokens.select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), F.lit("byte_bpe_multi_50k").alias("tokenizer")), "counted")
    same = docs.select("doc_id", F.sha2("text", 256).alias("same")).where("same is not null")
    firsts = same.groupBy("same").agg(F.min("doc_id").alias("first"))
    copies, _ = write_out(same.join(firsts, "same").where("doc_id > first").select("doc_id"), "copies")
    anew = counted.join(copies, "doc_id", "left_anti").withColumns({"n_tokens": F.col("n_tokens") + 1, "tokenizer": F.lit("byte_bpe_multi_50k+bos")})
    store.commit("0000", inserts=first)
    store.commit("0001", inserts=counted)
    store.commit("0002", deletes=copies)
    store.commit("0003", inserts=anew)
    store.commit("0002", deletes=copies)
    store.compact()
    store.commit("0003", inserts=anew)
    return store.totals()


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(read_table(spark, sf_dir, "pages"), path)
    page = lambda c: F.element_at(F.split(c, ":"), -1).try_cast("long")
    return warc.read_warc(spark, path).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup_lines(read_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=50)


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
_OP11 = f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY ALL), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM n), m AS (SELECT doc_id, 100 - 50 + (50 * n * n_docs) // n_words AS m FROM n, c),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
q AS (SELECT DISTINCT item_id, {_TERMS} FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50"""


def op12_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.judge(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "dup_line_chars", *[f"repeat_chars_{n}" for n in repetition.LENGTHS])


_WORD = r"[^\x20\x09-\x0D]"
_OP12 = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}+') AS ws FROM t),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
lengths AS (SELECT unnest([{", ".join(map(str, repetition.LENGTHS))}]) AS n),
gram AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, lengths)),
twice AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n, g ORDER BY i) AS k FROM gram QUALIFY count(*) OVER (PARTITION BY doc_id, n, g) > 1),
inside AS (SELECT doc_id, n, i, bool_or(again) AS again FROM (SELECT doc_id, n, k > 1 AS again, unnest(range(i, i + n)) AS i FROM twice) GROUP BY ALL),
cover AS (SELECT doc_id, count(*) FILTER (n = 5) AS n_repeat_words, {", ".join(f"sum(length(word)) FILTER (n = {n} AND again) AS c{n}" for n in repetition.LENGTHS)} FROM inside JOIN word USING (doc_id, i) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM t),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_dup_lines, coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) FILTER (k > 1), 0)::BIGINT AS dup_line_chars
 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM line WHERE regexp_matches(line, '{_WORD}')) GROUP BY doc_id),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
 coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce(c{n}, 0)::BIGINT AS repeat_chars_{n}" for n in repetition.LENGTHS)} FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {repetition.REPEATED_WORDS} * n_words AS base_failed FROM f)
SELECT *, NOT (base_failed OR 100 * n_dup_lines > {repetition.LINES} * n_lines OR 100 * dup_line_chars > {repetition.LINE_CHARS} * word_chars OR {" OR ".join(f"100 * repeat_chars_{n} > {most} * word_chars" for n, most in repetition.LENGTHS.items())}) AS kept FROM b"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    docs = numbered(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    found = alignment.align(docs, *paths, ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "pair_links"], keep=["_doc", "doc_id"])
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    aligned, _ = write_out(found.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    counts, _ = write_out(alignment.pair_counts(aligned), "pair-counts")
    summed = alignment.add_link_counts(aligned, counts, ["_doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return summed.drop("_doc")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_quality, op3_winnowing, op4_sharding, op5_decontamination, op6_simhash, op7_suffix_dedup, op8_token_counts, op9_warc, op10_line_dedup, op11_search, op12_repetition, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    """SQL has no byte-pair merges, n-gram models, bit masks, suffix arrays or archives; tests hold the other queries against plain versions."""
    return {"op11_search": _OP11, "op12_repetition": _OP12}
