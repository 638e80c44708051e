import random

from ridgeline.llm import bpe
from ridgeline.llm.queries import op8_token_counts, ranks_path
from ridgeline.llm.token_counts import Store


def test_deltas_like_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    store, truth, schema = Store(spark, f"file://{tmp_path}/s", buckets=3), {}, "doc_id long, source string, lang string, tokenizer string, n_tokens long, text string, bucket string"
    assert store.totals().collect() == [] and store.compact() is None
    for batch in range(5):
        new = [(rng.randrange(30), rng.choice(["a", None]), rng.choice(["en", "de"]), rng.choice(["1", "2", None]), rng.choice([None, 0, 5, 9]), "x", "x") for _ in range(30 if batch else 60)]
        gone = [(rng.randrange(35), rng.choice(["1", "2", None])) for _ in range(8)]
        rows = {}
        for r in new:
            figures = (r[1], r[2], r[4] or 0)
            key = lambda f: (f[0] is not None, f[0] or "", *f[1:])
            rows[r[0], r[3]] = max(rows.get((r[0], r[3]), figures), figures, key=key)
        one_version = batch % 2
        for d, v in gone:
            for k in list(truth):
                if k[0] == d and (not one_version or k[1] == v):
                    truth.pop(k)
        truth.update(rows)
        deletes = spark.createDataFrame([*gone, (None, "1")], "doc_id long, tokenizer string")
        args = dict(inserts=spark.createDataFrame([*new, (None, "a", "en", "1", 3, "x", "x")], schema), deletes=deletes if one_version else deletes.drop("tokenizer"))
        assert store.commit(f"b{batch}", **args)
        assert not store.commit(f"b{batch}", **args)
        if batch in (1, 3):
            assert store.compact() == store.compact()
        want = {}
        for (_, tokenizer), (source, lang, n) in truth.items():
            docs, tokens = want.get((source, lang, tokenizer), (0, 0))
            want[source, lang, tokenizer] = docs + 1, tokens + n
        assert {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()} == want
        assert {(r.doc_id, r.tokenizer): (r.source, r.lang, r.n_tokens) for r in store.state().collect()} == truth
    assert store.batches() == ["b0", "b1", "b2", "b3", "b4"]
    assert not store.commit("b0", **args)


def test_a_commit_reads_only_its_buckets(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=8)
    schema = "doc_id long, source string, lang string, tokenizer string, n_tokens long"
    store.commit("all", inserts=spark.createDataFrame([(i, "a", "en", "1", 5) for i in range(200)], schema))
    seen = []
    whole = store._read
    store._read = lambda table, kind: seen.append(whole(table, kind)) or seen[-1]
    store.commit("one", inserts=spark.createDataFrame([(3, "b", "en", "1", 6)], schema))
    own = seen[0].where(f"bucket = {spark.range(1).selectExpr('pmod(xxhash64(3L), 8)').first()[0]}")
    assert 0 < own.count() < 80 and "PartitionFilters: [isnotnull(bucket" in own._jdf.queryExecution().explainString(own._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert {tuple(r) for r in store.totals().collect()} == {("a", "en", "1", 199, 995), ("b", "en", "1", 1, 6)}


def test_query_like_the_library(spark):
    """op8's totals against counts by the library, kept plainly."""
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks_path()), special_tokens={})
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    met, want = set(), {}
    for d in docs:
        if d.text is not None and d.text in met:
            continue
        met.add(d.text)
        n = len(library.encode_ordinary(d.text or ""))
        for version, more in (("byte_bpe_multi_50k", 0), ("byte_bpe_multi_50k+bos", 1)):
            m, total = want.get((d.source, d.lang, version), (0, 0))
            want[d.source, d.lang, version] = m + 1, total + n + more
    assert {tuple(r)[:3]: tuple(r)[3:] for r in op8_token_counts(spark, folder).collect()} == want


def test_broken_commit_is_written_over(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(1, "a", "en", "1", 5)], "doc_id long, source string, lang string, tokenizer string, n_tokens long")
    rows.selectExpr("doc_id", "source", "lang", "tokenizer", "n_tokens * 9 as n_tokens", "1L as sign", "0 as bucket").write.partitionBy("bucket").parquet(f"{store.path}/ledger/b")
    assert store.totals().collect() == []
    store.commit("b", inserts=rows)
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "1", 1, 5)]
