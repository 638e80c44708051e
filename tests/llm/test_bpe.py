import random

import pytest

from ridgeline.llm import bpe
from ridgeline.llm.queries import ranks_path

ALPHABET = "aZé 's'tré'll' \n\t  \r1²x漢😀've'm'd!?ſ ´日本a9_-"
CASES = ["", " ", "  ", "\n", "'", "''", "'s", "''s", " 's", "\n's", "  's", "a's's", "it'll've 're'l", "'l", "a 'r", "x  y", "a  \n", "ab" * 5000, "!" * 3000, " " * 2000 + "x", "日本語" * 400]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks_path()), special_tokens={})


def test_like_the_library(spark, reference):
    rng = random.Random(3)
    texts = [*CASES, *("".join(rng.choices(ALPHABET, k=rng.randrange(60))) for _ in range(3000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "id")
    got = bpe.decode(bpe.encode(docs, ranks_path()), ranks_path()).collect()
    assert len(got) == len(rows)
    at_once = {(r.id, r.text): (r.token_ids, r.token_offsets, r.decoded) for r in bpe.encode(docs, ranks_path(), decoded="decoded").collect()}
    for r in got:
        text = r.text or ""
        assert at_once[r.id, r.text] == (r.token_ids, r.token_offsets, r.decoded)
        assert list(r.token_ids) == reference.encode_ordinary(text), repr(text)
        assert bytes(r.decoded) == text.encode()


def test_empty_table_and_clashing_column(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, token_ids int")
    with pytest.raises(ValueError):
        bpe.encode(docs, ranks_path())
    assert bpe.encode(docs, ranks_path(), keep=["doc_id"]).collect() == []
