import pytest

pytest.importorskip("tiktoken")
from pyspark.sql import functions as F

from millrace.llm import encode
from millrace.llm.vocab import TOKENIZER_DIR, encoding

SCHEMA = "doc_id long, text string, word string, ids string, text_key string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", 1) for i, t in rows], SCHEMA)


TEXTS = [
    (1, "It's a test, isn't it?  \n\n  Two   spaces\tand tabs "), (2, ""), (3, None), (4, "größer 编译器 emoji 🦀🦀 \u200b x"), (5, "the the the 'the 've I've"), (6, " \n"),
    (7, "<|endoftext|> is ordinary"), (8, "word " * 40_000), (9, "0123456789" * 500), (None, "no id"), (11, "a" * 5000),
]


def test_equals_the_tokenizer(spark):
    enc = encoding("byte_bpe_50k", TOKENIZER_DIR)
    for share in (1e-4, 0.9):
        got = {r.doc_id: list(r.ids) for r in encode.encode_corpus(frame(spark, TEXTS), hot_share=share).collect()}
        assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in TEXTS}


def test_round_trip(spark):
    ids = encode.encode_corpus(frame(spark, [x for x in TEXTS if x[0]]))
    got = {r.doc_id: r.text for r in encode.decode_corpus(ids).collect()}
    assert got == {i: t or "" for i, t in TEXTS if i}


def test_repeated_rows_and_ids(spark):
    rows = [(1, "same text"), (1, "same text"), (1, "other text"), (2, "same text"), (3, ""), (3, "")]
    got = sorted((r.doc_id, len(r.ids)) for r in encode.encode_corpus(frame(spark, rows)).collect())
    assert got == [(1, 2), (1, 2), (1, 2), (2, 2), (3, 0), (3, 0)]


def test_empty_table(spark):
    assert encode.encode_corpus(frame(spark, [])).count() == 0
    assert encode.decode_corpus(encode.encode_corpus(frame(spark, []))).count() == 0


def test_all_null(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert [list(r.ids) for r in encode.encode_corpus(df).collect()] == [[], [], []]
