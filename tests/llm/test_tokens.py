import time

import pytest

from canopy.llm import tokens

TEXTS = [None, "", " ", "\t\n ", "hello world", "it's  fine\r\n\r\n x", "日本語のテキスト 😂😂", "<|endoftext|>", "a\u0000b", "   x", "é", "� end"]


def test_ids_and_bytes(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    ids = tokens.token_ids(df)
    got = {r.doc_id: r.ids for r in ids.collect()}
    enc = tokens.encoding()
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert {r.doc_id: bytes(r.bytes) for r in tokens.decode(ids).collect()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert tokens.token_ids(df.limit(0)).count() == 0
    assert [r.bytes for r in tokens.decode(spark.createDataFrame([(1, None), (2, [244])], "doc_id long, ids array<int>")).orderBy("doc_id").collect()] == [None, bytearray(enc.decode_bytes([244]))]


@pytest.mark.parametrize("long", [1, 3, 7, 20])
def test_split_texts_encode_as_whole_ones(spark, sf, long):
    enc = tokens.encoding()
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text][:60] + [t for t in TEXTS if t]
    for t in texts:
        assert "".join(tokens.pieces(t, long)) == t
        assert tokens.encode(t, enc, long) == enc.encode_ordinary(t)


def test_very_long_texts():
    enc = tokens.encoding()
    t = "the shard 12 moved,\n\n   it's odd " * 20_000
    began = time.time()
    assert enc.decode_bytes(tokens.encode(t, enc)) == t.encode()
    one_word = "ab" * 200_000
    assert enc.decode_bytes(tokens.encode(one_word, enc)) == one_word.encode()
    assert time.time() - began < 60
