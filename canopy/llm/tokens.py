"""Encoding texts with a public tokenizer: tiktoken over a local rank file, in Arrow batches.

Long texts are split where the tokenizer's own pattern always splits: before a space
or line break that follows a visible ASCII character, a letter or a digit. A token
holds white space only at its beginning, so no token spans such a place and the ids
of the pieces, joined, are the ids of the text.

Defined results: null and empty texts give the empty list. Strings of special tokens
are ordinary text. Ids turn back into the very bytes of the text (``decode``); bytes
that are no UTF-8 by themselves stay bytes.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The folder of the rank files on every machine; a parameter of every function here.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Fixed value of the public vocabulary: the pattern that splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts from this many characters on are split first, into pieces of about this size.
LONG = 1 << 16
SAFE = regex.compile(r"(?<=[!-~\p{L}\p{N}])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> tiktoken.Encoding:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """``text`` in parts of about ``long`` characters, cut at safe places only."""
    start = 0
    while len(text) - start > long:
        m = SAFE.search(text, start + long)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str | None, enc: tiktoken.Encoding, long: int = LONG) -> list[int]:
    if not text:
        return []
    if len(text) <= long:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text, long) for i in enc.encode_ordinary(p)]


def _mapper(name: str, folder: str, keep: list[str], count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            if count_only:
                col = pa.array([len(encode(t, enc)) for t in texts], pa.int64())
            else:
                col = pa.array([encode(t, enc) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], col], names=[*keep, "out"])

    return run


def _apply(df: DataFrame, text: str, keep: list[str], out: str, kind: T.DataType, count_only: bool, name: str, folder: str) -> DataFrame:
    slim = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("out", kind, False)])
    return slim.mapInArrow(_mapper(name, folder, keep, count_only), schema).withColumnRenamed("out", out)


def token_ids(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and the list of token ids of each text."""
    return _apply(df, text, list(keep), out, T.ArrayType(T.IntegerType(), False), False, name, folder)


def token_counts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "n_tokens", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and the number of tokens of each text (0 for null and empty)."""
    return _apply(df, text, list(keep), out, T.LongType(), True, name, folder)


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), out: str = "bytes", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The bytes that lists of ids stand for (null for null, empty for the empty list)."""

    def run(batches):
        enc = encoding(name, folder)
        for b in batches:
            col = pa.array([None if i is None else enc.decode_bytes(i) for i in b.column(b.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], col], names=[*keep, "out"])

    slim = df.select(*keep, F.col(ids).alias("__ids"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("out", T.BinaryType())])
    return slim.mapInArrow(run, schema).withColumnRenamed("out", out)
