"""Push ids and routing hashes."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the alphabet of push ids, in order.
ALPHABET = "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"


def push_id_millis(key: Column) -> Column:
    """Milliseconds in the first eight characters of a push id; null for other keys."""
    total = F.lit(0).cast("bigint")
    for i in range(8):
        total = total * 64 + (F.instr(F.lit(ALPHABET), F.substring(key, i + 1, 1)) - 1)
    return F.when(F.rlike(key, F.lit("^[A-Za-z0-9_-]{20}$")), total)


def push_time(ms: Column) -> Column:
    """The eight characters that stand for milliseconds."""
    return F.concat(*[F.substring(F.lit(ALPHABET), (F.shiftright(ms.cast("bigint"), 6 * i).bitwiseAND(F.lit(63)) + 1).cast("int"), F.lit(1)) for i in range(7, -1, -1)])


def push_id(ms: Column, seed: Column) -> Column:
    """A push id per row: the time, then twelve characters from a 128-bit hash of ``seed``.

    Ids of one millisecond order by hash, not by arrival: rows are made in parallel.
    """
    h = F.sha2(seed.cast("string"), 256)
    tail = [F.substring(F.lit(ALPHABET), (F.conv(F.substring(h, 1 + 4 * i, 4), 16, 10).cast("int").bitwiseAND(F.lit(63)) + 1), F.lit(1)) for i in range(12)]
    return F.concat(push_time(ms), *tail)


def fnv1a32(text: Column | str) -> Column:
    """FNV-1a, 32 bits, of the UTF-8 bytes."""
    raw = F.encode(text, "UTF-8")
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("bigint")
    places = F.when(F.octet_length(raw) > 0, F.sequence(F.lit(1), F.octet_length(raw))).when(raw.isNotNull(), F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0x811C9DC5).cast("bigint"), lambda h, i: ((h.bitwiseXOR(byte(i))) * 0x01000193).bitwiseAND(F.lit(0xFFFFFFFF)))


@F.pandas_udf(T.StringType())
def xxh64_hex(text: pd.Series) -> pd.Series:
    """xxHash64 with seed 0, as 16 hex digits."""
    return text.map(lambda t: None if t is None else f"{xxhash.xxh64_intdigest(t.encode('utf-8', 'replace')):016x}")


def core_of(text: Column, cores: int) -> Column:
    """The core a database runs on: its xxHash64 modulo the number of cores."""

    @F.pandas_udf(T.IntegerType())
    def core(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) % cores).astype("Int32")

    return core(text)
