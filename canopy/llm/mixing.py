"""Mixing sources to target shares by a low-discrepancy schedule.

The mix is a row of slots of ``BLOCK`` tokens each. Slot i maps the golden-ratio point
frac((i + 1/2) g) through the sources' cumulative shares, so every stretch of the mix holds the
sources in about their shares. A source's documents, shuffled by a seeded hash, are packed
into blocks of ``BLOCK`` tokens; the slots drawn for a source are ranked, and the k-th takes
the k-th block, starting over when the blocks are used up (the next repeat). Which blocks occur
and how often follows from the slots drawn; a slot beyond a source's last repeat stays empty.

The number of slots is that of the total at which all shares are met exactly: the least of
``max_repeats * tokens / share`` over the sources that have tokens. With a given ``total`` the
sources that cannot fill their share give what they have. Shares stray from their targets by
the sequence's discrepancy (less than log n slots of n) and by a document per block.

Defined results: documents without tokens, without source or of a source without
target are not chosen; a target without documents gets none, and the other shares are
met in proportion; no targets or no documents give empty results. A document belongs to the
block in which its first token lies. Repeated ids count as documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: frac of the golden ratio, as a 64-bit fraction.
GOLDEN = 0x9E3779B97F4A7C15
#: Tokens of a block, and of the slot it fills: a fixed number, whatever the size of the mix.
BLOCK = 128
#: Documents per hash bucket that the running sums are cut into.
PER_BUCKET = 1 << 14


def shuffled_offsets(docs: DataFrame, size: str, seed: int = 42, per_bucket: int = PER_BUCKET) -> DataFrame:
    """``docs`` with ``start``: the tokens of the source's documents before it in shuffled order.

    The order is that of a 64-bit hash; its leading bits are the bucket. Sums inside a
    bucket and the few bucket totals make the running sum, so no source is one group.
    The bucket count follows the number of rows, but the order, and so the result, does not.
    """
    n = docs.count()
    bits = max(0, (max(n, 1) // per_bucket).bit_length())
    h = docs.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "source")).withColumn("_b", F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long"))
    h = h.withColumn("_u", F.col("_h").bitwiseXOR(F.lit(-(2**63))))  # signed order of the unsigned hash
    inner = Window.partitionBy("source", "_b").orderBy("_u", "doc_id", size)
    rows = h.withColumn("_in", F.sum(size).over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    sums = h.groupBy("source", "_b").agg(F.sum(size).alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_s")
    joined = rows.join(before, ["source", "_b"])
    return joined.withColumn("start", F.coalesce("_in", F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_h", "_b", "_u", "_in", "_before")


def quotas(docs: DataFrame, targets: DataFrame, size: str, total: int | None = None) -> DataFrame:
    """Per target source: share, max_repeats, its tokens, and the tokens it gives (``quota``)."""
    have = docs.groupBy("source").agg(F.sum(size).alias("tokens"))
    t = targets.filter("source is not null and target_share > 0").select("source", "target_share", "max_repeats").join(have, "source", "left")
    t = t.withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("most", F.col("tokens") * F.greatest("max_repeats", F.lit(0)))
    every = Window.partitionBy(F.lit(1))  # as many rows as targets
    whole = F.lit(total).cast("double") if total is not None else F.min(F.when(F.col("most") > 0, F.col("most") / F.col("target_share"))).over(every)
    return t.withColumn("quota", F.coalesce(F.least(F.col("most").cast("double"), F.floor(F.col("target_share") * whole + 1e-6).cast("double")), F.lit(0.0)))


def schedule(spark, plan: DataFrame, block: int) -> DataFrame:
    """(slot, source, k): the slots of the mix, and for each source their rank k from 0.

    ``plan`` is the result of :func:`quotas` (a row per target). Slots are ranked per source
    in chunks, so that no source's slots are one group.
    """
    rows = [r for r in plan.select("source", "quota").orderBy("source").collect() if r.quota > 0]
    if not rows:
        return spark.createDataFrame([], "slot long, source string, k long")
    whole = sum(r.quota for r in rows)
    slots = spark.range(int(-(-whole // block))).select(F.col("id").alias("slot"), F.expr(f"pmod(cast((id + 0.5) as double) * {GOLDEN / 2**64!r}, 1.0)").alias("u"))
    edge, source = 0.0, F.lit(rows[-1].source)
    pairs = []
    for r in rows[:-1]:
        edge += r.quota / whole
        pairs.append((edge, r.source))
    for e, name in reversed(pairs):
        source = F.when(F.col("u") < e, F.lit(name)).otherwise(source)
    s = slots.select("slot", source.alias("source"), F.expr("slot div 65536").alias("chunk"))
    per = s.groupBy("source", "chunk").agg(F.count("*").alias("c"))
    before = per.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    k = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1 + F.col("before")
    return s.join(before, ["source", "chunk"]).select("slot", "source", k.cast("long").alias("k"))


def mix(docs: DataFrame, targets: DataFrame, size: str = "n_tokens", total: int | None = None, block: int = BLOCK, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(occurrences, plan). ``docs`` has doc_id, source and ``size``; give it written, it is read several times.

    occurrences: slot, source, doc_id, ``size``, pass (from 0), one row per time a document occurs.
    """
    spark = docs.sparkSession
    wanted = targets.filter("source is not null and target_share > 0").select("source")  # a row per target
    used = docs.select("doc_id", "source", size).filter(F.col("source").isNotNull() & (F.col(size) > 0)).join(wanted, "source", "left_semi")
    plan = quotas(used, targets, size, total)
    at = shuffled_offsets(used, size, seed).select("source", "doc_id", size, F.expr(f"start div {block}").alias("block"))
    blocks = plan.filter("tokens > 0").select("source", F.expr(f"(tokens + {block - 1}) div {block}").alias("blocks"), "max_repeats")
    drawn = schedule(spark, plan, block).join(blocks, "source").select("slot", "source", F.expr("k % blocks").alias("block"), F.expr("k div blocks").alias("pass"), "max_repeats")
    drawn = drawn.filter(F.col("pass") < F.col("max_repeats")).drop("max_repeats")
    return at.join(drawn, ["source", "block"]).select("slot", "source", "doc_id", size, "pass"), plan


def chosen(occurrences: DataFrame, size: str = "n_tokens") -> DataFrame:
    """doc_id, source, size, repeats and the first slot of each chosen document."""
    return occurrences.groupBy("doc_id", "source", size).agg(F.count("*").alias("repeats"), F.min("slot").alias("first_slot"))


def shares(occurrences: DataFrame, plan: DataFrame, size: str = "n_tokens") -> DataFrame:
    """Per target source: target and actual share, tokens, documents, most repeats."""
    docs = chosen(occurrences, size)
    got = docs.groupBy("source").agg(F.sum(F.col(size) * F.col("repeats")).alias("mixed_tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    out = plan.select("source", "target_share", "max_repeats", "tokens").join(got, "source", "left").na.fill(0, ["mixed_tokens", "documents", "most_repeats"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # as many rows as targets
    return out.withColumn("actual_share", F.when(whole > 0, F.round(F.col("mixed_tokens") / whole, 6)).otherwise(0.0))
