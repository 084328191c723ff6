import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from canopy.operators import orphans, rolling


def test_trailing_totals_are_brute_force(spark):
    rng = random.Random(3)
    day0 = datetime(2026, 1, 5)
    rows = []
    for e in "abc":
        for _ in range(60):
            rows.append((e, day0 + timedelta(days=rng.randrange(70), hours=rng.randrange(24)), rng.choice([None, 1, 5, 1000, -3]), 2**62, "x"))
    rows += [(None, day0, 5, 1, "x"), ("d", None, 5, 1, "x"), ("e", day0, None, None, "x")]
    df = spark.createDataFrame(rows, "p string, ts timestamp_ntz, a long, b long, day string")
    days = rolling.daily(df, "p", "ts", ["a", "b"])
    got = {(r.entity, r.day, r.day_no): (int(r.a_7), int(r.a_30), int(r.b_30)) for r in rolling.trailing_totals(days, ["a", "b"]).collect()}
    sums = Counter()
    known = [r for r in rows if r[0] and r[1]]
    num = lambda t: (t - datetime(1970, 1, 1)).days
    for e, t, a, b, _ in known:
        sums[(e, num(t), "a")] += a or 0
        sums[(e, num(t), "b")] += b or 0
    last = max(num(r[1]) for r in known)
    want = {}
    for e in {r[0] for r in known}:
        first = min(num(r[1]) for r in known if r[0] == e)
        for d in range(first, last + 1):
            back = lambda c, w: sum(sums[(e, x, c)] for x in range(d - w + 1, d + 1))  # noqa: E731, B023
            want[(e, d, d - first + 1)] = (back("a", 7), back("a", 30), back("b", 30))
    assert got == want
    assert rolling.trailing_totals(days.limit(0), ["a", "b"]).count() == 0


def test_newest_rows_keep_a_null(spark):
    df = spark.createDataFrame([("k", 1, 5), ("k", 2, None), ("q", 1, 7), ("q", 1, 7)], "k string, id long, v long")
    assert sorted(map(tuple, rolling.newest_rows(df, ["k"], "id", ["v"]).collect())) == [("k", None), ("q", 7)]


REFS = "id string, a string, b string, t long, key string, start int"


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_masks_and_lives_are_brute_force(spark, match):
    rng = random.Random(match)
    key = lambda: rng.choice([None, "", " ", "x", " X", "y", "z ", "Q"])
    refs = [(str(i), key(), key(), rng.choice([None, 1, 5, 9]), "", 0) for i in range(300)] + [("hot", "x", "y", 5, "", 0)] * 200
    lives = [("x", "y", 0, 5), ("x", "y", 7, None), ("y", "z", 3, None), ("z", "x", 0, 0)]
    t = spark.createDataFrame(lives, "k1 string, k2 string, start long, end long")
    got = Counter(tuple(r) for r in orphans.orphans(spark.createDataFrame(refs, REFS), ["a", "b"], t, ["k1", "k2"], match, at="t").collect())
    want = Counter()
    for r in refs:
        k = [(x or "").strip().lower() or None for x in r[1:3]]
        if k == [None, None] or (match == "simple" and None in k):
            continue
        if match == "full" and None in k:
            want[r] += 1
            continue
        hit = any(all(x is None or x == y for x, y in zip(k, l[:2])) and (r[3] is None or (l[2] <= r[3] and (l[3] is None or r[3] < l[3]))) for l in lives)
        if not hit:
            want[r] += 1
    assert got == want
    assert orphans.orphans(spark.createDataFrame(refs[:3], REFS), ["a", "b"], t.limit(0), ["k1", "k2"], match, at="t").count() <= 3


def test_lives_and_report(spark):
    df = spark.createDataFrame([("A ", 1, None, 1), ("a", 1, 9, 2), ("a", 20, None, 1), (None, 1, 2, 1), ("b", None, 2, 1)], "id string, s long, e long, v int")
    assert sorted(map(tuple, orphans.lives(df, "id", F.col("s"), F.col("e"), ["v"]).collect())) == [("a", 1, 9), ("a", 20, None)]
    cases = spark.createDataFrame([("s1", 1767571200), ("s1", 1767571200), ("s2", None)], "id string, t long")
    assert sorted((r.period, r.row_key) for r in orphans.report(cases, "t", "f", "t", F.col("id")).fillna("-").collect()) == [("-", "s2"), ("2026-01", "s1")]
