import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import spikes

SCHEMA = "source string, t long, active boolean, idle boolean, metrics array<struct<metric: string, value: long, possible: boolean>>, value int"
BASE = 1_767_571_200


def series(rng, n, level=1000, scatter=0.05, rhythm=0.3, step=43_200):
    t = BASE + np.arange(n) * step
    y = np.log(level) + rhythm * np.cos(2 * np.pi * t / 86_400) + scatter * rng.standard_normal(n)
    return t, np.exp(y).astype(int)


def frame(spark, sources):
    rows = []
    for s, (t, v, *extra) in sources.items():
        active = extra[0] if extra else [True] * len(t)
        possible = extra[1] if len(extra) > 1 else [True] * len(t)
        rows += [(s, int(a), bool(c), not c, [("m", None if x is None else int(x), bool(p))], 1) for a, x, c, p in zip(t, v, active, possible)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df, **kw):
    out = {}
    for r in spikes.implausible(df, **kw).collect():
        out.setdefault((r.source, r.reason), set()).add((r.t - BASE) // 43_200)
    return out


def test_spikes_shifts_stuck_idle_impossible(spark):
    rng = np.random.default_rng(1)
    src = {}
    t, v = series(rng, 120)
    v[40:42] *= 5
    v[80] = v[80] // 6
    src["spike"] = (t, v)
    t, v = series(rng, 120)
    v[60:] *= 3  # a lasting change
    v[100] *= 6
    src["shift"] = (t, v)
    t, v = series(rng, 120, scatter=0.01, rhythm=0)
    v = (v * np.exp(0.01 * np.arange(120))).astype(int)
    v[50:] = (v[50:] * 0.6).astype(int)  # growth and compaction
    v[52] *= 7  # a spike just after it
    src["grow"] = (t, v)
    t, v = series(rng, 120, rhythm=0)
    v[30:36] = 777
    v[50:55] = 778
    src["stuck"] = (t, v)
    t, v = series(rng, 120)
    idle = np.ones(120, bool)
    idle[20:40] = False
    v[20:40] = 0
    v[60:70] = 5
    idle[60:70] = False
    src["idle"] = (t, v, idle)
    t, v = series(rng, 120)
    ok = np.ones(120, bool)
    v[10], ok[10] = -5, False
    v[11], ok[11] = 2**31 - 1, False
    src["impossible"] = (t, v, np.ones(120, bool), ok)
    got = found(frame(spark, src))
    assert got == {
        ("spike", "spike"): {40, 41, 80},
        ("shift", "spike"): {100},
        ("grow", "spike"): {52},
        ("stuck", "stuck"): set(range(31, 36)),
        ("impossible", "impossible"): {10, 11},
    }


def test_hot_source_is_cut_and_found_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    t, v = series(rng, 600)
    v[[50, 151, 299, 300, 301, 450]] *= 6
    v[200:207] = 1234
    df = frame(spark, {"hot": (t, v), "cool": series(rng, 60)})
    whole = found(df)
    monkeypatch.setattr(spikes, "CHUNK", 100)
    monkeypatch.setattr(spikes, "HALO", 40)
    monkeypatch.setattr(spikes, "BUCKET", 64)
    assert found(df) == whole == {("hot", "spike"): {50, 151, 299, 300, 301, 450}, ("hot", "stuck"): set(range(201, 207))}


def test_hot_source_with_outages_is_as_uncut(spark, monkeypatch):
    rng = np.random.default_rng(4)
    t, v = series(rng, 600)
    t[[*range(203, 600)]] += 4_000 * 43_200  # an outage amid a stuck run
    t[[*range(400, 600)]] += 9_000 * 43_200  # and one just after a spike
    v[200:207] = 1234
    v[398:400] *= 6
    idle = np.ones(600, bool)
    idle[500:590] = False  # a chunk with hardly a usable reading
    v[594] *= 6
    df = frame(spark, {"hot": (t, v, idle), "cool": series(rng, 60)})
    whole = found(df)
    assert whole[("hot", "stuck")] == {int(x) for x in (t[201:207] - BASE) // 43_200}
    assert whole[("hot", "spike")] == {int(x) for x in (t[[398, 399, 594]] - BASE) // 43_200}
    for chunk in (100, 199, 203, 210):
        monkeypatch.setattr(spikes, "CHUNK", chunk)
        monkeypatch.setattr(spikes, "HALO", 40)
        monkeypatch.setattr(spikes, "BUCKET", 64)
        assert found(df) == whole


def test_nulls_short_and_empty(spark):
    rng = np.random.default_rng(3)
    t, v = series(rng, 40)
    w = [None if i % 7 == 0 else x for i, x in enumerate(v)]
    w[20] = v[20] * 9
    df = frame(spark, {"a": (t, w), "b": (t[:5], [1, 1, 900, 1, 1]), "c": ([], [])})
    df = df.unionByName(spark.createDataFrame([(None, 1, True, False, [("m", 1, True)], 1), ("d", None, None, None, None, 1)], SCHEMA))
    assert found(df) == {("a", "spike"): {20}}
    assert found(df.limit(0)) == {}


@pytest.mark.parametrize("seed", range(2))
def test_stuck_flags_are_brute_force(seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 2, (50, 60)) * 3
    present, active = rng.random((50, 60)) < 0.9, rng.random((50, 60)) < 0.95
    got = spikes.stuck_flags(v, present, active & present)
    for i in range(50):
        at = np.flatnonzero(present[i])
        want, j = set(), 0
        while j < len(at):
            k = j
            while k + 1 < len(at) and v[i, at[k + 1]] == v[i, at[j]] and v[i, at[j]] != 0 and active[i, at[k + 1]] and active[i, at[j]]:
                k += 1
            if k - j + 1 >= spikes.STUCK:
                want |= set(at[j + 1 : k + 1])
            j = k + 1
        assert set(np.flatnonzero(got[i])) == want


def test_table_has_each_case_once(spark, sf):
    from canopy.plans.pipeline import p5_found

    df = p5_found(spark, sf)
    assert df.columns == ["metric", "source", "ts_s"]
    assert df.count() == df.distinct().count() > 0
    assert df.filter(F.col("metric").isNull() | F.col("source").isNull()).count() == 0


def test_bucket_mates_change_nothing():
    """Flags of 300 short series are the same alone and beside one ten times as long."""
    rng = np.random.default_rng(8)
    n, most = 300, 3000
    t = np.zeros((n + 1, most), np.int64)
    v = np.zeros((n + 1, most), np.int64)
    use = np.zeros((n + 1, most), bool)
    for i in range(n + 1):
        m = most if i == n else int(rng.integers(30, 300))
        a, b = series(rng, m)
        b = np.asarray(b)
        b[rng.integers(0, m, 2)] *= 3
        t[i, :m], v[i, :m], use[i, :m] = a, b, True
    alone = spikes.spike_flags(t[:n, :300], v[:n, :300], use[:n, :300])
    assert (spikes.spike_flags(t, v, use)[:n, :300] == alone).all() and alone.any()


def test_a_source_of_20000_readings_is_as_uncut(spark, monkeypatch):
    rng = np.random.default_rng(9)
    t, v = series(rng, 20_000)
    v = np.asarray(v).astype(np.int64)
    v[:7000] = 1000 + (v[:7000] - 1000) // 4  # quieter at first: a chunk's own scatter is not the source's
    v[[50, 3999, 4000, 4001, 8191, 12_000, 16_383, 19_000]] *= 6
    v[9000:9010] = 777
    df = frame(spark, {"hot": (t, v)})
    cut = found(df)
    monkeypatch.setattr(spikes, "CHUNK", 1 << 30)
    assert cut == found(df) and len(cut[("hot", "spike")]) >= 8
