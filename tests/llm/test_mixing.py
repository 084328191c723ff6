from canopy.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, sizes):
    rows = [(f"{s}{i}", s, n) for s, ns in sizes.items() for i, n in enumerate(ns)]
    return spark.createDataFrame(rows, "doc_id string, source string, n_tokens long")


def run(spark, sizes, targets, **kw):
    d = docs(spark, sizes)
    occ, plan = mixing.mix(d, spark.createDataFrame(targets, TARGETS), **kw)
    return occ, {r.source: r for r in mixing.shares(occ, plan).collect()}


def test_shares_are_met_and_repeats_kept(spark):
    sizes = {"a": [10] * 400, "b": [7, 13] * 500, "c": [5] * 100}
    occ, got = run(spark, sizes, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)], block=10)
    # a limits the mix: 4000 / 0.5 = 8000 tokens
    assert abs(sum(r.mixed_tokens for r in got.values()) - 8000) < 30
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(got[s].actual_share - want) < 0.005
        assert got[s].most_repeats <= got[s].max_repeats
    rows = occ.collect()
    assert len({(r.doc_id, r["pass"]) for r in rows}) == len(rows)
    # low discrepancy: every quarter of the slots holds about its shares
    top = max(r.slot for r in rows) + 1
    for q in range(4):
        part = [r for r in rows if q * top // 4 <= r.slot < (q + 1) * top // 4]
        whole = sum(r.n_tokens for r in part)
        assert abs(sum(r.n_tokens for r in part if r.source == "a") / whole - 0.5) < 0.05


def test_buckets_do_not_change_the_order(spark):
    d = docs(spark, {"a": list(range(1, 200)), "b": [3] * 50})
    one = sorted(map(tuple, mixing.shuffled_offsets(d, "n_tokens").collect()))
    many = sorted(map(tuple, mixing.shuffled_offsets(d, "n_tokens", per_bucket=8).collect()))
    assert one == many
    starts = sorted((r[3], r[2]) for r in one if r[1] == "a")
    assert all(x + n == y for (x, n), (y, _) in zip(starts, starts[1:]))


def test_capped_total_nulls_and_empty(spark):
    sizes = {"a": [10] * 10, "b": [10] * 10, None: [5], "z": [3]}
    targets = [("a", 0.9, 2), ("b", 0.1, 1), ("none", 0.2, 3), (None, 0.1, 1)]
    occ, got = run(spark, {**sizes, "b": [10, 0, None] * 10}, targets, total=1000, block=10)
    assert got["a"].mixed_tokens == 200 and got["a"].most_repeats == 2  # all it may give
    assert got["b"].mixed_tokens == 100
    assert got["none"].mixed_tokens == 0 and got["none"].actual_share == 0
    assert None not in got and {r.source for r in occ.collect()} == {"a", "b"}
    occ, got = run(spark, {"q": [1]}, targets)
    assert occ.count() == 0 and all(r.mixed_tokens == 0 for r in got.values())
    assert run(spark, sizes, [])[1] == {}


def test_slots_choose_the_rows(spark):
    """Blocks and repeats are those of the slots drawn, as a plain loop over the sequence says."""
    sizes = {"a": [4] * 97, "b": [9, 2] * 30, "c": [5] * 11}
    targets = [("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.2, 4)]
    d = docs(spark, sizes)
    occ, plan = mixing.mix(d, spark.createDataFrame(targets, TARGETS), block=8)
    quota = {r.source: r.quota for r in plan.collect()}
    whole, most = sum(quota.values()), {s: m for s, _, m in targets}
    start = {(r.source, r.doc_id): r.start for r in mixing.shuffled_offsets(d, "n_tokens").collect()}
    want, drawn = set(), dict.fromkeys(sizes, 0)
    for slot in range(int(-(-whole // 8))):
        u, edge = (slot + 0.5) * (mixing.GOLDEN / 2**64) % 1.0, 0.0
        for s in sorted(quota):
            edge += quota[s] / whole
            if u < edge or s == max(quota):
                break
        k, blocks = drawn[s], -(-sum(sizes[s]) // 8)
        drawn[s] += 1
        if k // blocks < most[s]:
            want |= {(slot, s, i, k // blocks) for (x, i), at in start.items() if x == s and at // 8 == k % blocks}
    assert {(r.slot, r.source, r.doc_id, r["pass"]) for r in occ.collect()} == want
