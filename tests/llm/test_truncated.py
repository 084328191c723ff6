import re
from collections import Counter

from canopy.llm import truncated as T


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", T.F.lit("s")).withColumn("inside", T.F.lit(1))


WHOLE = [f"The night shift moved the shard at {i}:00. We rebuilt the index and the queue stalls after a reconnect.\n\nThanks, The night shift" for i in range(40)]
WHOLE += [f'The value "odd" under /a/b{i} was written by the night shift. {{"db": "eu-{i}", "n": [1, 2]}}' for i in range(40)]
WHOLE += [f"Please document the limit\n```\nput {i}\n```" for i in range(20)]


def reasons(spark, extra):
    got = {r.doc_id: r.reason for r in T.truncated(frame(spark, WHOLE + extra)).collect()}
    assert all(i >= len(WHOLE) for i in got), [(WHOLE[i], r) for i, r in got.items() if i < len(WHOLE)]
    return [got.get(len(WHOLE) + i) for i in range(len(extra))]


def test_cut_texts(spark):
    assert reasons(
        spark,
        [
            "The night shift moved the",
            "The night shift moved the sha",
            "We rebuilt the index and the queue sta",
            'The value "od',
            'The value "odd" under /a/b was written by the night shift. {"db": "eu-3", "n',
            "Please document the limit\n```\npu",
            "The night shift moved the sh�",
        ],
    ) == ["inside", "word", "word", "word", "inside", "word", "char"]


def test_copies_of_a_cut_text_are_no_evidence_for_it(spark):
    cut = ["The night shift moved the", "Please document the limit\n```\npu"]
    assert reasons(spark, cut * 60) == ["inside", "word"] * 60
    assert reasons(spark, cut[:1] * 60 + ["And the night shift moved the"]) == ["inside"] * 61


def test_whole_texts_and_gaps(spark):
    assert reasons(
        spark,
        [
            None,
            "",
            " \n\t",
            "The night shift moved the shard at 9",  # merely lacks its mark
            "We rebuilt the index and the...",  # trails off
            "We rebuilt the index and the queue stalls after a reconnect",
            "Quite other words, never seen",
            "Please document the limit",
            "word " * 50_000 + ".",
        ],
    ) == [None] * 9
    assert T.truncated(frame(spark, WHOLE).limit(0)).count() == 0


def test_counts_are_those_of_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = Counter()
    for r in docs.select(T.normalised(T.F.col("text")).alias("t"), "text").collect():
        if not r.text or not r.text.strip(" "):
            continue
        parts = [[w for w in s.split(" ") if w] for s in re.split(T.ENDS, r.t)]
        assert all(len(w) <= T.PREFIX for words in parts for w in words)
        for k, words in enumerate(parts):
            for i in range(len(words)):
                w = ["", "", *words]
                kind = "inside" if i < len(words) - 1 else "last" if k == len(parts) - 1 else "marked"
                want[(" ".join(words[:2]), *w[i : i + 3], kind)] += 1
    got = Counter()
    for r in T.trigrams(docs, "text").collect():
        for kind in ("inside", "marked", "last"):
            if r[kind]:
                got[(r.opening, r.w1, r.w2, r.w3, kind)] = r[kind]
    assert got == want


def test_rates(spark):
    d = frame(spark, ["a b", "c", None])
    cut = spark.createDataFrame([(0,)], "doc_id long")
    assert [tuple(r) for r in T.rates(d, cut).collect()] == [("s", 2, 1, 0.5)]


def test_long_words_are_whole_words(spark):
    """Words that differ after their first characters only are different words, and a cut in one is found."""
    a, b = "w" * 200 + "a", "w" * 200 + "b"
    rows = [f"{i} we open {a} now and {b}." for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, f"we open {a}", f"we open {a} now and {b}", f"we open {a[:90]}"])], "doc_id long, text string")
    assert {r.doc_id: r.reason for r in T.truncated(docs).collect()} == {40: "inside", 42: "word"}


def test_planted_cuts_of_other_texts(spark):
    """Held-out accuracy: texts of a made-up grammar, a part of them cut at any character inside a sentence."""
    import random

    rng = random.Random(5)
    who, did, what, why = ["Anna", "Their baker", "A tall guard", "The old crew"], ["painted", "sold", "carried home", "forgot"], ["the wooden boat", "seven green lamps", "that map", "our garden chairs"], ["before noon", "because it rained", "for the third time", "without a word"]
    sentence = lambda: f"{rng.choice(who)} {rng.choice(did)} {rng.choice(what)} {rng.choice(why)}"
    texts, cut = [], set()
    for i in range(3000):
        t = ". ".join(sentence() for _ in range(3)) + rng.choice([".", ".", "!", ""])  # some merely lack the mark
        if rng.random() < 0.05:
            t = t[: rng.randrange(len(t) // 2, len(t) - 12)]
            if not t.rstrip().endswith((".", *why)):
                cut.add(i)
        texts.append((i, t))
    got = {r.doc_id for r in T.truncated(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got & cut) >= 0.95 * len(got)
