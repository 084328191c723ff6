"""Texts cut off by field limits or in transfer, found by word trigrams, in SQL expressions only.

A text is split into words: what white space separates, runs of one script where none does,
and symbols by themselves. An identifier (a word with a digit or a slash) counts up to the
first of these, so that all numbers are alike. Sentence marks and line breaks end sentences. Every position of every text gives one trigram, padded at
the sentence's start, and counts as *terminal* if a mark, a line break or the end of the
text follows, else as *inside*. The same counts are kept per sentence opening (its first
two words), where the same trigram may end one kind of sentence and never another.

The final trigram of a text that ends without a mark is then joined to the counts of all
texts. It is a cut if the trigram is frequent inside but almost never terminal (its own end
not counted), or if its last word is rare there but begins words that are frequent after
the same two words. Trigrams too rare to judge fall back to their last two words, then to
the last. A text that ends in half a character is a cut as well.

Defined results: null, empty and blank texts are no cases; texts that end with a mark trail
off or end and are no cases; exact copies of a text count and are judged once, and the
verdict holds for each. Words are compared whole, long ones by a hash; only whether a
word longer than ``PREFIX`` characters was *begun* is judged by its first ``PREFIX``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.session import written

#: White space beyond ASCII; it becomes a space.
ODD_SPACE = r"[\u00a0\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]"
#: Symbols that are words by themselves, one by one (a table look-up per character): ASCII and Latin 1; line breaks too.
SYMBOLS = r"\n\r!\"#$%&()*+,;<=>?@\[\]\\^`{|}~¡¢£¤¥¦§¨©«¬®¯°±²³´¶·¸¹»¼½¾¿"
#: And by ranges: general, CJK, full width, emoji.
FAR_SYMBOLS = r"\u2010-\u2018\u201a-\u2bff\u3001-\u303f\uff01-\uff20\x{1f000}-\x{1faff}"
#: At a word's end marks, colons and apostrophes stand apart as well.
LATE = r"[.!:?'](?=[.!?:']{0,8}(?:\s|\z))"
APART, ASCII_APART = f"([{SYMBOLS}{FAR_SYMBOLS}]|{LATE})", f"([{SYMBOLS[: SYMBOLS.index('¡')]}]|{LATE})"
#: Marks that end a sentence once they stand apart.
ENDS = r" [.!?…。！？\n\r] "
#: What an identifier's first digit or slash and all after it become.
IDENTIFIER = (r"[0-9/]\S*+", "0")
#: Runs of the scripts that are written without spaces.
SCRIPTS = r"([\u3400-\u9fff]+|[\u3041-\u309f]+|[\u30a0-\u30ff]+)"
PREFIX, LONG = 64, "\ue006"
#: A trigram is frequent from so many positions on, and almost never terminal up to this share.
FREQUENT, TERMINAL_SHARE = 5, 0.05


def normalised(text: Column) -> Column:
    """Lower case, symbols and marks apart by spaces, identifiers up to their first digit or slash; white space at the end is none.

    Each pattern is a class or two, so texts of any length take linear time.
    """
    out = F.rtrim(F.lower(text), F.lit(" \t\n\r\x0b\x0c\u00a0\u200b\u3000\ufeff"))
    for c in "\t\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(" "))
    ascii_only = F.octet_length(text) == F.length(text)  # most texts: the short pattern will do
    apart = F.regexp_replace(F.regexp_replace(out, ODD_SPACE, " "), APART, " $1 ")
    foreign = F.when(F.rlike(text, F.lit(r"[\u3041-\u30ff\u3400-\u9fff]")), F.regexp_replace(apart, SCRIPTS, " $1 ")).otherwise(apart)
    out = F.when(ascii_only, F.regexp_replace(out, ASCII_APART, " $1 ")).otherwise(foreign)
    return F.regexp_replace(out, *IDENTIFIER)


def _word(w: Column) -> Column:
    """A word as it is, a long one as its beginning and a hash of the whole."""
    return F.when(F.length(w) <= PREFIX, w).otherwise(F.concat(F.substring(w, 1, PREFIX), F.lit(LONG), F.hex(F.xxhash64(w))))


def _sentences(text: Column) -> Column:
    """Arrays of words, one per sentence; the last is empty if the text ends with a mark."""
    return F.transform(F.split(normalised(text), ENDS), lambda s: F.transform(F.array_remove(F.split(s, " "), ""), _word))


def _padded(words: Column) -> Column:
    return F.concat(F.array(F.lit(""), F.lit("")), words)


def _opening(words: Column) -> Column:
    """A sentence's first two words."""
    return F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))


def trigrams(docs: DataFrame, text: str) -> DataFrame:
    """Counts of all texts: opening, w1, w2, w3, inside, marked (a mark follows), last (the text ends)."""
    return _counted(sentences(docs, None, text))


def sentences(docs: DataFrame, doc_id: str | None, text: str) -> DataFrame:
    """doc_id (if named) and the sentences ``s`` of each text that is not blank, as arrays of words."""
    keep = [F.col(doc_id).alias("doc_id")] if doc_id else []
    return docs.filter(F.trim(F.col(text)) != "").select(*keep, _sentences(F.col(text)).alias("s"))


def _counted(s: DataFrame) -> DataFrame:
    flat = s.select(F.size("s").alias("n"), F.posexplode("s").alias("k", "words")).filter(F.size("words") > 0)
    flat = flat.select("n", "k", F.size("words").alias("size"), _opening(F.col("words")).alias("opening"), _padded(F.col("words")).alias("p"))
    rows = flat.select("n", "k", "size", "opening", "p", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("i"))
    rows = rows.select("n", "k", "size", "opening", "i", *[F.get("p", F.col("i") + j - 1).alias(f"w{j + 1}") for j in range(3)])
    ends, text_ends = F.col("i") == F.col("size"), F.col("k") == F.col("n") - 1
    one = lambda c: F.sum(F.when(c, F.lit(1)).otherwise(0))
    return rows.groupBy("opening", "w1", "w2", "w3").agg(one(~ends).alias("inside"), one(ends & ~text_ends).alias("marked"), one(ends & text_ends).alias("last"))


def finals(s: DataFrame) -> DataFrame:
    """doc_id and final trigram of each text of :func:`sentences` that ends without a mark."""
    ends = s.select("doc_id", F.element_at("s", -1).alias("words")).filter(F.size("words") > 0)
    p, n = _padded(F.col("words")), F.size("words")
    return ends.select("doc_id", *[F.get(p, n - 1 + i).alias(f"w{i + 1}") for i in range(3)], _opening(F.col("words")).alias("opening"))


GRAM, LEVEL = ["opening", "w1", "w2", "w3"], ["level", "context"]
#: Copies of the rows that many others may meet in a join.
SALTS = 8


def _levels() -> Column:
    """The contexts a trigram's last word is judged in, finest first: opening and two words, two words, one, none."""
    joined = lambda *c: F.concat_ws("\ue007", *c)
    contexts = [joined("opening", "w1", "w2"), joined("w1", "w2"), F.col("w2"), F.lit("")]
    return F.array(*[F.struct(F.lit(n).alias("level"), c.alias("context")) for n, c in enumerate(contexts)])


def _facts(counts: DataFrame) -> DataFrame:
    """level, context, word -> inside, ends (one's own left out), longer: how often a longer word that begins so follows the context."""
    per = counts.select(F.explode(_levels()).alias("l"), "w3", "inside", "marked", "last").groupBy("l.level", "l.context", F.col("w3").alias("word")).agg(*[F.sum(c).alias(c) for c in ("inside", "marked", "last")])
    none = F.lit(None).cast("bigint")
    own = per.select(*LEVEL, "word", "inside", (F.col("marked") + F.col("last") - 1).alias("ends"), none.alias("longer"))
    n = F.col("inside") + F.col("marked")
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length("word") - 1, F.lit(PREFIX))), lambda i: F.substring("word", F.lit(1), i))
    begun = per.filter((F.col("level") > 0) & (n >= FREQUENT) & (F.length("word") > 1)).select(*LEVEL, F.explode(starts).alias("word"), none.alias("inside"), none.alias("ends"), n.alias("longer"))
    return own.unionByName(begun).groupBy(*LEVEL, "word").agg(F.max("inside").alias("inside"), F.max("ends").alias("ends"), F.sum("longer").alias("longer"))


def _judged(kinds: DataFrame, counts: DataFrame) -> DataFrame:
    """``kinds`` (distinct final trigrams) that are cuts, with their reason."""
    begin = F.substring("w3", 1, PREFIX)
    asked = kinds.select(*GRAM, F.explode(_levels()).alias("l"), F.explode(F.array_distinct(F.array(F.col("w3"), begin))).alias("word"))
    # a common last word is one key of the coarse levels: its askers are spread over copies of the answer
    salt = F.when(F.col("l.level") >= 2, F.pmod(F.xxhash64("opening", "w1"), F.lit(SALTS)).cast("int")).otherwise(0)
    asked = asked.select(*GRAM, "l.level", "l.context", "word", salt.alias("salt"))
    copies = F.when(F.col("level") >= 2, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    told = asked.join(_facts(counts).withColumn("salt", F.explode(copies)), [*LEVEL, "word", "salt"])
    at = lambda n, c, w: F.max(F.when((F.col("level") == n) & (F.col("word") == w), F.col(c))).alias(f"{c}{n}")
    sums = [at(n, c, F.col("w3")) for n in range(4) for c in ("inside", "ends")] + [at(n, "longer", begin) for n in range(1, 4)]
    j = told.groupBy(*GRAM).agg(*sums)
    inside = word = F.lit(False)
    for n in reversed(range(4)):
        total = F.col(f"inside{n}") + F.col(f"ends{n}")
        known = (total >= FREQUENT) & (F.col(f"inside{n}") > 0) if n == 0 else total >= FREQUENT
        inside = F.when(known, (F.col(f"inside{n}") >= FREQUENT) & (F.col(f"ends{n}") <= TERMINAL_SHARE * total)).otherwise(inside)
        if n:
            longer = F.coalesce(f"longer{n}", F.lit(0))
            word = F.when(longer >= FREQUENT, total <= TERMINAL_SHARE * longer).otherwise(word)
    return j.select(*GRAM, F.when(inside, "inside").when(word, "word").alias("reason")).filter("reason is not null")


def _spread(many: DataFrame, few: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Inner join of ``many`` with ``few`` (a row per key), a key's rows spread by the hash of ``by`` over copies of its one."""
    salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"]).drop("__salt")


def truncated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """doc_id and reason: ``inside`` (stops in a sentence or block), ``word`` (in a word), ``char`` (in a character).

    ``counts`` is the table of :func:`trigrams` of the distinct texts, written; without it, it is made and written here.
    Copies are no evidence of each other: all counts are over distinct texts. A final trigram is
    judged by the finest counts that know it: with its sentence's opening, alone, then its last
    two words, then its last word.
    """
    keyed = docs.filter(F.trim(F.col(text)) != "").select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    distinct = keyed.select("text").distinct().withColumn("copy", F.sha2("text", 256))
    words = written(sentences(distinct, "copy", "text"), "sentences")  # normalised once, read twice
    counts = counts if counts is not None else written(_counted(words), "trigrams")
    ends = finals(words).withColumnRenamed("doc_id", "copy")
    cut = _spread(ends, _judged(ends.select(*GRAM).distinct(), counts), GRAM, "copy").select("copy", "reason")
    torn = (F.endswith(F.col("text"), F.lit("\ufffd")) & (F.length("text") > 1)).alias("torn")
    keyed = keyed.select("doc_id", F.sha2("text", 256).alias("copy"), torn)
    found = _spread(keyed.filter(~F.col("torn")), cut, ["copy"], "doc_id").select("doc_id", "reason")
    return found.unionByName(keyed.filter("torn").select("doc_id", F.lit("char").alias("reason")))


def rates(docs: DataFrame, cut: DataFrame, source: str = "source") -> DataFrame:
    """Per source the documents with text, those cut, and the share; a null source has its own row."""
    has = docs.filter(F.trim("text") != "").select("doc_id", F.col(source).alias("source"))
    flagged = has.join(cut.select("doc_id").distinct().withColumn("cut", F.lit(1)), "doc_id", "left")
    return flagged.groupBy("source").agg(F.count("*").alias("documents"), F.coalesce(F.sum("cut"), F.lit(0)).alias("truncated")).withColumn("rate", F.round(F.col("truncated") / F.col("documents"), 6))
