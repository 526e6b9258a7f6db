"""Quality rules: counted base rules, and a log-likelihood ratio of hashed n-grams.  DataFrame functions only.

Base counts of a text: words, code points in words, symbols, repeated lines, words in repeated
8-word windows.  A text fails the base rules with fewer than MIN_WORDS words, or if over MOST_REPEATED % of its
words are in repeated windows.

The ratio: texts become tokens (runs of letters and digits, runs of other visible characters), and tokens and
pairs of neighbouring tokens are hashed to BUCKETS buckets (a token twice in a row is one pair, whatever the
token).  Two multinomials over buckets are counted, one over the
whole raw corpus, one over the trusted target (documents labelled as good).  Of each bucket, the target's count and the count that the
raw multinomial lets expect in a target of that size get PRIOR added, so rare n-grams have ratios near 1 and a document isn't
rejected for words of its own.  A document's score is the sum over its n-grams of log(target / raw), divided by their
number; it is kept if the score is at least THRESHOLD, the same for every document.

The trusted target is a bounded sample of labelled rows, the TARGET_DOCS whose ids hash lowest, so that its ids can be
broadcast; raw counts cover all documents.  The weights (BUCKETS numbers) enter the second pass over the
texts as one literal array: no join, no shuffle, and rows need no key.  Shuffled are bucket
counts only.

Edge cases: null text is empty text (0 words: fails); repeated rows and ids are judged alike, row by row; without
trusted rows all weights are 0 and base rules alone decide; a null doc_id is never trusted; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, words

MIN_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
BITS = 14
BUCKETS = 1 << BITS
#: Added to a bucket's count, found and expected.
PRIOR = 10.0
TARGET_DOCS = 100_000
THRESHOLD = -0.15
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"


def repeated_words(hashes: Column) -> Column:
    """How many words are in WINDOW-word windows that occur twice or more, from the words' hashes."""
    n = F.size(hashes) - (WINDOW - 1)
    windows = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def covered(ws: Column) -> Column:
        placed = F.array_sort(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def twice(p: Column) -> Column:
            same = lambda s, at: F.coalesce(F.get(p, at)["w"] == s["w"], F.lit(False))
            hits = F.array_sort(F.transform(F.filter(p, lambda s, i: same(s, i - 1) | same(s, i + 1)), lambda s: s["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
            step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"))
            return F.aggregate(hits, start, step, lambda acc: acc["n"])

        return let(placed, twice)

    return let(windows, lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0).cast("long")).otherwise(covered(ws)))


def base_counts(text: Column) -> Column:
    """struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    return let(
        hashes,
        lambda h: F.struct(
            F.size(h).cast("long").alias("n_words"),
            F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(h).alias("n_repeat_words"),
        ),
    )


def buckets(text: Column) -> Column:
    """The buckets of a text's tokens and pairs of tokens, as array<int>."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def grams(h: Column) -> Column:
        n = F.greatest(F.size(h) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.when(a == b, F.lit(0).cast("long")).otherwise(F.xxhash64(a, b)))
        return F.transform(F.concat(h, pairs), lambda x: F.shiftrightunsigned(x, 64 - BITS).cast("int"))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), grams)


def weights(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(target / raw) of each bucket, to 6 decimals.  trusted: one column doc_id."""
    ids = trusted.where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_DOCS)
    flagged = docs.select("doc_id", "text").join(F.broadcast(ids.withColumn("hit", F.lit(1))), "doc_id", "left")
    grams = flagged.select(F.coalesce("hit", F.lit(0)).alias("hit"), F.explode(buckets(F.col("text"))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("hit").alias("target")).collect()  # BUCKETS rows at most
    all_raw, all_target = sum(r.raw for r in counts), sum(r.target for r in counts)
    table = [0.0] * BUCKETS
    for r in counts if all_target else []:
        expected = r.raw * all_target / all_raw
        table[r.bucket] = round(math.log((r.target + PRIOR) / (expected + PRIOR)), 6)
    return table


def score(text: Column, table: list[float]) -> Column:
    """Mean weight of a text's n-grams (none: 0)."""
    # one string literal, folded to an array when the plan is optimised
    w = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(w, b))
    return let(buckets(text), lambda g: F.when(F.size(g) > 0, total(g) / F.size(g)).otherwise(F.lit(0.0)))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept
    (clashing columns are replaced)."""
    table = weights(docs, trusted)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = docs.withColumn("_base", base_counts(F.col("text"))).withColumn("_llr", score(F.col("text"), table))
    failed = (F.col("_base.n_words") < MIN_WORDS) | (100 * F.col("_base.n_repeat_words") > MOST_REPEATED * F.col("_base.n_words"))
    found = {c: F.col(f"_base.{c}") for c in made} | {"base_failed": failed, "llr": F.round("_llr", 6), "kept": ~failed & (F.col("_llr") >= threshold)}
    return rows.withColumns(found).drop("_base", "_llr")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")
