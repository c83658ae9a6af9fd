"""Quality rules as weak supervision, in DataFrame functions only.

Eight rules look at a document and vote good (1), bad (-1) or abstain (0). Nobody says
how far a rule can be trusted: expectation-maximisation estimates, from agreement
alone, the share of good documents and two accuracies of each rule, how often its votes
are right on good and on bad documents. A rule that finds few bad documents but hardly
ever accuses a good one so weighs much when it says bad and little when it says good.
A document is kept if its posterior probability of being good is at least one half
and it passes the two base rules. EM sees the counts of vote patterns, at most 3^8
rows whatever the number of documents.

Words are runs of anything but ASCII white space; all counts cover the whole text.

Defined results: a null or empty text has no words, all counts 0, and fails the base
rules; repeated rows get the same verdict; a posterior of exactly one half keeps; a text
of any length is one row of SQL functions, which hold some times its size; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.tables import WORD, stored

SYMBOLS = "#*$%&|<>"
# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that by with was for on "
    "der die das und in den von zu mit sich ist nicht ein eine "
    "le la les de des et un une en que du est "
    "el los las y que en un una por con del"
)
ROUNDS = 60
SETTLED = 1e-6
# Where EM starts, and one vote's worth of prior belief: most documents are good, and a
# rule rarely accuses a good one but knows only some of the bad ones.
SHARE, ON_GOOD, ON_BAD = 0.8, 0.9, 0.3
LEAST = 0.002  # no accuracy is nearer to 0 or 1

Accuracy = dict[str, tuple[float, float]]


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and whole-text counts per document; the text itself is dropped."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = F.array(*(F.lit(w) for w in dict.fromkeys(STOP_WORDS.split())))
    split = docs.select(
        "doc_id", text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    # A window's hash and place; equal windows are neighbours once sorted.
    n = F.size("words")
    windows = F.slice(F.transform("words", lambda w, i: F.struct(
        F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("at"))),
        F.lit(1), F.greatest(n - 2, F.lit(0)))
    split = split.select("doc_id", "text", "words", "lines", F.sort_array(windows).alias("windows"))
    repeated = F.filter("windows", lambda x, i: (x["h"] == F.get("windows", i + 1)["h"])
                        | (x["h"] == F.get("windows", i - 1)["h"]))
    split = split.select("*", F.sort_array(F.transform(repeated, lambda x: x["at"])).alias("repeats"))
    covered = F.aggregate(
        "repeats", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, at: F.struct((s["n"] + F.least(F.lit(3), at - s["last"])).alias("n"), at.alias("last")),
        lambda s: s["n"])
    return split.select(
        "doc_id", n.cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:;\"'’”»)\]…]\s*$"))).alias("n_ended"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.size(F.array_intersect("words", stop)).alias("n_stop"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules, over the columns of ``counts``."""
    words, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    return {
        "vote_length": _vote(words >= 80, words < 20),
        "vote_word_length": _vote((chars >= 3 * words) & (chars <= 10 * words) & (words > 0),
                                  (chars < 2 * words) | (chars > 14 * words)),
        "vote_symbols": _vote(50 * F.col("n_symbols") <= words, 8 * F.col("n_symbols") > words),
        "vote_lines": _vote((lines > 1) & (10 * F.col("n_dup_lines") <= lines), 3 * F.col("n_dup_lines") > lines),
        "vote_repeats": _vote(10 * F.col("n_repeat_words") <= words, 4 * F.col("n_repeat_words") > words),
        "vote_stop_words": _vote(F.col("n_stop") >= 3, (words >= 20) & (F.col("n_stop") == 0)),
        "vote_endings": _vote((lines > 0) & (2 * F.col("n_ended") >= lines), (lines > 0) & (F.col("n_ended") == 0)),
        "vote_capitals": _vote((chars > 0) & (10 * F.col("n_upper") <= chars), 3 * F.col("n_upper") > chars),
    }


def posterior(share: float, accuracy: Accuracy) -> Column:
    """Probability that a document with these votes is good."""
    odds = F.lit(math.log(share / (1 - share)))
    for rule, (good, bad) in accuracy.items():
        odds = odds + (F.when(F.col(rule) == 1, math.log(good / (1 - bad)))
                       .when(F.col(rule) == -1, math.log((1 - good) / bad)).otherwise(0.0))
    return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame, rules: list[str], rounds: int = ROUNDS) -> tuple[float, Accuracy]:
    """The share of good documents and each rule's accuracies on good and bad ones, by expectation-maximisation."""
    patterns = stored(voted.groupBy(*rules).agg(F.count("*").cast("double").alias("n")).coalesce(1))
    share, accuracy = SHARE, {r: (ON_GOOD, ON_BAD) for r in rules}

    def estimate(right, all_, start: float) -> float:
        return min(1 - LEAST, max(LEAST, ((right or 0) + start) / ((all_ or 0) + 1)))

    for _ in range(rounds):
        good = F.col("n") * posterior(share, accuracy)
        bad = F.col("n") - good
        sums = [F.sum("n").alias("n"), F.sum(good).alias("good")]
        for r in rules:
            sums += [F.sum(F.when(F.col(r) == 1, good)).alias(f"{r}_right_good"),
                     F.sum(F.when(F.col(r) != 0, good)).alias(f"{r}_good"),
                     F.sum(F.when(F.col(r) == -1, bad)).alias(f"{r}_right_bad"),
                     F.sum(F.when(F.col(r) != 0, bad)).alias(f"{r}_bad")]
        got = patterns.agg(*sums).first()
        if not got["n"]:
            break
        new_share = (got["good"] + 1) / (got["n"] + 2)
        new = {r: (estimate(got[f"{r}_right_good"], got[f"{r}_good"], ON_GOOD),
                   estimate(got[f"{r}_right_bad"], got[f"{r}_bad"], ON_BAD)) for r in rules}
        moved = max([abs(new_share - share), *(abs(x - y) for r in rules for x, y in zip(new[r], accuracy[r]))])
        share, accuracy = new_share, new
        if moved < SETTLED:
            break
    return share, accuracy


def judge(docs: DataFrame) -> DataFrame:
    """Counts, votes, posterior, base_failed and kept per document."""
    rules = votes()
    voted = stored(counts(docs).select("*", *(v.alias(r) for r, v in rules.items())))
    share, accuracy = fit(voted, list(rules))
    p = posterior(share, accuracy)
    return (voted.withColumn("base_failed", base_failed()).withColumn("posterior", p)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)))
