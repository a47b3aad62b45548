"""Counting and choosing n-grams.

A token after an invalid one is counted like any other; the line-at-a-time form of these counts
skips it. Runs of words are read from the list of a part's words, without a sort.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axiomill.functions import words as W
from axiomill.operators.index import runs

#: Fixed value: how much likelier than by chance a rare pair must be.
LIFT = 2.5


def neighbours(lists: DataFrame, n: int) -> DataFrame:
    """``w0 .. w(n-1)`` of all runs of n tokens of ``lists(thm_id, part, words)``."""
    return runs(lists, n).where(F.col(f"w{n - 1}").isNotNull()).drop("thm_id", "part", "pos")


def valid(word: Column, least: int = 3) -> Column:
    return (F.length(word) >= least) & word.rlike(r"^[a-z]+\z") & ~word.isin(*W.STOP_WORDS)


def two_grams(lists: DataFrame) -> DataFrame:
    """``w0, w1, freq``: both words valid, the second in the singular."""
    return counted_two(neighbours(lists, 2))


def times(runs: DataFrame) -> Column:
    """How often a run occurs: its rows, or the sum of their ``n``."""
    return (F.sum("n") if "n" in runs.columns else F.count("*")).alias("freq")


def counted_two(runs: DataFrame) -> DataFrame:
    """As :func:`two_grams`, of runs ``w0, w1``."""
    runs = runs.where(valid(F.col("w0")) & valid(F.col("w1")))
    return runs.groupBy("w0", W.singular(F.col("w1")).alias("w1")).agg(times(runs))


def average_follow(two: DataFrame) -> DataFrame:
    """``w0, n_next, total, average``: the rounded mean count of a first word's pairs."""
    by = two.groupBy("w0").agg(F.count("*").alias("n_next"), F.sum("freq").alias("total"))
    return by.withColumn("average", F.floor(F.col("total") / F.col("n_next") + 0.5).cast("bigint"))


def chosen_two_grams(
    two: DataFrame, words: DataFrame, parts: DataFrame | None = None, undesirable: Iterable[tuple[str, str]] = (), added: DataFrame | None = None, removed: DataFrame | None = None
) -> DataFrame:
    """``ngram, freq``: pairs more frequent than their first word's average, or likelier than chance.

    ``words(word, freq)`` are the frequencies of single words; the total is one broadcast row. Pairs
    whose parts of speech by ``parts(word, pos)`` are ``undesirable`` are left out, and so are those of
    ``removed(ngram)``; those of ``added(ngram)`` that occur are kept whatever their count.
    """
    total = words.agg(F.sum("freq").alias("total_words"))
    first = average_follow(two).select("w0", "average")
    freq0 = words.select(F.col("word").alias("w0"), F.col("freq").alias("f0"))
    freq1 = words.select(F.col("word").alias("w1"), F.col("freq").alias("f1"))
    both = two.join(first, "w0").join(freq0, "w0", "left").join(freq1, "w1", "left").crossJoin(F.broadcast(total))
    likely = F.col("freq") / F.col("f0") > LIFT * F.col("f1") / F.col("total_words")
    kept = both.where(((F.col("freq") > F.col("average")) | F.coalesce(likely & (F.col("freq") > 1), F.lit(False))) & ~F.col("w1").rlike("ing$"))
    if parts is not None:
        first_part, second_part = (parts.select(F.col("word").alias(w), F.col("pos").alias(f"pos{i}")) for i, w in enumerate(("w0", "w1")))
        bad = reduce(or_, ((F.col("pos0") == a) & (F.col("pos1") == b) for a, b in undesirable), F.lit(False))
        kept = kept.join(first_part, "w0", "left").join(second_part, "w1", "left").where(~F.coalesce(bad, F.lit(False)))
    out = kept.select(F.concat_ws(" ", "w0", "w1").alias("ngram"), "freq")
    if added is not None:
        listed = two.select(F.concat_ws(" ", "w0", "w1").alias("ngram"), "freq").join(added.select("ngram").distinct(), "ngram", "left_semi")
        out = out.unionByName(listed).distinct()
    return out if removed is None else out.join(removed.select("ngram"), "ngram", "left_anti")


def three_grams(lists: DataFrame) -> DataFrame:
    """``w0, w1, w2, freq``: outer words valid (the last longer than three letters, not ending in
    -ed), the middle one of at least two letters."""
    return counted_three(neighbours(lists, 3))


def counted_three(runs: DataFrame) -> DataFrame:
    """As :func:`three_grams`, of runs ``w0, w1, w2``."""
    ok = valid(F.col("w0")) & F.col("w1").rlike(r"^[a-z]{2,}\z") & valid(F.col("w2"), 4) & ~F.col("w2").rlike("ed$")
    runs = runs.where(ok)
    return runs.groupBy("w0", "w1", W.singular(F.col("w2")).alias("w2")).agg(times(runs))


def chosen_three_grams(three: DataFrame, two: DataFrame) -> DataFrame:
    """``ngram, freq``: two thirds of each first word's triples by count; of the others those with
    more than half the count of one of their pairs."""
    window = Window.partitionBy("w0")
    order = window.orderBy(F.desc("freq"), "w1", "w2")
    ranked = three.select("*", F.row_number().over(order).alias("r"), F.count("*").over(window).alias("n"))
    left = two.select("w0", "w1", F.col("freq").alias("f01"))
    right = two.select(F.col("w0").alias("w1"), F.col("w1").alias("w2"), F.col("freq").alias("f12"))
    both = ranked.join(left, ["w0", "w1"], "left").join(right, ["w1", "w2"], "left")
    top = F.col("r") <= F.floor(F.col("n") * 2 / 3)
    common = F.coalesce(F.col("freq") > F.col("f01") / 2, F.lit(False)) | F.coalesce(F.col("freq") > F.col("f12") / 2, F.lit(False))
    return both.where(top | common).select(F.concat_ws(" ", "w0", "w1", "w2").alias("ngram"), "freq")


def augmented(own: DataFrame, listed: DataFrame, n: int) -> DataFrame:
    """``ngram, freq``: listed phrases of at least ``n`` words too, by their last ``n`` words (of
    pairs) or first ``n``, with the mean frequency; the greater of two counts stays."""
    parts = F.split(F.lower(F.trim("ngram")), r"\s+")
    cut = F.slice(parts, -n, n) if n == 2 else F.slice(parts, 1, n)
    more = listed.select(F.when(F.size(parts) >= n, F.concat_ws(" ", cut)).alias("ngram")).where("ngram is not null").distinct()
    mean = own.agg(F.floor(F.avg("freq")).cast("bigint").alias("freq"))
    return own.unionByName(more.crossJoin(F.broadcast(mean))).groupBy("ngram").agg(F.max("freq").alias("freq"))


def entity_ngrams(lists: DataFrame, n: int = 4, least: int = 2) -> DataFrame:
    """``ngram, freq``: clean runs of n words that neither start nor end in a verb form or stop word."""
    runs = neighbours(lists, n)
    clean = F.lit(True)
    for i in range(n):
        clean = clean & F.col(f"w{i}").rlike(r"^[a-z]+\z")
    edge = valid(F.col("w0")) & valid(F.col(f"w{n - 1}")) & ~F.col("w0").rlike("(?:ed|ing)$") & ~F.col(f"w{n - 1}").rlike("(?:ed|ing|ly)$")
    return runs.where(clean & edge).groupBy(F.concat_ws(" ", *(f"w{i}" for i in range(n))).alias("ngram")).agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def first_words(ngrams: DataFrame) -> DataFrame:
    return ngrams.select(F.element_at(F.split("ngram", " "), 1).alias("word")).distinct()
