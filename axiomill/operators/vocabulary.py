"""Word frequencies, their adjustments, and the scored and numbered vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axiomill.functions import words as W

#: What an n-gram's count is multiplied by.
TWO_GRAM, THREE_GRAM = 2.3 / 3, 3.8 / 5
FLOOR = 3
STOCK_TOTAL = 450_000_000


def word_frequency(tokens: DataFrame) -> DataFrame:
    """``word, freq``: singular alphabetic words of at least three letters that aren't stop words."""
    return frequency_of(tokens.groupBy("word").agg(F.count("*").alias("n")))


def frequency_of(counts: DataFrame) -> DataFrame:
    """As :func:`word_frequency`, of ``counts(word, n)`` of tokens: each different word is judged once."""
    own = W.singular(F.col("word"))
    kept = counts.where(F.col("word").rlike(r"^[a-z]{3,}\z") & ~own.isin(*W.STOP_WORDS))
    return kept.groupBy(own.alias("word")).agg(F.sum("n").alias("freq"))


def corpus_frequency(tokens: DataFrame) -> DataFrame:
    """``word, freq, total``: singular words of at least three characters, stop words too."""
    counts = tokens.where(F.length("word") >= 3).groupBy(W.singular(F.col("word")).alias("word")).agg(F.count("*").alias("freq"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("freq").alias("total"))))  # one row


def with_ngrams(words: DataFrame, two: DataFrame, three: DataFrame) -> DataFrame:
    """n-grams with deflated counts beside the words; counts below two are dropped."""
    short = two.select(F.col("ngram").alias("word"), F.floor(F.col("freq") * TWO_GRAM).alias("freq"))
    long = three.select(F.col("ngram").alias("word"), F.floor(F.col("freq") * THREE_GRAM).alias("freq"))
    return words.unionByName(short.unionByName(long).where("freq >= 2"))


def average_frequency(words: DataFrame) -> DataFrame:
    """``average``: the whole mean frequency of words that occur at least twice; 1 if none does."""
    twice = words.where("freq >= 2")
    return twice.agg(F.coalesce(F.floor(F.sum("freq") / F.count("*")), F.lit(1)).cast("bigint").alias("average"))


def completed(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words of ``lexicon(word)`` that are absent, with the average frequency."""
    absent = lexicon.select("word").where("word is not null").distinct().join(words, "word", "left_anti")
    return words.unionByName(absent.crossJoin(F.broadcast(average_frequency(words))).withColumnRenamed("average", "freq"))


def merged_plurals(words: DataFrame) -> DataFrame:
    """A plural whose singular is a word too is merged into it, with three quarters of both counts."""
    own = words.select("word", "freq", W.singular(F.col("word")).alias("base"))
    base = words.select(F.col("word").alias("base"), F.col("freq").alias("base_freq"))
    plural = own.where("word <> base").join(base, "base").groupBy("base").agg(F.sum("freq").alias("extra"))
    kept = own.join(base.join(plural, "base", "left_semi").select("base"), "base", "left_semi").where("word <> base").select("word")
    rest = words.join(kept, "word", "left_anti")
    return rest.join(plural.withColumnRenamed("base", "word"), "word", "left").select(
        "word", F.when(F.col("extra").isNotNull(), F.floor((F.col("freq") + F.col("extra")) * 3 / 4)).otherwise(F.col("freq")).cast("bigint").alias("freq")
    )


def stem_adjusted(words: DataFrame, stems: DataFrame) -> DataFrame:
    """Frequencies divided by three quarters of the number of forms of the word's stem (if that is
    at least two), and at least 1. ``stems(word, stem)``."""
    forms = stems.groupBy("stem").agg(F.count("*").alias("forms"))
    divisor = F.floor(F.col("forms") * 0.75)
    both = words.join(forms.withColumnRenamed("stem", "word"), "word", "left")
    return both.select("word", F.when(divisor >= 2, F.greatest(F.lit(1), F.floor(F.col("freq") / divisor))).otherwise(F.col("freq")).cast("bigint").alias("freq"))


def pruned(words: DataFrame, least: int = FLOOR) -> DataFrame:
    return words.where(F.col("freq") >= least)


def numbered(words: DataFrame) -> DataFrame:
    """``word, freq, word_idx``: from 0, by falling frequency, then by word.

    Words are numbered within their frequency and first two letters, as very many are of the least
    frequency; only the counts of such groups are summed in one task.
    """
    own = words.withColumn("start", F.substring("word", 1, 2))
    counts = own.groupBy("freq", "start").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("freq"), "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("freq", "start", before.alias("offset"))
    within = F.row_number().over(Window.partitionBy("freq", "start").orderBy("word")) - 1
    return own.withColumn("w", within).join(offsets, ["freq", "start"]).select("word", "freq", (F.col("w") + F.col("offset")).cast("bigint").alias("word_idx"))


def scored(words: DataFrame) -> DataFrame:
    return words.withColumn("score", W.word_score(F.col("freq")))


def score_overrides(scores: DataFrame, average: list[str], least: list[str], removed: list[str]) -> DataFrame:
    """Fixed words get two thirds of the mean score (at least 3) or the least score; others go."""
    mean = scores.agg(F.greatest(F.lit(3), F.floor(F.avg("score") * 2 / 3)).cast("int").alias("mean"))
    own = F.when(F.col("word").isin(*average), F.col("mean")).when(F.col("word").isin(*least), F.lit(3)).otherwise(F.col("score"))
    return scores.where(~F.col("word").isin(*removed)).crossJoin(F.broadcast(mean)).select("word", "freq", own.alias("score"))


def fluff(corpus: DataFrame, stock: DataFrame, stock_total: int | None = STOCK_TOTAL) -> DataFrame:
    """``word``: stock words that the corpus lacks, or has less than twice as often as the stock."""
    known = stock.select("word", F.col("freq").alias("stock_freq"))
    share = F.col("freq") / F.col("total")
    return known.join(corpus, "word", "left").where(F.col("freq").isNull() | (share < 2 * F.col("stock_freq") / stock_total)).select("word")


def shards(numbered_: DataFrame, size: int = 5000) -> DataFrame:
    return numbered_.withColumn("shard", F.floor(F.col("word_idx") / size).cast("int"))


def stem_candidates(words: DataFrame, longest: int = 6, least_children: int = 3) -> DataFrame:
    """``prefix, words, children``: prefixes of more than four letters that branch into at least
    ``least_children`` letters; a word counts for prefixes at most ``longest`` letters shorter.

    Less than three quarters of the occurrences may end at the prefix, and the most frequent letter
    must have more than a fifth of them.
    """
    prefixes = words.select("word", "freq", F.explode(F.sequence(F.greatest(F.lit(5), F.length("word") - longest), F.length("word"))).alias("n")).where("n <= length(word)")
    cut = prefixes.select(F.substring("word", F.lit(1), F.col("n")).alias("prefix"), F.substring("word", F.col("n") + 1, F.lit(1)).alias("next"), "freq")
    letters = cut.groupBy("prefix", "next").agg(F.count("*").alias("words"), F.sum("freq").alias("freq"))
    goes_on = F.col("next") != ""
    each = letters.groupBy("prefix").agg(
        F.sum("words").alias("words"), F.count_if(goes_on).alias("children"), F.sum("freq").alias("all"),
        F.coalesce(F.sum(F.when(~goes_on, F.col("freq"))), F.lit(0)).alias("own"), F.max(F.when(goes_on, F.col("freq"))).alias("top"),
    )
    branching = (F.col("children") >= least_children) & (F.col("own") < F.floor(F.col("all") * 3 / 4)) & (F.col("top") > F.floor(F.col("all") / 5))
    return each.where(branching).select("prefix", "words", "children")


def stems(words: DataFrame, candidates: DataFrame) -> DataFrame:
    """``word, stem``: the longest candidate that a word starts with."""
    prefixes = words.select("word", F.explode(F.sequence(F.lit(5), F.greatest(F.lit(5), F.length("word")))).alias("n")).where("n <= length(word)")
    cut = prefixes.select("word", F.substring("word", F.lit(1), F.col("n")).alias("prefix"))
    return cut.join(candidates.select("prefix"), "prefix").groupBy("word").agg(F.max_by("prefix", F.length("prefix")).alias("stem"))


def stem_representatives(stems_: DataFrame) -> DataFrame:
    """``stem, word``: the longest word of each stem, the first of equally long ones."""
    return stems_.groupBy("stem").agg(F.min(F.struct((-F.length("word")).alias("n"), "word")).alias("m")).select("stem", F.col("m.word").alias("word"))


def curated(terms: DataFrame, words: DataFrame) -> DataFrame:
    """``word, freq`` of a curated list, absent words with the average."""
    both = terms.select("word").distinct().join(words, "word", "left").crossJoin(F.broadcast(average_frequency(words)))
    return both.select("word", F.coalesce("freq", "average").alias("freq"))


def pruned_synonyms(synonyms: DataFrame, known: DataFrame, normal: DataFrame | None = None) -> DataFrame:
    """``word, related_word``: synonyms of which both words are known, raw, in the singular or in the
    normal form of ``normal(word, normal)``, the first that is; each pair once, no word its own.

    ``synonyms(word, related_word)``, ``known(word)``. Each different word is looked up once.
    """
    every = synonyms.select(F.explode(F.array("word", "related_word")).alias("raw")).where("raw is not null").distinct()
    forms = every.select("raw", W.singular(F.col("raw")).alias("one"))
    third = F.lit(None).cast("string")
    if normal is not None:
        forms = forms.join(normal.select(F.col("word").alias("one"), "normal"), "one", "left")
        third = F.col("normal")
    each = forms.select("raw", F.posexplode(F.array("raw", "one", third)).alias("at", "form")).where("form is not null")
    met = each.join(known.select(F.col("word").alias("form")).distinct(), "form", "left_semi").groupBy("raw").agg(F.min_by("form", "at").alias("form"))
    left, right = met.select(F.col("raw").alias("word"), F.col("form").alias("a")), met.select(F.col("raw").alias("related_word"), F.col("form").alias("b"))
    return synonyms.join(left, "word").join(right, "related_word").where("a <> b").select(F.col("a").alias("word"), F.col("b").alias("related_word")).distinct()
