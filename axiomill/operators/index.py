"""From statements to positional and literal indexes.

A statement has two parts, 'T' (the statement) and 'H' (its hypotheses). The tables made here:
``tokens(thm_id, part, pos, word)``, ``postings(word, thm_id, part, positions)`` with at most one
row for each word and statement, and ``literal(word, thm_id, positions)``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axiomill.functions import words as W

#: Places from here on aren't kept in a posting; valid words that a literal index goes
#: through, places of a literal word, statements of one.
LAST_POSITION, LITERAL_WORDS, LITERAL_POSITIONS, LITERAL_STATEMENTS = 127, 256, 2, 300


def statements(rows: DataFrame) -> DataFrame:
    """The last delivery of each statement; partial maxima are combined before the shuffle."""
    last = F.max(F.struct("loaded_at", "thm", "hyp", "file_name", "thm_type", "source")).alias("s")
    return rows.groupBy("thm_id").agg(last).select("thm_id", "s.thm", "s.hyp", "s.file_name", "s.thm_type", "s.source", "s.loaded_at")


def parts(statements_: DataFrame) -> DataFrame:
    """``thm_id, part, text`` of the non-null parts."""
    both = F.explode(F.array(F.struct(F.lit("T").alias("part"), F.col("thm").alias("text")), F.struct(F.lit("H").alias("part"), F.col("hyp").alias("text"))))
    return statements_.select("thm_id", both.alias("p")).select("thm_id", "p.part", "p.text").where("text is not null")


def token_lists(texts: DataFrame) -> DataFrame:
    """``thm_id, part, words``: the index words of each part in order."""
    return texts.select("thm_id", "part", W.index_words(F.col("text")).alias("words"))


def tokens(texts: DataFrame) -> DataFrame:
    """``thm_id, part, pos, word``: index words with their places among the index words of the part."""
    return placed(token_lists(texts))


def placed(lists: DataFrame) -> DataFrame:
    return lists.select("thm_id", "part", F.posexplode("words").alias("pos", "word"))


def runs(lists: DataFrame, n: int) -> DataFrame:
    """``thm_id, part, pos, w0 .. w(n-1)``: each word with those after it (null past the end).

    Neighbours are read within the row, so nothing is sorted or shuffled.
    """
    shifted = [F.col("words").alias("w0"), *(F.slice("words", i + 1, F.greatest(F.size("words") - i, F.lit(0))).alias(f"w{i}") for i in range(1, n))]
    return lists.select("thm_id", "part", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w")).select("thm_id", "part", "pos", *(F.col(f"w.w{i}").alias(f"w{i}") for i in range(n)))


def index_terms(lists: DataFrame, ngrams: DataFrame, stop_words: Iterable[str] = W.STOP_WORDS) -> DataFrame:
    """``thm_id, part, pos, word`` of single words and of the 2- and 3-grams that ``ngrams(ngram)`` lists."""
    starts = runs(lists, 3).where(F.length("w0") >= 3).withColumn("own", W.singular(F.col("w0"))).where(~F.col("own").isin(*stop_words))
    single = starts.where(W.is_literal_word(F.col("own"), stop_words)).select("thm_id", "part", "pos", F.col("own").alias("word"))
    return single.unionByName(listed_terms(starts, ngrams))


def listed_terms(starts: DataFrame, ngrams: DataFrame) -> DataFrame:
    """``thm_id, part, pos, word``: the n-grams of ``ngrams`` among the runs ``w0, w1, w2``."""
    phrases = F.explode(F.array(
        F.when(F.col("w1").isNotNull(), F.concat_ws(" ", "w0", "w1")),
        F.when(F.col("w2").isNotNull(), F.concat_ws(" ", "w0", "w1", "w2")),
    ))
    several = starts.select("thm_id", "part", "pos", phrases.alias("phrase")).where("phrase is not null")
    return several.select("thm_id", "part", "pos", W.singular_last(F.col("phrase")).alias("word")).join(ngrams.select(F.col("ngram").alias("word")).distinct(), "word", "left_semi").select("thm_id", "part", "pos", "word")


def single_terms(raw: DataFrame, stop_words: Iterable[str] = W.STOP_WORDS) -> DataFrame:
    """``raw, word``: the index term that each word of ``raw(word)`` is, if it is one."""
    each = raw.select(F.col("word").alias("raw"), W.singular(F.col("word")).alias("word")).where((F.length("raw") >= 3) & ~F.col("word").isin(*stop_words))
    return each.where(W.is_literal_word(F.col("word"), stop_words))


def packed(lists: DataFrame) -> DataFrame:
    """``thm_id, part, line``: lists that aren't empty as lines, a quarter of the size when stored."""
    return lists.where(F.size("words") > 0).select("thm_id", "part", F.array_join("words", "\n").alias("line"))


def unpacked(lines: DataFrame) -> DataFrame:
    return lines.select("thm_id", "part", F.split("line", "\n").alias("words"))


def places() -> Column:
    """The places of a posting, in order; empty if all of them are past the last that is kept."""
    return F.array_sort(F.collect_set(F.when(F.col("pos") < LAST_POSITION, F.col("pos")))).alias("positions")


def postings(terms: DataFrame) -> DataFrame:
    """``word, thm_id, part, positions``: one row for each word and statement, the statement's part
    first. A word that only stands past the last place that is kept has a row without places."""
    each = all_postings(terms).withColumn("rank", F.when(F.col("part") == "T", 0).otherwise(1))
    first = each.groupBy("word", "thm_id").agg(F.min(F.struct("rank", "positions")).alias("p"))
    return first.select("word", "thm_id", F.when(F.col("p.rank") == 0, "T").otherwise("H").alias("part"), "p.positions")


def containing(lists: DataFrame, terms: DataFrame) -> DataFrame:
    """``word, thm_id, part, positions`` of ``terms(raw, word)``, one row for each word and statement;
    no place is looked for, so that a list's words are made different before they are looked up."""
    raw = lists.select("thm_id", F.explode(F.array_distinct("words")).alias("raw"))
    found = raw.join(terms, "raw").select("word", "thm_id").distinct()
    return found.select("word", "thm_id", F.lit("T").alias("part"), F.array().cast("array<int>").alias("positions"))


def all_postings(terms: DataFrame) -> DataFrame:
    """As :func:`postings`, with a row for each part."""
    return terms.groupBy("word", "thm_id", "part").agg(places())


def literal_postings(texts: DataFrame, stop_words: Iterable[str] = W.STOP_WORDS) -> DataFrame:
    """``word, thm_id, positions``: valid words in the singular, with their first two places.

    Places count the valid words of hypotheses and statement, in this order, from 0; the index goes
    through 256 of them.
    """
    both = texts.groupBy("thm_id").agg(F.max(F.when(F.col("part") == "H", F.col("text"))).alias("h"), F.max(F.when(F.col("part") == "T", F.col("text"))).alias("t"))
    raw = F.filter(W.split_words(F.concat_ws(" ", "h", "t")), lambda w: W.is_literal_word(w, stop_words))
    valid = F.filter(F.transform(raw, lambda w: W.singular(w)), lambda w: ~w.isin(*stop_words))
    found = both.select("thm_id", F.posexplode(F.slice(valid, 1, LITERAL_WORDS)).alias("pos", "word"))
    return found.groupBy("word", "thm_id").agg(F.slice(F.array_sort(F.collect_set("pos")), 1, LITERAL_POSITIONS).alias("positions"))


def capped(literal: DataFrame, most: int = LITERAL_STATEMENTS) -> DataFrame:
    """At most ``most`` statements of a word, the smallest ids first (a limit of the stored index;
    Spark applies it to each task's rows before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy("word").orderBy("thm_id"))
    return literal.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def folded_lists(literal: DataFrame) -> DataFrame:
    """``word, thm_indices``: the stored form of a capped literal index."""
    return literal.groupBy("word").agg(F.array_sort(F.collect_list("thm_id")).alias("thm_indices"))


def rebundled(vectors: DataFrame, size: int = 100_000) -> DataFrame:
    """A bundle number for each statement, for writing by ``partitionBy``."""
    return vectors.withColumn("bundle", F.floor(F.col("thm_id") / size).cast("int"))


def reindexed(bundles: DataFrame) -> DataFrame:
    """``bundle, local_id, thm_id``: local ids 0.. of each bundle shifted by the sizes of those before.

    Only the bundle sizes pass through one task, not the rows.
    """
    return concatenated(bundles.select("bundle", "local_id"))


def concatenated(bundles: DataFrame) -> DataFrame:
    """``bundles(bundle, local_id, ..)`` with ``thm_id``: as :func:`reindexed`, with all columns."""
    sizes = bundles.groupBy("bundle").agg((F.max("local_id") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bundle").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bundles.join(sizes.select("bundle", before.alias("offset")), "bundle").select(*bundles.columns, (F.col("local_id") + F.col("offset")).cast("bigint").alias("thm_id"))
