"""Frequency of every distinct value: occurrences and record counts, with frequency bounds.

Counts are combined partially in each task before the shuffle (Spark's hash aggregate), so what a
frequent word sends over the network is one row per task and statement, never its whole list.
A word that fills a third of all rows is spread over tasks by ``(word, thm_id)``; nothing is ever
gathered per word.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_word(word: Column) -> Column:
    """Trimmed and lower-cased; null stays null, blanks only become the empty word."""
    return F.lower(F.trim(word))


def word_counts(index: DataFrame) -> DataFrame:
    """``word, n_occurrences, n_statements`` of a literal index.

    ``index`` has ``word``, ``thm_indices`` and ``word_indices`` (two positions for each entry of
    ``thm_indices``, -1 where there is none). Extra columns are ignored.

    * Null words give no row. A word whose lists are all null or empty has zero counts.
    * A statement listed in several rows of a word, or twice in one, counts once in
      ``n_statements``; repeated ``(statement, positions)`` entries count once in
      ``n_occurrences``, so a delivery that is repeated changes nothing.
    * Missing positions (a null or short ``word_indices``) count as no occurrence.
    """
    rows = index.select(normal_word(F.col("word")).alias("word"), "thm_indices", "word_indices").where("word is not null")
    entries = rows.select(
        "word",
        F.posexplode_outer("thm_indices").alias("at", "thm_id"),
        "word_indices",
    ).select(
        "word",
        "thm_id",
        F.get("word_indices", F.col("at") * 2).alias("first"),
        F.get("word_indices", F.col("at") * 2 + 1).alias("second"),
    )
    # One row for each word, statement and pair of positions, combined before the shuffle; the
    # further levels group by prefixes of that key.
    distinct = entries.groupBy("word", "thm_id").agg(
        F.collect_set(F.struct("first", "second")).alias("places")
    )
    places = F.filter(
        F.array_distinct(F.flatten(F.transform("places", lambda p: F.array(p["first"], p["second"])))),
        lambda x: x.isNotNull() & (x >= 0),
    )
    return distinct.groupBy("word").agg(
        F.sum(F.size(places)).cast("bigint").alias("n_occurrences"),
        F.count("thm_id").alias("n_statements"),
    )


def marked(counts: DataFrame, statements: DataFrame, rare: int = 2, common_share: float = 0.05) -> DataFrame:
    """``counts`` with ``mark``: 'rare' for 1..``rare`` statements, else 'common' above
    ``common_share`` of all distinct ``statements.thm_id``, else null.

    The bound is compared in whole numbers (of the share as it is written), so no rounding decides a tie.
    """
    share = Fraction(str(common_share))
    total = statements.select("thm_id").where("thm_id is not null").distinct().agg(F.count("*").alias("n_all"))
    n = F.col("n_statements")
    mark = F.when(n.between(1, rare), "rare").when(n * F.lit(share.denominator) > F.col("n_all") * F.lit(share.numerator), "common")
    # A one-row table: the broadcast has eight bytes.
    return counts.crossJoin(F.broadcast(total)).withColumn("mark", mark).drop("n_all")
