"""Concept search: statements with all of some words, and the vocabulary entries of a statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Results of a query, concepts of a statement.
RESULTS, CONCEPTS = 60, 20


def holding_rarest(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """``query_id, thm_id``: the statements with a query's rarest word. No others can have all of its
    words, so the other words are looked up for those only. ``asked(query_id, word)``, each once."""
    df = postings.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    rare = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "word"))
    first = asked.join(df, "word", "left").withColumn("r", rare).where("r = 1").select("query_id", "word")
    return postings.join(first, "word").select("query_id", "thm_id").distinct()


def all_words(postings: DataFrame, words: DataFrame, most: int = RESULTS) -> DataFrame:
    """``query_id, thm_id, n_statement, rn``: statements with every word of a query, those first that
    have most of them in the statement itself. ``words(query_id, word)``."""
    asked = words.select("query_id", "word").distinct()
    need = asked.groupBy("query_id").agg(F.count("*").alias("need"))
    possible = holding_rarest(postings, asked)
    met = possible.join(asked, "query_id").join(postings, ["word", "thm_id"]).groupBy("query_id", "thm_id").agg(F.count_distinct("word").alias("has"), F.sum((F.col("part") == "T").cast("bigint")).alias("n_statement"))
    order = Window.partitionBy("query_id").orderBy(F.desc("n_statement"), "thm_id")
    return met.join(need, "query_id").where("has = need").select("query_id", "thm_id", "n_statement").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)


def extracted(terms: DataFrame, vocab: DataFrame, most: int = CONCEPTS) -> DataFrame:
    """``thm_id, concepts``: at most ``most`` vocabulary numbers of a statement, by first place."""
    met = terms.join(vocab.select("word", "word_idx"), "word").groupBy("thm_id", "word_idx").agg(F.min(F.struct((F.col("part") == "H").cast("int").alias("h"), "pos")).alias("at"))
    order = Window.partitionBy("thm_id").orderBy("at", "word_idx")
    kept = met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return kept.groupBy("thm_id").agg(F.array_sort(F.collect_list("word_idx")).alias("concepts"))


def displayed(lists: DataFrame, concepts: DataFrame, representatives: DataFrame | None = None) -> DataFrame:
    """``thm_id, terms``: the terms of a list of concept numbers, in its order; unknown ones are left out."""
    each = lists.select("thm_id", F.posexplode("thmconcepts").alias("at", "concept_id")).join(concepts, "concept_id")
    if representatives is not None:
        each = each.join(representatives.select(F.col("stem").alias("term"), F.col("word").alias("full")), "term", "left").withColumn("term", F.coalesce("full", "term"))
    return each.groupBy("thm_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("terms"))
