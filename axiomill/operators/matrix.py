"""Weighted term-document entries, word counts of papers and sentences for word embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiomill.functions import markup
from axiomill.functions import words as W

#: The share of a related word, and the weight in place of zero.
RELATED_SHARE, DEFAULT = 0.8, 0.3


def weight(score: Column) -> Column:
    return F.when(score == 0, DEFAULT).otherwise(score.cast("double"))


def entries(terms: DataFrame, vocab: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """``thm_id, word_idx, weight``: the score of each term of a statement, and 0.8 of it for related
    terms; of two weights for one place the greater."""
    own = terms.select("thm_id", "word").distinct().join(vocab.select("word", "word_idx", "score"), "word")
    out = own.select("thm_id", "word_idx", weight(F.col("score")).alias("weight"))
    if related is not None:
        other = vocab.select(F.col("word").alias("related_word"), F.col("word_idx").alias("other_idx"))
        more = own.join(related.where("rank <= 4"), "word").join(other, "related_word")
        out = out.unionByName(more.select("thm_id", F.col("other_idx").alias("word_idx"), F.round(F.col("score") * RELATED_SHARE, 6).alias("weight")))
    return out.groupBy("thm_id", "word_idx").agg(F.max("weight").alias("weight"))


def query_vector(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``query_id, word_idx, weight``: of a repeated term the last weight, i.e. one."""
    return tokens.select("query_id", "word").distinct().join(vocab, "word").select("query_id", "word_idx", F.col("score").cast("double").alias("weight"))


def paper_words(tokens: DataFrame, papers: DataFrame) -> DataFrame:
    """``paper_id, words``: ``word,count;word,count`` in the order of words. ``papers(thm_id, paper_id)``."""
    counts = tokens.where(F.col("word").rlike(r"^[a-z]{3,}\z")).join(papers, "thm_id").groupBy("paper_id", W.singular(F.col("word")).alias("word")).agg(F.count("*").alias("n"))
    pair = F.concat_ws(",", "word", F.col("n").cast("string"))
    return counts.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", pair.alias("p")))), lambda x: x["p"]), ";").alias("words"))


def skipgram_sentences(texts: DataFrame, key: list[str]) -> DataFrame:
    """``key, at, words``: sentences of more than four words of at least three letters, in the
    singular, without let, then, and, have."""
    each = texts.select(*key, F.posexplode(markup.sentences(F.lower("text"))).alias("at", "sentence"))
    valid = F.filter(F.split("sentence", r"\s+"), lambda w: w.rlike(r"^[a-z]{3,}\z") & ~w.isin("let", "then", "and", "have"))
    return each.select(*key, "at", F.transform(valid, lambda w: W.singular(w)).alias("words")).where(F.size("words") > 4)


def literal_json(weights: DataFrame) -> DataFrame:
    """One row with all (word, score) pairs of a bounded vocabulary as a JSON object."""
    return weights.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "score"))))).alias("json"))
