"""Normal forms of words by lookups: endings, gerunds, stems, and the first form a vocabulary knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomill.functions import words as W


def normalized(words: DataFrame, known: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """``word, normal`` of distinct words.

    -ly goes if the rest is known, -ness always; -ing goes if the rest, or the rest with e, is
    known; then a stem stands for the word. Known words, and words of fewer than four letters (five
    for -ing), keep their endings. Each candidate is one left join with the known words.
    """
    own = words.select("word").where("word is not null").distinct()
    have = known.select(F.col("word").alias("k")).distinct()

    def lookup(df: DataFrame, value, flag: str) -> DataFrame:
        side = have.select(F.col("k").alias(f"_{flag}"))
        return df.withColumn("_c", value).join(side, F.col("_c") == F.col(f"_{flag}"), "left").withColumn(flag, F.col(f"_{flag}").isNotNull()).drop("_c", f"_{flag}")

    w, n = F.col("word"), F.length("word")
    df = lookup(own, w, "whole")
    df = lookup(df, F.when(w.endswith("ly"), F.substring(w, F.lit(1), n - 2)), "ly")
    bare = (
        F.when(F.col("whole") | (n < 4), w)
        .when(w.endswith("ly") & F.col("ly"), F.substring(w, F.lit(1), n - 2))
        .when(w.endswith("ness"), F.substring(w, F.lit(1), n - 4))
        .otherwise(w)
    )
    df = df.withColumn("bare", bare)
    b = F.col("bare")
    rest = F.when(b.endswith("ing") & (F.length(b) >= 5), F.substring(b, F.lit(1), F.length(b) - 3))
    df = lookup(lookup(lookup(df, b, "kept"), rest, "rest"), F.concat(rest, F.lit("e")), "rest_e")
    stem = F.when(F.col("kept"), b).when(F.col("rest"), rest).when(F.col("rest_e"), F.concat(rest, F.lit("e"))).otherwise(b)
    out = df.select("word", stem.alias("normal"))
    if stems is None:
        return out
    map_ = stems.select(F.col("word").alias("normal"), "stem")
    return out.join(map_, "normal", "left").select("word", F.coalesce("stem", "normal").alias("normal"))


def vocabulary_index(words: DataFrame, vocab: DataFrame, normal: DataFrame) -> DataFrame:
    """``word, word_idx``: of the word itself, its normal form, its singular or the singular's normal
    form, the first that the vocabulary has; words without any are left out."""
    own = words.select("word").distinct().withColumn("one", W.singular(F.col("word")))
    forms = own.join(normal, "word", "left").join(normal.select(F.col("word").alias("one"), F.col("normal").alias("one_normal")), "one", "left")
    each = forms.select("word", F.posexplode(F.array("word", "normal", "one", "one_normal")).alias("at", "form"))
    met = each.join(vocab.select(F.col("word").alias("form"), "word_idx"), "form")
    return met.groupBy("word").agg(F.min(F.struct("at", "word_idx")).alias("m")).select("word", F.col("m.word_idx").alias("word_idx"))


def edge_valid(ngrams: DataFrame, parts: DataFrame) -> DataFrame:
    """n-grams whose first and last word are no verb, gerund or participle by ``parts(word, pos)``
    (words without an entry pass)."""
    bad = parts.where(F.col("pos").isin("verb", "gerund", "parti", "adverb")).select("word").distinct()
    each = ngrams.withColumn("first", F.element_at(F.split("ngram", " "), 1)).withColumn("last", F.element_at(F.split("ngram", " "), -1))
    return each.join(bad.withColumnRenamed("word", "first"), "first", "left_anti").join(bad.withColumnRenamed("word", "last"), "last", "left_anti").select(*ngrams.columns)
