"""Classes of statements and papers: votes of neighbours, a bag-of-words classifier, keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vote(neighbours: DataFrame, labels: DataFrame, lengths: tuple[int, ...] = (5, 3, 2)) -> DataFrame:
    """``query_id, prefix, votes, rn``: classes of a query by its neighbours.

    A neighbour at squared distance d and rank r gives 1/(4 + e^(d/12)) · 1/(2.5 + e^(r/8)) to its
    class and to each prefix of it. ``neighbours(query_id, vec_id, dist2, rn)``, ``labels(vec_id, label)``.
    """
    weight = 1 / (4 + F.exp(F.col("dist2") / 12)) / (2.5 + F.exp(F.col("rn") / 8))
    each = neighbours.join(labels, "vec_id").withColumn("w", weight)
    prefixes = F.array_distinct(F.array(*(F.substring("label", 1, n) for n in lengths)))
    votes = each.select("query_id", "w", F.explode(prefixes).alias("prefix")).groupBy("query_id", "prefix").agg(F.round(F.sum("w"), 6).alias("votes"))
    order = Window.partitionBy("query_id", F.length("prefix")).orderBy(F.desc("votes"), "prefix")
    return votes.withColumn("rn", F.row_number().over(order))


def matched_objects(tokens: DataFrame, keywords: DataFrame) -> DataFrame:
    """``query_id, object, n, rn``: objects by how many of their keywords a query has.
    ``keywords(word, object)``."""
    met = tokens.select("query_id", "word").distinct().join(keywords, "word").groupBy("query_id", "object").agg(F.count("*").alias("n"))
    return met.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "object")))


def classifier(texts: DataFrame, features: int = 1 << 12, iterations: int = 30):
    """A linear bag-of-words model of ``texts(words array<string>, label double)``, trained on all rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    return Pipeline(stages=[HashingTF(inputCol="words", outputCol="features", numFeatures=features), LogisticRegression(maxIter=iterations, regParam=0.01)]).fit(texts)
