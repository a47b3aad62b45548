"""Near-duplicate records: every pair above a Jaccard similarity, and the groups they form.

Candidates come from MinHash bands (:mod:`axiomill.llm.sets`), each is verified on the full sets.
Exact copies are one class throughout; they are paired only in the result of :func:`pairs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomill.llm import sets as S
from axiomill.llm.components import components
from axiomill.llm.pairs import within

#: The first bands are made for sets that share this much of what the weighted orders prefer: edits fall
#: on rare words rather than on frequent ones, so it lies below the limit itself. What the bands miss is
#: estimated on the result, and more of them are added.
WEIGHTED_AT_LIMIT = 0.53
TARGET_RECALL = 0.99


def jaccard_at_least(tenths: int) -> S.Similarity:
    """The Jaccard similarity if it reaches ``tenths`` / 10, else null; compared in whole numbers."""
    shared, union = F.col("shared"), F.col("size_a") + F.col("size_b") - F.col("shared")
    return S.Similarity(F.when(shared * 10 >= union * tenths, shared / union), lambda n, a, b: n * 10 >= (a + b - n) * tenths)


def classes(rows: DataFrame, key: str, values: str, tenths: int = 7) -> tuple[DataFrame, DataFrame]:
    """(``key, fp``: the class of each row; ``a, b, sim``: the similar pairs of classes)."""
    return S.similar_classes(S.as_sets(rows, key, values), key, jaccard_at_least(tenths), WEIGHTED_AT_LIMIT, TARGET_RECALL)


def pairs(rows: DataFrame, key: str, values: str, tenths: int = 7) -> DataFrame:
    """``a, b``: all pairs of different keys (a < b) with Jaccard similarity >= ``tenths`` / 10.

    * Null keys, null values and empty sets match nothing.
    * Repeated rows of a key count once; a key with several different values has all of them.
    * Exact copies are a pair like any other. An empty table gives no rows.
    """
    members, similar = classes(rows, key, values, tenths)
    left = members.select(F.col("fp").alias("fa"), F.col(key).alias("x"))
    right = members.select(F.col("fp").alias("fb"), F.col(key).alias("y"))
    across = similar.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(left, "fa").join(right, "fb").where("x <> y")
    return within(members, "fp", key).unionAll(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def groups(rows: DataFrame, key: str, values: str, tenths: int = 7) -> DataFrame:
    """``key, group_id, n_links``: the connected group of each row with a value.

    ``group_id`` is the smallest key of the group; ``n_links`` is the number of other classes
    that the row's class is similar to. Exact copies aren't expanded into pairs.
    """
    members, similar = classes(rows, key, values, tenths)
    ends = similar.select("a", "b").unionAll(similar.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = ends.groupBy("a").agg(F.count("*").alias("n_links")).withColumnRenamed("a", "fp")
    group = components(similar.select("a", "b")).select(F.col("node").alias("fp"), F.col("component"))
    known = members.join(group, "fp", "left").join(links, "fp", "left").select(key, F.coalesce("component", "fp").alias("component"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    lowest = known.groupBy("component").agg(F.min(key).alias("group_id"))
    return known.join(lowest, "component").select(key, "group_id", "n_links").groupBy(key).agg(F.min("group_id").alias("group_id"), F.max("n_links").alias("n_links"))
