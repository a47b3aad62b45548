"""The most similar other rows of every row, by squared cosine of 0/1 vectors.

Vectors are sets of ids; equal vectors are one class. Similar pairs of classes come from
:mod:`axiomill.llm.sets` and carry their exact similarity; neighbours are then ranked per class.
A class passes on at most k + 1 of its members, as no row can have more of them as neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axiomill.llm import sets as S

#: Weighted similarity of vectors at the limit of 0.25 (half of the ids shared: a third of the union,
#: less what is shared of frequent ids), for the first bands.
WEIGHTED_AT_LIMIT = 0.3
TARGET_RECALL = 0.995
#: Up to this size, all pairs of ids are keys.
SMALL = 8
#: Vectors that share one id only can be similar up to this product of their sizes.
ONE_SHARED = 4


def squared_cosine() -> S.Similarity:
    """shared² / (size_a · size_b) if it is at least 0.25, else null. Equal fractions of whole
    numbers are equal doubles, so ties are exact. Products are of 64 bits: lists of more than 23,170
    ids are beyond 32 bits."""
    over = F.col("size_a").cast("bigint") * F.col("size_b")
    shared = F.col("shared").cast("bigint")

    def possible(n, a, b):
        return n.astype("int64") ** 2 * 4 >= a.astype("int64") * b

    return S.Similarity(F.when(shared * shared * 4 >= over, shared * shared / over), possible)


def sharing_one(sets: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """``fp, other_fp, other, sim``: of each short vector the neighbours that share one id only.

    All that share the id alone are equally similar if they are of one size, so of each id and size
    only the k + 1 smallest keys count: a frequent id sends those, and not all pairs.
    """
    short = sets.where(F.size("items") <= ONE_SHARED).groupBy("fp").agg(F.first("items").alias("items"))
    ids = short.select("fp", F.size("items").alias("n"), "items", F.explode("items").alias("v"))
    held = ids.withColumnsRenamed({"fp": "other_fp", "n": "m", "items": "other_items"}).join(first, "other_fp")
    least = held.withColumn("r", F.row_number().over(Window.partitionBy("v", "m").orderBy("other"))).where(F.col("r") <= k + 1).drop("r")
    met = ids.join(least, "v").where((F.col("n") * F.col("m") <= ONE_SHARED) & (F.col("fp") != F.col("other_fp")))
    one = met.where(F.size(F.array_intersect("items", "other_items")) == 1)
    return one.select("fp", "other_fp", "other", (1 / (F.col("n") * F.col("m"))).alias("sim"))


def neighbours(rows: DataFrame, key: str, ids: str, k: int = 5) -> DataFrame:
    """``key, other, sim``: at most ``k`` others of highest similarity >= 0.25, ties to the smaller key.

    * Null keys, null and empty lists have no neighbours and are nobody's; null ids are ignored,
      an id listed twice counts once, repeated rows of a key count once.
    * Copies of a vector are neighbours with similarity 1. An empty table gives no rows.
    """
    sets = S.as_sets(rows, key, ids)
    members, similar = S.similar_classes(sets, key, squared_cosine(), WEIGHTED_AT_LIMIT, TARGET_RECALL, SMALL)
    # The group limit of a ranking filter works before the shuffle too: a class shared by a third of
    # all rows sends k + 1 rows for each task.
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("fp").orderBy(key))).where(F.col("r") <= k + 1).select(F.col("fp").alias("other_fp"), F.col(key).alias("other"))
    ends = similar.select(F.col("a").alias("fp"), F.col("b").alias("other_fp"), "sim").unionAll(similar.select(F.col("b").alias("fp"), F.col("a").alias("other_fp"), "sim"))
    best = Window.partitionBy("fp").orderBy(F.desc("sim"), "other")
    across = ends.join(first, "other_fp").select("fp", "other_fp", "other", "sim")
    # A pair that shares one id only may have met in a band too.
    across = across.unionAll(sharing_one(sets, first, k)).groupBy("fp", "other").agg(F.max("sim").alias("sim"))
    inside = first.select(F.col("other_fp").alias("fp"), "other", F.lit(1.0).alias("sim"))
    # One more than k for each class, as a row is not its own neighbour.
    ranked = across.unionAll(inside).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    per_class = ranked.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), "other"))).alias("all"))
    own = members.join(per_class, "fp").select(key, F.slice(F.filter("all", lambda x: x["other"] != F.col(key)), 1, k).alias("best"))
    one = own.select(key, F.explode("best").alias("n")).select(key, F.col("n.other").alias("other"), (-F.col("n.s")).alias("sim"))
    return one


def neighbour_pairs(rows: DataFrame, key: str, ids: str, k: int = 5) -> DataFrame:
    """``a, b`` (a < b): pairs of which at least one is a neighbour of the other."""
    found = neighbours(rows, key, ids, k)
    return found.select(F.least(key, "other").alias("a"), F.greatest(key, "other").alias("b")).distinct()
