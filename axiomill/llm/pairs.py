"""Pairs of the rows of a group, joins whose keys may be hot, and lookups in tables that are mostly small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group that are paired, or of the right side that are joined, in one piece.
PART = 512


def within(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``a, b`` (a < b): the pairs of different values of one group. ``rows`` has each value of a group once.

    A large group is cut in parts by a hash of the value, and each pair of parts is joined by itself.
    """
    parts = F.ceil(F.count("*") / PART).cast("int")
    several = rows.groupBy(group).agg(F.count("*").alias("_n"), parts.alias("_parts")).where("_n > 1").select(group, "_parts")
    own = rows.select(group, value).join(several, group).withColumn("_own", F.pmod(F.xxhash64(value), "_parts").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    left = own.select(group, F.col("_own").alias("_p"), every.alias("_q"), F.col(value).alias("a"))
    right = own.select(group, F.col("_own").alias("_q"), every.alias("_p"), F.col(value).alias("b"))
    return left.join(right, [group, "_p", "_q"]).where("a < b").select("a", "b")


def met(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join on ``key``, with the rows of the right side's hot keys cut in parts that are
    joined by themselves. ``key`` is left out of the result."""
    parts = right.groupBy(key).agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts"))
    one = left.join(parts, key).withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    two = right.join(parts, key).withColumn("_p", F.pmod(F.xxhash64(*(c for c in right.columns if c != key)), "_parts").cast("int")).drop("_parts")
    return one.join(two, [key, "_p"]).drop(key, "_p")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The left join of ``rows`` with a stored ``table``. It is broadcast if it has at most ``most`` rows,
    so that ``rows`` stay where they are and in their order; a larger one is joined by a shuffle."""
    return rows.join(F.broadcast(table) if table.count() <= most else table, keys, "left")
