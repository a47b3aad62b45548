"""Writers: partitioned tables, an atomic swap, CSV, text and JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """One folder for each value of ``by``; rows of a folder come from few tasks, so files stay large."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_text(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").text(path)


def write_expressions(found: DataFrame, path: str) -> int:
    """Writes the expressions of parsed sentences as lines of text; returns how many there are."""
    write_text(found.where("expression is not null").select(F.regexp_replace("expression", r"\s+", " ").alias("value")), path)
    return found.sparkSession.read.text(path).count()


def save_table(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 64) -> None:
    """A table, sorted and bucketed by a key if later joins are to go without a shuffle."""
    writer = df.write.mode("overwrite")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)


def publish(df: DataFrame, path: str) -> None:
    """Writes beside ``path`` and renames into its place; the old rows stay until then, and come back
    if the swap fails."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    tag = uuid.uuid4().hex
    fresh, old = f"{path}.new-{tag}", f"{path}.old-{tag}"
    df.write.parquet(fresh)
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(p(path))
    if had and not fs.rename(p(path), p(old)):
        fs.delete(p(fresh), True)
        raise OSError(f"{path} can't be moved away")
    if not fs.rename(p(fresh), p(path)):
        if had:
            fs.rename(p(old), p(path))
        fs.delete(p(fresh), True)
        raise OSError(f"{fresh} can't be moved to {path}")
    if had:
        fs.delete(p(old), True)


def name_rows(statements: DataFrame, papers: DataFrame) -> DataFrame:
    """``thm_id, paper_id, authors`` for the author loader's CSV."""
    return statements.select("thm_id", "paper_id").distinct().join(papers.select("paper_id", "authors").distinct(), "paper_id").select("thm_id", "paper_id", "authors")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("quote", "'").option("escape", "\\").csv(path)


def as_json(df: DataFrame, key: str, value: str) -> DataFrame:
    """``line``: one JSON object for each row."""
    return df.select(F.to_json(F.struct(F.col(key), F.col(value))).alias("line"))
