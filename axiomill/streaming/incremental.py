"""Keeping an index up to date as statement files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from axiomill.operators import index

SCHEMA = "thm_id int, thm string, hyp string, file_name string, thm_type string, source string, loaded_at timestamp"


def arriving(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def indexed(statements: DataFrame, batch: int) -> DataFrame:
    """``word, thm_id, positions, batch``: the literal postings of one batch."""
    return index.literal_postings(index.parts(index.statements(statements))).withColumn("batch", F.lit(batch).cast("bigint"))


def follow(statements: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes each batch's postings to a folder of its own, so a batch that is repeated after a
    failure replaces its own rows: every statement is indexed exactly once for each delivery."""

    def write(rows: DataFrame, batch: int) -> None:
        indexed(rows, batch).drop("batch").write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = statements.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """``word, thm_id, positions``: for each statement the postings of its last batch."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("thm_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["thm_id", "batch"], "left_semi").drop("batch")


def counted_windows(events: DataFrame, time: str, kind: str, value: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``kind, start, end, n, total``: arrivals and the sum of a value in windows of event time, with a
    bound on lateness. The same on a stream and on a table, where the bound has no effect."""
    windows = events.withWatermark(time, late).groupBy(F.window(time, size), kind)
    return windows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(kind, "window.start", "window.end", "n", "total")
