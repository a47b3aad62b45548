"""Session helpers shared by every module: reading tables and cutting lineage.

Nothing here holds data on the driver; a table is always a lazily read DataFrame.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data set in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session that names none
    gets a temporary one; a cluster without the setting is refused, as a machine-local folder
    could not be read by the other executors.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="axiomill-checkpoint-")
        sc.setCheckpointDir(named)
    return df.checkpoint(eager)
