"""The folder that the driver and all executors share, and tables kept there for a while."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, what: str) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir; a temporary one only on a single machine that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{named}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, rows: int = 0) -> DataFrame:
    """The same rows, written and read back: what follows sees them as they are now, however often it reads them. rows: of a file at most (0: any), where one row is large; what is
    written and read together is bounded by it."""
    path = folder(df.sparkSession, what)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
