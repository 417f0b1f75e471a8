"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """New path in ``spark.checkpoint.dir``; only under a local master without one, in the machine's temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return os.path.join(base or tempfile.mkdtemp(prefix="tabstudy-"), uuid.uuid4().hex, name)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table, written as Parquet and read back, and where it lies."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
