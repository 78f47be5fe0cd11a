"""What the session must know before Python functions of this package run on executors, and tables written in between."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession | None = None) -> None:
    """Let Python workers import this package from where the driver has it."""
    spark = spark or SparkSession.active()
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see; one of our own only in local mode, where the setting may be absent."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder once, for plans that read it several times; a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
