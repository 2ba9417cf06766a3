"""Cutting the lineage of iterated jobs in storage that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session (spark.checkpoint.dir). Where none is set, a local
    session gets a temporary one; a cluster session is refused."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        master = context.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tarnwatch-")
        atexit.register(shutil.rmtree, named, True)
        context.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back: a checkpoint that also leaves behind
    what the planner knew of the rows, which would grow from one iteration to the next."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
