"""Cutting a plan's lineage with tables in the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_SETTING = "spark.checkpoint.dir"


def checkpoint_folder(df: DataFrame) -> str:
    """The shared checkpoint folder of the session; a private one only on a local master."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get(_SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the checkpoint folder and read it back.

    The shared folder survives lost executors, later steps start from the files, and unlike a
    checkpoint the plan is computed only once. Old tables are the cluster's to clean up, as with
    any checkpoint folder.
    """
    path = f"{checkpoint_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
