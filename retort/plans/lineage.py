"""Cutting a frame's lineage at the cluster's shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to ``spark.checkpoint.dir``; a private folder is made only where none is set and all of
    Spark is one process."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all nodes share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="retort-"))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder, for a table that is written and read again."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut(spark.range(0).toDF("id"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
