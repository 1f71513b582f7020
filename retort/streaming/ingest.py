"""Molecule tables that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retort.operators.molecules import select_molecules


def stream_molecules(spark: SparkSession, folder: str, schema: str, select: str | None = None, label: str | None = None) -> DataFrame:
    """A stream of the JSON-lines files of a folder, filtered and labelled like a table."""
    return select_molecules(spark.readStream.schema(schema).json(folder), select, label)
