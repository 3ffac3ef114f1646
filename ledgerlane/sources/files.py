"""Folders of a job: stored tables that may be absent yet, and scratch folders that all executors share."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ledgerlane.session import ensure_checkpoint_dir


def stored_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """The rows below a path, or None if nothing is there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scratch_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder below the checkpoint folder of the session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
