"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that isn't there yet, below spark.checkpoint.dir; in local mode, where that is unset, below a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = _own.get(context.applicationId) or _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="tabloom-"))
    return f"{top.rstrip('/')}/tabloom/{name}-{uuid.uuid4().hex}"


def stage(rows: DataFrame, name: str) -> DataFrame:
    """Rows written as a table in a folder of their own, and read from there."""
    at = new_folder(rows.sparkSession, name)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)
