"""Parquet tables by name below a data folder, and fresh paths below the session's shared folder."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to, below ``spark.checkpoint.dir``.

    A local session without one gets a temporary folder; a cluster has to name one, which all
    executors share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{tempfile.gettempdir()}/tributary-scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def identity(text: str) -> str:
    """A short fingerprint of a text."""
    return hashlib.sha256(text.encode()).hexdigest()[:16]
