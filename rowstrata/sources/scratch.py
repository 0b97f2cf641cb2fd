"""Databases for one query, under the folder that the session's executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from .database import Database


def scratch_database(spark: SparkSession, **options) -> Database:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        root = "file://" + tempfile.mkdtemp(prefix="rowstrata-")
        spark.sparkContext.setCheckpointDir(root)
    return Database(spark, f"{root.rstrip('/')}/database-{uuid.uuid4().hex}", **options)
