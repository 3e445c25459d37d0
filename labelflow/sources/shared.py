"""Folders that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new path under spark.checkpoint.dir. A local session without that setting (tests) takes one under its temporary
    folder; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(f"file://{sc._jvm.System.getProperty('java.io.tmpdir')}/shared-{uuid.uuid4().hex}")
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{kind}/{uuid.uuid4().hex}"
