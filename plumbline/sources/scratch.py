"""Folders that the driver and all executors share, for what is written between two steps."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, what: str) -> str:
    """A fresh folder under spark.checkpoint.dir. Where that is unset a local one is made, but only if all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            own = tempfile.mkdtemp(prefix="plumbline-core-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _own[app] = f"file://{own}"
        base = _own[app]
    return f"{base.rstrip('/')}/plumbline/{what}-{uuid.uuid4().hex}"
