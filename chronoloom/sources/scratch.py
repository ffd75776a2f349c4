"""A folder that the driver and the executors share, for files that tasks write and others read. The session's end
removes what it has made."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new local path under spark.checkpoint.dir, if that is a file system that every machine has mounted; a single
    process that has no such setting gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared and re.match(r"(file:|/)", shared):
        path = f"{re.sub('^file:/*', '/', shared)}/{name}-{uuid.uuid4().hex}"
    elif re.match(r"local(\[|$)", spark.sparkContext.master):
        path = tempfile.mkdtemp(prefix=f"chronoloom-{name}-")
    else:
        raise ValueError("recordings and EDF files need a shared folder that is mounted everywhere: set spark.checkpoint.dir to one")
    os.makedirs(path, exist_ok=True)
    _MADE.append(path)
    return path


_MADE: list[str] = []


def remove(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)


@atexit.register
def _remove_all() -> None:
    for path in _MADE:
        remove(path)
