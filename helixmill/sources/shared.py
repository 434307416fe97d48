"""Intermediate files in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
from contextlib import suppress
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder name that all executors see, deleted when the driver ends.

    It is under ``spark.checkpoint.dir``; only a session in one process may leave that unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{named or tempfile.mkdtemp(prefix='helixmill-')}/work-{uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder, if the session is still there."""
    with suppress(Exception):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and reread it, so that what uses it several times computes it once."""
    path = scratch(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


#: Bytes of input files that a task of a shuffle stands for.
TASK_BYTES = 4 << 20


def tasks(frame: DataFrame) -> int:
    """Tasks for a shuffle of rows that become many more: in proportion to the files that a frame is read from, as many as cores at least.

    Told by number they aren't coalesced, so what a task holds doesn't grow with
    the input.  A frame that isn't read from files has the session's number.
    """
    spark = frame.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    size = 0
    files = frame.inputFiles()
    for file in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)) if files else int(spark.conf.get("spark.sql.shuffle.partitions"))
