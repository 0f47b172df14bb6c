"""Tables written once in the folder that driver and executors share, under ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session's under ``spark.checkpoint.dir``; on one machine without it, as in tests, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/sievelight-tables-{spark.sparkContext.applicationId}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="sievelight-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df``, written and read back: what it was made from isn't made again, and a lost executor costs none of it."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, label: str) -> str:
    """The name of a new folder for files that tasks write; ``drop_all`` deletes it too."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _left.append(path)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def drop_all(spark: SparkSession) -> None:
    """Deletes every table that ``saved`` has written; call it when no result is read any more."""
    while _left:
        delete(spark, _left.pop())
