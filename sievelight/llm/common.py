"""Session helpers shared by the operators: the shared folder, written tables, Arrow batch bounds."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python stay under this many bytes (a longer single text makes a batch of its own).
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone, as in tests, a temporary folder is made and set; on a
    cluster that is an error, since executors wouldn't see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="sievelight-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that their Python workers can import it from anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_sievelight_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as tmp:
        shutil.copytree(package, f"{tmp}/src/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), package.name), "zip", f"{tmp}/src")
    sc.addPyFile(made)
    sc._sievelight_shipped = True


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of each Arrow batch sent to Python workers, for texts of any length, and send them this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def release(spark: SparkSession) -> None:
    """Let the driver forget finished shuffles, so that executors delete their files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def save(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here.

    Any executor can reread the table, so a lost executor costs nothing that was saved. Returns the table and its path,
    for ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievelight/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left.add(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path), path


#: Saved tables that are still there: those that a returned table reads.
_left: set[str] = set()


def drop_all(spark: SparkSession) -> None:
    """Delete every table that this program has saved and not dropped; call it when no result of an operator is read any more."""
    drop(spark, *list(_left))


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete saved tables that nothing reads any more."""
    _left.difference_update(paths)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


#: A key with over a HOTth of a table's rows, and at least LEAST_HOT of them, is hot; a table can have HOT of them at most.
HOT, LEAST_HOT = 4096, 128


def spread_join(left: DataFrame, keyed: DataFrame, key: str, rows: int, count: str = "n") -> DataFrame:
    """``left`` joined with ``keyed``, which has each key (an integer, or letters and digits) once and in ``count`` how many of the ``rows`` rows of ``left`` have it.

    The rows of hot keys are joined where they are, with the at most ``HOT`` hot rows of ``keyed`` broadcast; only rows of other
    keys are shuffled, so no task gets more than its share. Give saved tables: both are read again.
    """
    hot = [r[0] for r in keyed.where((F.col(count) * HOT >= rows) & (F.col(count) >= LEAST_HOT)).select(key).collect()]  # HOT at most
    keyed = keyed.drop(count)
    if not hot:
        return left.join(keyed, key)
    is_hot = F.expr(f"{key} IN ({', '.join(f'{k}L' if isinstance(k, int) else repr(k) for k in hot)})")
    return left.where(is_hot).join(F.broadcast(keyed.where(is_hot)), key).unionByName(left.where(~is_hot).join(keyed.where(~is_hot), key))


def same_columns(docs: DataFrame, text: str, make) -> DataFrame:
    """``docs`` by ``mapInArrow`` with ``make`` of the text column's name; columns are numbered meanwhile, so they may have any name."""
    named = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*named)
    return plain.mapInArrow(make(named[docs.columns.index(text)]), plain.schema).toDF(*docs.columns)


def lean(run):
    """A ``mapInArrow`` function that returns to the system what its task has freed, since workers live on for the next task."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def fresh(name: str, taken) -> str:
    """``name``, or with underscores before it one that isn't taken, in any case of its letters."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def cut_blocks(cuts: list[float], key: str) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``block`` to a table: the number of ``cuts``, which ascend, that aren't over the integer ``key``.

    Rows find their block by binary search; equal keys are in one block.
    """
    if not cuts:
        return lambda rows: rows.withColumn("block", F.lit(0))
    cutter = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_key", outputCol="_block")

    def place(rows: DataFrame) -> DataFrame:
        return cutter.transform(rows.withColumn("_key", F.col(key).cast("double"))).withColumn("block", F.col("_block").cast("int")).drop("_key", "_block")

    return place


def even_cuts(rows: DataFrame, key: str, size: str, each: int, most: int = 50_000, per: int = 16) -> list[float]:
    """Keys that cut ``rows`` into ranges of about ``each`` of the column ``size`` together, at most ``most`` ranges.

    They follow from the rows alone, whatever the partitions: about ``per`` keys a range, chosen by their hashes, come to
    the driver, and the cuts stand where their sizes add up.
    """
    n, total = rows.agg(F.count(F.lit(1)), F.sum(size)).first()
    ranges = min(most, math.ceil((total or 0) / each))
    if ranges < 2:
        return []
    share = min(1 << 20, math.ceil((1 << 20) * per * ranges / n))
    sample = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share).groupBy(key).agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("n")).orderBy(key).collect()
    weight = sum(r["s"] + r["n"] for r in sample)
    cuts, at = [], 0
    for r in sample:
        if at >= weight * (len(cuts) + 1) / ranges:
            cuts.append(float(r[key]))
        at += r["s"] + r["n"]
    return sorted(set(cuts))
