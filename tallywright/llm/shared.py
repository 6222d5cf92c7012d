"""Helpers that the training-data operators share: stored tables and global row numbers."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The session's ``spark.checkpoint.dir`` comes first, then a checkpoint folder set on the
    context. Only a session that has neither (a local test) gets a temporary folder.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallywright-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: Bytes of an Arrow batch that goes to a Python worker, and the setting for it with Spark's default.
BATCH, BATCH_SETTING, BATCH_DEFAULT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64m", "64MB")


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold 4 MB (or one row) from now on, unless the session has a setting of its own.

    A batch is held several times over, in the JVM's direct memory and by the worker; with long texts Spark's
    64 MB are half of what an executor has for its workers.
    """
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT[0]) in BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH)


def private(name: str) -> str:
    """A column name that no caller's table has."""
    return f"_{name}_{uuid.uuid4().hex}"


def columns_of(df: DataFrame) -> list[F.Column]:
    """All columns of ``df``, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables that stored() has written in a chain of steps, by thread.
_CHAINS: dict[int, list[str]] = {}


def begin_chain() -> None:
    """From now on this thread remembers what it stores, for forget()."""
    _CHAINS[threading.get_ident()] = []


def end_chain() -> None:
    """What this thread has stored stays."""
    _CHAINS.pop(threading.get_ident(), None)


def forget(keep: DataFrame) -> None:
    """In a chain, delete what has been stored since its beginning, but for the tables that ``keep`` reads.

    A step calls this when the step before it has been written: what that one had stored is no longer needed.
    Outside of a chain nothing is deleted.
    """
    spark, files, left = keep.sparkSession, keep.inputFiles(), []
    for path in _CHAINS.get(threading.get_ident(), []):
        if any(path.split("://")[-1].lstrip("/") in f for f in files):
            left.append(path)
        else:
            _delete(spark, path)
    if threading.get_ident() in _CHAINS:
        _CHAINS[threading.get_ident()] = left


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def delete(table: DataFrame) -> None:
    """Delete what stored() has written for ``table``, which nothing will read any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        _delete(table.sparkSession, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage like ``checkpoint()`` does, in compressed columns, and survives the
    loss of executors.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if threading.get_ident() in _CHAINS:
        _CHAINS[threading.get_ident()].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str, pos: str = "pos") -> DataFrame:
    """Store ``df`` in the order of ``order`` and add the 0-based global row number ``pos``.

    Rows are dealt by ranges of ``order``, so no task sees all rows; give a unique last column
    and even one hot value spreads over tasks. Inside a partition the number comes from
    ``monotonically_increasing_id``; the offsets between partitions come from one count per
    partition, a table with as many rows as there are partitions.
    """
    placed = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()), name
    )
    part = F.shiftright("_mid", 33)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"))
    )
    # One row per partition: at most the number of shuffle partitions.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(pos, F.col("_offset") + F.col("_mid").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_offset", "_mid")
    )
