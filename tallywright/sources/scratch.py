"""Cutting long plans where several steps read one result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The checkpoint folder of the session, set from ``spark.checkpoint.dir`` if it is not yet."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallywright-"))
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder: for boxes, of which columns are read apart and which compress well.

    It is worked out once, where a checkpoint works it out twice, and its size is known. It stays until the folder is cleaned.
    """
    path = f"{_folder(df)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint, so that what reads it several times does not work it out again.

    The files lie in the folder that the session names in ``spark.checkpoint.dir``, where they outlive executors; a
    session without one (a local test) gets a temporary folder. Spark's cleaner removes them once nothing refers to them,
    if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    _folder(df)
    return df.checkpoint()
