"""Frames written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session that names none gets a temporary one."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share (master {master})")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tilewright-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written and read again: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/tilewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables() -> int:
    """How many tables are written and not released: a mark for release()."""
    return len(_tables)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables written after a mark; frames that read them are void."""
    jvm = spark.sparkContext._jvm
    for path in _tables[since:]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    del _tables[since:]
