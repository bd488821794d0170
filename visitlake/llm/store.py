"""Intermediate tables in the folder all executors share."""
from __future__ import annotations

import gc
import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def work_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where that is unset (tests, one machine)."""
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_CONF} is unset: executors need a folder they all see")
        folder = "file://" + tempfile.mkdtemp(prefix="visitlake-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/visitlake-{name}-{uuid.uuid4().hex}"


#: rows that Python workers get at a time while a table is written: whole texts are long, and two workers share an executor's memory
BATCH_ROWS = 1_000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: after so many written tables the driver clears what finished steps left with it
CLEAR_EVERY = 6
_written = count(1)


def clear_driver(spark: SparkSession) -> None:
    """Let the driver collect plans, task records and blocks of finished steps, and Spark's cleaner drop their shuffles.

    A method of many short jobs leaves little that lives on, but left to itself the driver's heap grows to its limit before it is cleared.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def write_table(df: DataFrame, path: str, batch_rows: int = BATCH_ROWS) -> None:
    """Write `df` as Parquet, its Python parts in batches of `batch_rows`; the session's own setting is put back."""
    conf = df.sparkSession.conf
    usual = conf.get(_BATCH_CONF)
    conf.set(_BATCH_CONF, str(batch_rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_BATCH_CONF, usual)


def materialise(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write `df` once as Parquet into the shared folder and return the table read back.

    The plan above starts from files that outlive any executor, and what made them runs once however often it is read.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    write_table(df, path, batch_rows)
    if next(_written) % CLEAR_EVERY == 0:
        clear_driver(spark)
    return spark.read.schema(df.schema).parquet(path)
