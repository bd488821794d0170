"""The session settings the operators are written for."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "visitlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and NULL-safe ANSI behaviour; `conf` overrides single settings.

    On a cluster `master` is left to spark-submit and the shuffle width to AQE coalescing: start wide, let Spark merge.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master and master.startswith("local"):
        settings |= {
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("VISITLAKE_DRIVER_MEMORY", "8g"),
            "spark.sql.shuffle.partitions": "8",
        }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session



def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder that spark.checkpoint.dir names, and read back: lineage ends there.

    Only where that is unset, as on one machine, a local folder is taken.
    """
    spark = df.sparkSession
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_CONF} is unset: executors need a folder they all see")
        folder = "file://" + tempfile.mkdtemp(prefix="visitlake-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    path = f"{folder.rstrip('/')}/visitlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
