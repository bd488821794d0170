"""Result tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write as many files as the plan has partitions; Spark commits the folder as a whole."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
