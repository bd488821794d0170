"""Replace-by-key, lineage entries and combined reports."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored


def upsert_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`new` replaces the rows of `old` that have its keys; columns missing on one side become NULL."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Write a table in folders by the hash of its keys, one file or a few each."""
    rows = df.withColumn("bucket", _bucket(keys, buckets))
    rows.repartition(buckets, "bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)


def replace_in_buckets(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], buckets: int) -> None:
    """`new` replaces the rows of the table at `path` (from `create_buckets`) that have its keys; only buckets with such keys are rewritten.

    The rows to write are put into a table of their own first, so a bucket is never read while it is replaced, and a repeated call
    writes the same rows again. A NULL key is a key like any other. `new` has the table's columns.
    """
    table = spark.read.parquet(path)
    names = [c for c in table.columns if c != "bucket"]
    fresh = stored(new.select(*names).withColumn("bucket", _bucket(keys, buckets)), "new-rows")
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return
    renamed = fresh.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    kept = table.where(F.col("bucket").isin(touched)).join(renamed, same, "left_anti")
    ready = stored(kept.select(*names, "bucket").unionByName(fresh.select(*names, "bucket")), "buckets")
    ready.repartition(len(touched), "bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def merge_versions(df: DataFrame, keys: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """The newest row per key of a table that holds several, by partial aggregation."""
    packed = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(packed, F.struct(*version)).alias("r")).select("r.*")


def union_reports(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Concatenate report tables with differing columns."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def lineage_entry(result: str, script: str, seed: int, inputs: DataFrame) -> DataFrame:
    """One lineage row per input file of a result, from fingerprints (path, sha256); fails when a fingerprint is missing."""
    checked = F.when(F.col("sha256").isNotNull(), F.col("sha256")).otherwise(F.raise_error(F.lit("input without fingerprint")).cast("string"))
    return inputs.select(F.lit(result).alias("result"), F.lit(script).alias("script"), F.lit(seed).alias("seed"), "path", checked.alias("sha256"))


def record_result(lineage: DataFrame, entry: DataFrame) -> DataFrame:
    """The lineage table with only this result's rows replaced."""
    return upsert_by_key(lineage, entry, ["result"])
