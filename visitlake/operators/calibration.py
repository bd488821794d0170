"""Reliability tables and expected calibration error."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .running import exact_percentiles


def _rows(binned: DataFrame) -> DataFrame:
    counts = binned.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"),
                                     F.sum(F.col("y").cast("long")).alias("k"))
    numbered = counts.withColumn("bin", F.row_number().over(Window.orderBy("b")))  # one row per bin
    k, n = F.col("k"), F.col("n")
    return numbered.select("bin", "n", "mean_predicted", C.ratio(k, n).alias("observed_rate"),
                           C.wilson_low(k, n).alias("ci_low"), C.wilson_high(k, n).alias("ci_high"))


def equal_width_bin(p: Column, bins: int) -> Column:
    """floor(p * bins), the last bin closed at 1."""
    return F.least(F.floor(p * bins), F.lit(bins - 1))


def reliability_bins(df: DataFrame, y: str, p: str, bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """One row per non-empty bin: n, mean prediction, observed rate and its Wilson interval.

    Quantile edges come from exact percentiles (counted, not collected); repeated edges merge, and an edge belongs to the bin above it.
    """
    rows = df.select(F.col(y).alias("y"), F.col(p).cast("double").alias("p")).where(F.col("p").isNotNull())
    if strategy == "uniform":
        return _rows(rows.withColumn("b", equal_width_bin(F.col("p"), bins)))
    cuts = exact_percentiles(rows, "p", {f"q{i}": i / bins for i in range(bins + 1)})
    edges = cuts.select(F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(bins + 1)])).alias("edges"))
    placed = rows.crossJoin(F.broadcast(edges))  # a single row of at most bins + 1 numbers
    at = F.size(F.filter("edges", lambda e: e <= F.col("p"))) - 1
    last = F.size("edges") - 2
    return _rows(placed.withColumn("b", F.greatest(F.lit(0), F.least(at, last))))


def expected_calibration_error(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Share-weighted mean of |observed - predicted| over equal-width bins."""
    t = reliability_bins(df, y, p, bins)
    gap = F.abs(F.col("observed_rate") - F.col("mean_predicted"))
    return t.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))
