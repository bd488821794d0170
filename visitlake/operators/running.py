"""Running totals, positions and order statistics that survive one huge group.

A plain window sorts each key in one task. That is right while every key is small, and it stops working when one key
holds a third of the rows. `running` measures first, by one counting job with partial aggregation. With no large key the plan
is the plain window. Otherwise the rows of all large keys are range-partitioned on (keys, order): Spark samples its bounds from those
very rows, so a key gets as many ranges as its size asks for, wherever its values lie, and any number of keys can be large. Each
range is a window of its own and starts from the totals of the ranges before it. No row is dropped and no pair of rows is ever built.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

HOT_ROWS_CONF = "spark.visitlake.hotGroupRows"
DEFAULT_HOT_ROWS = 2_000_000


@dataclass(frozen=True)
class Run:
    """One running value: kind is sum, max or min, over the rows up to (or strictly before) the current one."""

    kind: str
    column: Column
    before: bool = False


def run_sum(column: Column, before: bool = False) -> Run:
    return Run("sum", column, before)


def run_max(column: Column, before: bool = False) -> Run:
    return Run("max", column, before)


def run_min(column: Column, before: bool = False) -> Run:
    return Run("min", column, before)


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, left: Column, right: Column) -> Column:
    if kind == "sum":
        return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(left + right)
    return F.greatest(left, right) if kind == "max" else F.least(left, right)


def hot_rows(df: DataFrame) -> int:
    """Rows one sorted group may hold before it is cut; set HOT_ROWS_CONF to the size one task sorts comfortably."""
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def large_keys(df: DataFrame, keys: Sequence[str], limit_rows: int) -> DataFrame:
    """The keys with more than `limit_rows` rows and their n_rows; at most a `limit_rows`-th as many as there are rows."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where(F.col("n_rows") > limit_rows)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], runs: Mapping[str, Run]) -> DataFrame:
    """Add running values per `keys` in the ascending order of the `order` columns.

    `order` should be unique within a key (aggregate ties first, or end with an id): then a large key always splits evenly. For a
    descending order pass the negated column. NULL is a key like any other.
    """
    keys, order = list(keys), list(order)
    limit_rows = hot_rows(df)
    large = large_keys(df, keys, limit_rows)
    hot_total = large.agg(F.sum("n_rows")).first()[0]
    inner = Window.partitionBy(*keys).orderBy(*order)
    if not hot_total:
        return df.select("*", *[_local(run, inner).alias(name) for name, run in runs.items()])

    marked = _null_safe_left(df, large.select(*keys, F.lit(True).alias("__hot")), keys) if keys else df.withColumn("__hot", F.lit(True))
    # the bounds are drawn once: what follows reads the ranges from a written table, also when a task is repeated
    ranges = -(-2 * hot_total // limit_rows)
    cut = stored(marked.where("__hot").drop("__hot").repartitionByRange(ranges, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = cut.groupBy(*keys, "__range").agg(*[_AGG[r.kind](r.column).alias(f"__t_{n}") for n, r in runs.items()])
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__range", *[_AGG[r.kind](f"__t_{n}").over(earlier).alias(f"__off_{n}") for n, r in runs.items()])
    joined = _null_safe_left(cut, offsets, [*keys, "__range"])
    local = Window.partitionBy(*keys, "__range").orderBy(*order)
    columns = [F.col(c) for c in df.columns]
    hot = joined.select(*columns, *[_combine(r.kind, F.col(f"__off_{n}"), _local(r, local)).alias(n) for n, r in runs.items()])
    if not keys:
        return hot
    cold = marked.where(F.col("__hot").isNull()).select(*columns, *[_local(run, inner).alias(name) for name, run in runs.items()])
    return hot.unionByName(cold)


def _local(run: Run, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, -1 if run.before else Window.currentRow)
    return _AGG[run.kind](run.column).over(frame)


def _null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe equality, keeping the left key columns only."""
    renamed = right.select(*[F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__k_{key}"))
    return left.join(renamed, condition, "left").drop(*[f"__k_{k}" for k in keys])


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Number the rows of each key from 1 in the given (unique) order."""
    return running(df, keys, order, {name: run_sum(F.lit(1).cast("long"))})


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
             prefix: str = "previous_") -> DataFrame:
    """The values of the row just before each row, NULL for the first: a lag that survives one huge key."""
    packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                      *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    out = running(df, keys, order, {"__prev": run_max(packed, before=True)})
    return out.select(*df.columns, *[F.col(f"__prev.v{i}").alias(prefix + v) for i, v in enumerate(values)])


def rank_neighbours(df: DataFrame, value: str, fractions: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """For each named fraction the two values around its rank: lo_<name>, hi_<name> and the weight w_<name> of the upper one.

    Equal values are counted first; running counts over the distinct values then locate the ranks, so no task holds the values.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(counts, by, [value], {"__upto": run_sum(F.col("__n"))})
    sizes = counts.groupBy(*by).agg(F.sum("__n").alias("__size"))
    # without a key the right side is a single row; with keys AQE picks the side to send
    sized = ranked.crossJoin(F.broadcast(sizes)) if not by else _null_safe_left(ranked, sizes, by)
    size, picks = F.col("__size"), []
    for name, q in fractions.items():
        rank = F.lit(float(q)) * (size - 1)
        picks += [F.min(F.when(F.col("__upto") > F.floor(rank), F.col(value))).alias(f"lo_{name}"),
                  F.min(F.when(F.col("__upto") > F.ceil(rank), F.col(value))).alias(f"hi_{name}"),
                  F.max(rank - F.floor(rank)).alias(f"w_{name}")]
    return sized.groupBy(*by).agg(*picks)


def between_ranks(name: str, monotone: Callable[[Column], Column] = lambda c: c) -> Column:
    """The interpolated percentile of monotone(value), from the columns of `rank_neighbours`."""
    low, high = monotone(F.col(f"lo_{name}")), monotone(F.col(f"hi_{name}"))
    return low + (high - low) * F.col(f"w_{name}")


def exact_percentiles(df: DataFrame, value: str, fractions: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Percentiles by linear interpolation, one row per `by` key."""
    found = rank_neighbours(df, value, fractions, by)
    return found.select(*by, *[between_ranks(name).alias(name) for name in fractions])
