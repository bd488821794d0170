"""Choosing rows of a group by position or score, and pairing chosen rows with extra ones."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .running import _null_safe_left, between_ranks, positions, rank_neighbours

# fixed values: the policy grids
EVERY_K = (2, 3, 4, 6)
FIXED_THRESHOLDS = (0.3, 0.5)
PERCENTILES = (50, 70, 80, 90, 95)
SHIFTS = (-0.10, -0.05, 0.0, 0.05, 0.10)
SCALES = (0.5, 1.0, 1.5)


def every_kth(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The k-th, 2k-th, ... row of each group."""
    return positions(df, keys, order).where(F.col("position") % k == 0)


def top_m(df: DataFrame, keys: Sequence[str], by: Sequence[Column], m: int) -> DataFrame:
    """The first m rows of each group. The constant limit is applied before the shuffle too, so a huge group sends few rows."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= m)


def top_m_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], m: str) -> DataFrame:
    """The first m rows of each group in ascending `order`, with m taken from a column."""
    return positions(df, keys, order, "place").where(F.col("place") <= F.col(m))


def group_sizes(df: DataFrame, keys: Sequence[str], name: str = "n_group") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def evenly_spaced(df: DataFrame, keys: Sequence[str], order: Sequence[str], m: Column) -> DataFrame:
    """m rows of each group of n at 0-based positions floor((j + 0.5) n / m), j = 0..m-1.

    Each row decides for itself whether some j points at it, so nothing is exploded or joined per j.
    """
    numbered = _null_safe_left(positions(df, keys, order), group_sizes(df, keys), list(keys))
    n, at, count = F.col("n_group").cast("double"), F.col("position") - 1, m.cast("double")
    guess = F.ceil(F.try_divide(at * count, n) - 0.5)

    def hits(j: Column) -> Column:
        return (j >= 0) & (j < count) & (F.floor((j + 0.5) * n / count) == at)

    return numbered.where((count > 0) & (hits(guess) | hits(guess - 1) | hits(guess + 1))).drop("n_group")


def positional_join(chosen: DataFrame, extras: DataFrame, keys: Sequence[str], order: Sequence[str], extra_order: Sequence[str]) -> DataFrame:
    """The j-th chosen row of a group with its j-th extra row; extra columns carry the prefix extra_."""
    left = positions(chosen, keys, order, "j")
    right = positions(extras, keys, extra_order, "j")
    right = right.select(*keys, "j", *[F.col(c).alias(f"extra_{c}") for c in extras.columns if c not in set(keys)])
    return left.join(right, [*keys, "j"])


def percentile_name(q: int) -> str:
    return f"p{q}"


def score_whatif(df: DataFrame, score: str, shifts: Sequence[float] = SHIFTS, scales: Sequence[float] = SCALES,
                 fixed: Sequence[float] = FIXED_THRESHOLDS, percentiles: Sequence[int] = PERCENTILES) -> DataFrame:
    """How many rows reach each threshold when every score is shifted or scaled (clipped to [0, 1]).

    Shifted scores meet the thresholds of the unshifted distribution; scaled ones meet percentiles of the scaled distribution. Scaling
    keeps the order, so those percentiles come from the same two neighbouring ranks. Settings are conditional counts in one
    pass over the distinct scores; rows are not multiplied by the grid.
    """
    names = {percentile_name(q): q / 100 for q in percentiles}
    ranks = rank_neighbours(df, score, names)
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    wide = counts.crossJoin(F.broadcast(ranks))  # one row
    settings = [("shift", a, lambda c, a=a: C.clip(c + a, 0.0, 1.0), lambda c: c) for a in shifts]
    settings += [("scale", a, lambda c, a=a: C.clip(c * a, 0.0, 1.0), lambda c, a=a: C.clip(c * a, 0.0, 1.0)) for a in scales]
    aggs, rows = [], []
    for i, (kind, amount, seen, pool) in enumerate(settings):
        levels = [(f"{t:g}", F.lit(float(t))) for t in fixed] + [(name, between_ranks(name, pool)) for name in names]
        for j, (label, level) in enumerate(levels):
            tag = f"{i}_{j}"
            aggs += [F.max(level).alias(f"t{tag}"), F.sum(F.when(seen(F.col("s")) >= level, F.col("n")).otherwise(0)).alias(f"f{tag}")]
            rows.append(F.struct(F.lit(kind).alias("kind"), F.lit(float(amount)).alias("amount"), F.lit(label).alias("threshold_label"),
                                 F.col(f"t{tag}").alias("threshold"), F.col(f"f{tag}").alias("flagged_n")))
    one = wide.agg(F.sum("n").alias("n"), *aggs)
    return one.select("n", F.inline(F.array(*rows))).withColumn("share_flagged", C.ratio(F.col("flagged_n"), F.col("n")))
