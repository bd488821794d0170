"""Time holdouts and folds."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .running import _null_safe_left, positions


def holdout_cut(df: DataFrame, date: str, fraction: float = 0.2) -> DataFrame:
    """One row: the first holdout date. The latest round(fraction * dates) dates are held out, at least 1, never all."""
    dates = df.select(F.col(date).alias("d")).distinct()  # one row per calendar day
    ranked = dates.select("d", F.row_number().over(Window.orderBy(F.desc("d"))).alias("back"))
    n = dates.agg(F.count(F.lit(1)).alias("n"))
    keep = F.least(F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(fraction), 0).cast("int")), F.col("n") - 1)
    return ranked.crossJoin(F.broadcast(n)).where(F.col("back") == keep).select(F.col("d").alias("cut"))


def holdout_by_date(df: DataFrame, date: str = "appointment_date", fraction: float = 0.2) -> DataFrame:
    """Add part: train before the cut date, holdout from it on. Dates are never split."""
    cut = holdout_cut(df, date, fraction).scalar()
    return df.withColumn("part", F.when(F.col(date) >= cut, "holdout").otherwise("train"))


def holdout_last_month(df: DataFrame, month: str) -> DataFrame:
    """Add part: the last month is the holdout."""
    last = df.agg(F.max(month)).scalar()
    return df.withColumn("part", F.when(F.col(month) == last, "holdout").otherwise("train"))


def grouped_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Add a fold per whole group: groups in a seeded shuffled order, dealt out in turn, so fold sizes differ by at most 1 group. NULL is a group.

    Only the distinct ids are ranked (in ordered ranges when there are many), then the fold joins back on the id.
    """
    ids = df.select(group).distinct()
    shuffled = ids.withColumn("__h", C.mix(seed, F.col(group) % 2147483647))
    dealt = positions(shuffled, [], ["__h", group], "__r").select(group, ((F.col("__r") - 1) % k).cast("int").alias(name))
    return _null_safe_left(df, dealt, [group])


def stratified_folds(df: DataFrame, label: str, row_id: Sequence[str], k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Add folds that keep the label rate: within each label, rows in a seeded order are dealt out in turn.

    `row_id` columns are whole numbers that identify a row.
    """
    h = C.mix(seed, *[F.col(c) % 2147483647 for c in row_id])
    dealt = positions(df.withColumn("__h", h), [label], ["__h", *row_id], "__r")
    return dealt.withColumn(name, ((F.col("__r") - 1) % k).cast("int")).drop("__h", "__r")


def split_profile(df: DataFrame, part: str, outcome: str = "no_show", total: bool = True) -> DataFrame:
    """Rows, share and rate per part or fold."""
    m = df.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("long")).alias("no_show_n"))
    all_rows = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row per part
    return m.select(part, "n", C.ratio(F.col("n"), all_rows).alias("share"), C.ratio(F.col("no_show_n"), F.col("n")).alias("rate"))


def fold_audit(df: DataFrame, fold: str, group: str) -> DataFrame:
    """Per fold: groups inside it and groups on both sides of it (must be 0)."""
    pairs = df.select(fold, group).distinct()
    spread = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("__folds"))
    return (_null_safe_left(pairs, spread, [group]).groupBy(fold)
            .agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("__folds") > 1).alias("n_both_sides")))


def shared_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids present on both sides."""
    return a.select(key).intersect(b.select(key))


def shuffled_labels(df: DataFrame, label: str, row_id: str, seed: int = 42) -> DataFrame:
    """The same rows with their labels permuted: row i in one seeded order gets the label of row i in another."""
    a = positions(df.withColumn("__h", C.mix(seed, F.col(row_id) % 2147483647)), [], ["__h", row_id], "__i").drop("__h", label)
    b = positions(df.select(row_id, label).withColumn("__h", C.mix(seed + 1, F.col(row_id) % 2147483647)), [], ["__h", row_id], "__i")
    return a.join(b.select("__i", label), "__i").drop("__i")
