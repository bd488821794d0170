"""One server, first come first served, per session: waits, overtime, idle time, and comparisons of booking policies."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import mean_ci, paired_diff
from .running import run_max, run_sum, running
from .selection import every_kth, positional_join

REPORTED = ("served", "mean_wait", "overtime", "idle", "both_attend")


def queue_timeline(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add start, end and wait to rows(keys, order, arrival, service, attends); absent patients take no time and get NULL.

    start_i = max(arrival_i, end_{i-1}) unrolls to end_i = S_i + max over j <= i of (arrival_j - S_{j-1}), with S the running
    service time: a running sum and a running maximum, so a session of any size is split like any other running value.
    """
    used = rows.withColumn("__used", F.when(F.col("attends"), F.col("service")).otherwise(0.0))
    summed = running(used, keys, order, {"__s": run_sum(F.col("__used"))})
    slack = F.when(F.col("attends"), F.col("arrival") - (F.col("__s") - F.col("__used")))
    topped = running(summed.withColumn("__slack", slack), keys, order, {"__m": run_max(F.col("__slack"))})
    end = F.when(F.col("attends"), F.col("__s") + F.col("__m"))
    out = topped.withColumn("end", end).withColumn("start", F.col("end") - F.col("__used"))
    return out.withColumn("wait", F.col("start") - F.col("arrival")).drop("__used", "__s", "__slack", "__m")


def queue_metrics(timeline: DataFrame, keys: Sequence[str], session_minutes: float, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """served, mean_wait (NULL if nobody attended), overtime past the session and idle minutes inside it."""
    t = F.lit(float(session_minutes))
    busy = F.greatest(F.lit(0.0), F.least(F.col("end"), t) - F.least(F.col("start"), t))
    return timeline.groupBy(*keys).agg(
        F.count_if("attends").alias("served"), F.avg("wait").alias("mean_wait"),
        F.greatest(F.lit(0.0), F.coalesce(F.max("end"), F.lit(0.0)) - t).alias("overtime"),
        (t - F.coalesce(F.sum(F.when(F.col("attends"), busy)), F.lit(0.0))).alias("idle"),
        *[c.alias(name) for name, c in (extra or {}).items()])


def policy_queue(slots: DataFrame, extras: DataFrame, keys: Sequence[str], policies: Mapping[str, DataFrame], session_minutes: float) -> DataFrame:
    """Session metrics per policy. slots and extras: (keys, seq, arrival, service, attends); policies: name -> chosen slots.

    A chosen slot gets the next extra patient of its session, who queues right behind the slot's own patient.
    """
    keys = list(keys)
    columns = [*keys, "seq", "half", "arrival", "service", "attends", "doubled", "both"]
    parts = []
    for name, chosen in policies.items():
        own = slots.select(*keys, "seq", F.lit(0).alias("half"), "arrival", "service", "attends", F.lit(0).alias("doubled"), F.lit(0).alias("both"))
        paired = positional_join(chosen.select(*slots.columns), extras, keys, ["seq"], ["seq"]).select(
            *keys, "seq", F.lit(1).alias("half"), "arrival", F.col("extra_service").alias("service"), F.col("extra_attends").alias("attends"),
            F.lit(1).alias("doubled"), (F.col("attends") & F.col("extra_attends")).cast("int").alias("both"))
        parts.append(own.select(*columns).unionByName(paired.select(*columns)).withColumn("policy", F.lit(name)))
    rows = reduce(DataFrame.unionByName, parts)
    timeline = queue_timeline(rows, ["policy", *keys], ["seq", "half"])
    return queue_metrics(timeline, ["policy", *keys], session_minutes, {
        "double_slots": F.sum("doubled"), "both_slots": F.sum("both"), "both_attend": F.max("both").cast("double")})


def standard_policies(slots: DataFrame, keys: Sequence[str], risk: str, every: Sequence[int], thresholds: Mapping[str, Column]) -> dict[str, DataFrame]:
    """P0 chooses nothing, P1 every k-th slot, P2 the slots whose risk reaches a threshold."""
    out = {"P0": slots.where(F.lit(False))}
    out |= {f"P1 k={k}": every_kth(slots, keys, ["seq"], k) for k in every}
    out |= {f"P2 {label}": slots.where(F.col(risk) >= level) for label, level in thresholds.items()}
    return out


def _long(metrics: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return metrics.select("policy", *keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["policy", *keys], list(names), "metric", "value")


def policy_summary(metrics: DataFrame, keys: Sequence[str], names: Sequence[str] = REPORTED) -> DataFrame:
    """Mean and interval of each metric per policy, mean double slots, and the share of double slots where both attended."""
    per = metrics.groupBy("policy").agg(F.avg("double_slots").alias("double_slots_mean"),
                                        F.try_divide(F.sum("both_slots").cast("double"), F.sum("double_slots")).alias("share_both"))
    return mean_ci(_long(metrics, keys, names), ["policy", "metric"], "value").join(F.broadcast(per), "policy")  # a row per policy


def policy_paired(metrics: DataFrame, keys: Sequence[str], reference: str, names: Sequence[str] = REPORTED) -> DataFrame:
    """Paired difference to the reference policy, session by session."""
    long = _long(metrics, keys, names)
    base, others = long.where(F.col("policy") == reference), long.where(F.col("policy") != reference)
    return paired_diff(others, base, [*keys, "metric"], ["policy", "metric"], "value")
