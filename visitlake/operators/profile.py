"""Rates with Wilson intervals, cross tables and long profiles."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .running import exact_percentiles


def with_rate(counts: DataFrame, hits: str = "no_show_n", n: str = "n") -> DataFrame:
    """Add rate, ci_low and ci_high to a table of counts."""
    k, total = F.col(hits), F.col(n)
    return counts.withColumns({"rate": C.ratio(k, total), "ci_low": C.wilson_low(k, total), "ci_high": C.wilson_high(k, total)})


def wilson_rates(df: DataFrame, keys: Sequence[str], outcome: str = "no_show") -> DataFrame:
    """n, no-shows, rate and 95% interval per group."""
    return with_rate(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("long")).alias("no_show_n")))


def banded(visits: DataFrame) -> DataFrame:
    return visits.select(C.right_closed_band(F.col("lead_days"), C.LEAD_BANDS).alias("lead_time_band"),
                         C.weekday_label(F.col("appt_weekday")).alias("weekday"),
                         C.right_closed_band(F.col("age"), C.AGE_BANDS).alias("age_band"), "no_show")


def rates_by_variable(visits: DataFrame, variables: Sequence[str], outcome: str = "no_show") -> DataFrame:
    """Rates for each variable on its own plus overall, from one pass with grouping sets. Unbanded rows are left out of a variable."""
    sets = [[F.col(v)] for v in variables] + [[]]
    counts = visits.groupingSets(sets, *variables).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("long")).alias("no_show_n"))
    everything = 2 ** len(variables) - 1
    variable, group = F.lit("overall"), F.lit("all rows")
    for i, v in enumerate(variables):
        gid = everything - 2 ** (len(variables) - 1 - i)
        variable = F.when(F.col("gid") == gid, v).otherwise(variable)
        group = F.when(F.col("gid") == gid, F.col(v)).otherwise(group)
    named = counts.select(variable.alias("variable"), group.alias("group"), "n", "no_show_n").where(F.col("group").isNotNull())
    return with_rate(named)


def band_crosstab(visits: DataFrame, band: Column, flag: str, outcome: str = "no_show") -> DataFrame:
    """Rate by band and a 0/1 flag, the share of the band with the flag, and rate(flag=1) - rate(flag=0)."""
    counts = (visits.select(band.alias("band"), F.col(flag).alias("flag"), F.col(outcome).cast("long").alias("y")).where(F.col("band").isNotNull())
              .groupBy("band", "flag").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("no_show_n")))
    per_band = Window.partitionBy("band")  # two rows per band
    rated = with_rate(counts)
    one = F.max(F.when(F.col("flag") == 1, F.col("rate"))).over(per_band)
    zero = F.max(F.when(F.col("flag") == 0, F.col("rate"))).over(per_band)
    share = C.ratio(F.sum(F.when(F.col("flag") == 1, F.col("n")).otherwise(0)).over(per_band), F.sum("n").over(per_band))
    return rated.withColumns({"share_of_band": share, "rate_difference": one - zero})


def long_profile(visits: DataFrame, dataset: str) -> DataFrame:
    """(dataset, metric, value) with the value as text, from one aggregation plus exact percentiles of the lead time."""
    n = F.count(F.lit(1))
    one = visits.agg(
        n.alias("rows_clean"), F.sum(F.col("no_show").cast("long")).alias("no_show_n"), F.avg("no_show").alias("no_show_rate"),
        F.countDistinct("patient_id").alias("unique_patients"),
        F.min("appointment_date").alias("appointment_date_min"), F.max("appointment_date").alias("appointment_date_max"),
        F.countDistinct("appointment_date").alias("n_appointment_dates"),
        F.avg((F.col("lead_days") == 0).cast("int")).alias("share_same_day"), F.avg("sms_received").alias("share_sms_received"),
        F.avg((F.col("sex") == "F").cast("int")).alias("share_female"), F.avg("age").alias("age_mean"))
    lead = exact_percentiles(visits, "lead_days", {"lead_days_median": 0.5, "lead_days_p95": 0.95})
    age = exact_percentiles(visits, "age", {"age_median": 0.5})
    wide = one.crossJoin(F.broadcast(lead)).crossJoin(F.broadcast(age))  # single rows
    wide = wide.withColumn("mean_per_patient", C.ratio(F.col("rows_clean"), F.col("unique_patients")))
    texts = []
    for name, kind in wide.dtypes:
        text = C.fixed(F.col(name), 4) if kind == "double" else F.col(name).cast("string")
        texts.append(F.struct(F.lit(dataset).alias("dataset"), F.lit(name).alias("metric"), text.alias("value")))
    return wide.select(F.inline(F.array(*texts)))


def mean_vs_prevalence(scored: DataFrame, models: Mapping[str, str], outcome: str = "y") -> DataFrame:
    """Mean predicted probability against prevalence, per score column."""
    one = scored.agg(F.avg(outcome).alias("prevalence"), *[F.avg(c).alias(f"m_{name}") for name, c in models.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("model"), F.col(f"m_{name}").alias("mean_predicted"), F.col("prevalence").alias("prevalence")) for name in models])
    return one.select(F.inline(rows))


def lognormal_fit(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Maximum-likelihood lognormal: mu and sigma of ln x, log-likelihood, AIC, fitted mean."""
    x = F.ln(F.col(value))
    m = df.where(F.col(value) > 0).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma"), F.avg(value).alias("mean_data"))
    n, s = F.col("n"), F.col("sigma")
    # sum of squared deviations is n sigma^2, so the density sum closes to this
    ll = -n * (F.ln(s) + F.lit(0.9189385332046727) + 0.5) - n * F.col("mu")
    return m.select(*by, "n", "mu", "sigma", ll.alias("log_likelihood"), (4 - 2 * ll).alias("aic"),
                    F.exp(F.col("mu") + s * s / 2).alias("mean_fitted"), "mean_data")


def default_slot_minutes(df: DataFrame, value: str) -> DataFrame:
    """The median rounded up to the next five minutes."""
    return exact_percentiles(df, value, {"median": 0.5}).select("median", C.ceil_to(F.col("median"), 5.0).alias("slot_minutes"))


def mean_ci(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean with a 95% t interval, missing values ignored; the interval is the mean itself for one value or no spread."""
    m = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("__sd"))
    half = C.t_975(F.col("n") - 1) * F.col("__sd") / F.sqrt(F.col("n").cast("double"))
    half = F.when((F.col("n") < 2) | (F.col("__sd") == 0), F.lit(0.0)).otherwise(half)
    return m.select(*keys, "n", "mean", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def paired_diff(a: DataFrame, b: DataFrame, unit: Sequence[str], keys: Sequence[str], value: str) -> DataFrame:
    """Mean of a - b over units with a 95% interval; a pair with a missing side is dropped.

    Rows pair on the `unit` columns; `keys` are columns of `a` (or of the unit) to report by.
    """
    left = a.select(*dict.fromkeys([*unit, *keys]), F.col(value).alias("__a"))
    right = b.select(*unit, F.col(value).alias("__b"))
    diff = left.join(right, list(unit)).where(F.col("__a").isNotNull() & F.col("__b").isNotNull()).withColumn("diff", F.col("__a") - F.col("__b"))
    return mean_ci(diff, keys, "diff")
