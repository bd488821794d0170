"""Seeded synthetic appointments of any size, made by column expressions on a range: for scale tests only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

POINTS = 65  # quantiles kept of a distribution without a closed inverse


def beta_quantiles(a: float, b: float, points: int = POINTS, steps: int = 20_000) -> list[float]:
    """Quantiles of a beta distribution at 0, 1/(points-1), ..., 1 by the midpoint rule."""
    cells = [((i + 0.5) / steps) ** (a - 1) * (1 - (i + 0.5) / steps) ** (b - 1) for i in range(steps)]
    total, out, reached = sum(cells), [], 0.0
    for i, cell in enumerate(cells):
        while len(out) < points - 1 and reached / total >= len(out) / (points - 1):
            out.append(i / steps)
        reached += cell
    return out + [1.0] * (points - len(out))


def from_quantiles(u: Column, quantiles: list[float]) -> Column:
    """The value of a uniform under interpolated quantiles."""
    table = F.array(*[F.lit(q) for q in quantiles])
    spot = u * (len(quantiles) - 1)
    cell = F.least(F.floor(spot), F.lit(len(quantiles) - 2)).cast("int")
    low, high = F.element_at(table, cell + 1), F.element_at(table, cell + 2)
    return low + (high - low) * (spot - cell)


def uniform(seed: int, *parts: Column) -> Column:
    """A uniform in [0, 1) that depends on the row's own numbers, so a recomputed task makes the same rows."""
    return C.mix(seed, *parts) / F.lit(2147483647.0)


def synthetic_visits(spark: SparkSession, n_patients: int, n_visits: int, seed: int = 42, first_day: str = "2030-01-01", days: int = 30,
                     hot_share: float = 0.0) -> DataFrame:
    """Clean visits with a per-patient propensity, exponential lead times and cancellations; patient 0 may get a share of all rows."""
    propensity, row = beta_quantiles(1.2, 5.0), F.col("id")
    patient = F.when(uniform(seed + 1, row) < hot_share, F.lit(0).cast("long")).otherwise((uniform(seed + 2, row) * n_patients).cast("long"))
    rows = spark.range(n_visits).select(row.alias("appointment_id"), patient.alias("patient_id"))
    row, patient = F.col("appointment_id"), F.col("patient_id")
    lead = F.least(F.lit(30), F.floor(-F.ln(1 - uniform(seed + 3, row)) * 7)).cast("int")
    chance = F.least(F.lit(0.6), from_quantiles(uniform(seed + 5, patient), propensity))
    return (rows.withColumn("appointment_date", F.date_add(F.lit(first_day).cast("date"), (uniform(seed + 4, row) * days).cast("int")))
            .withColumn("lead_days", lead).withColumn("scheduled_at", F.date_sub("appointment_date", F.col("lead_days")).cast("timestamp_ntz"))
            .withColumn("appt_weekday", C.weekday(F.col("appointment_date")))
            .withColumn("sex", F.when(uniform(seed + 6, patient) < 0.55, "F").otherwise("M"))
            .withColumn("age", (uniform(seed + 7, patient) * 95).cast("int"))
            .withColumn("no_show", (uniform(seed + 8, row) < chance).cast("int"))
            .withColumn("cancelled", (uniform(seed + 9, row) < 0.12).cast("int")))
