"""Logged cleaning: every rule is one flag column, the whole log is one aggregation, the clean table is one filter."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

# fixed values: limits, and the rule names and kinds written to the log
MAX_AGE = 110
MAX_SERVICE_SECONDS = 4 * 3600
CLINIC_HOURS = (7, 21)


@dataclass(frozen=True)
class Rule:
    """A named condition; kind "drop" removes the rows it holds for, "report" only counts them.

    NULL counts as "does not hold", unless the rule says otherwise itself.
    """

    name: str
    holds: Column
    kind: str = "drop"

    @property
    def flag(self) -> Column:
        return F.coalesce(self.holds, F.lit(False))


def keep(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that no drop rule removes."""
    condition = F.lit(True)
    for rule in rules:
        if rule.kind == "drop":
            condition = condition & ~rule.flag
    return df.where(condition)


def rule_log(df: DataFrame, rules: Sequence[Rule], dataset: str, first_step: int = 1) -> DataFrame:
    """dataset, step, rule, kind, rows_before, rows_after, rows_changed for rules applied in order, in one pass.

    A row reaches rule i when no earlier drop rule removed it; all counts come from one partial aggregation.
    """
    aggs, alive = [], F.lit(True)
    for i, rule in enumerate(rules):
        aggs += [F.count_if(alive).alias(f"b{i}"), F.count_if(alive & rule.flag).alias(f"c{i}")]
        if rule.kind == "drop":
            alive = alive & ~rule.flag
    one = df.agg(*aggs)
    lines = F.array(*[
        F.struct(F.lit(dataset).alias("dataset"), F.lit(first_step + i).alias("step"), F.lit(r.name).alias("rule"),
                 F.lit(r.kind).alias("kind"), F.col(f"b{i}").alias("rows_before"),
                 (F.col(f"b{i}") - (F.col(f"c{i}") if r.kind == "drop" else F.lit(0))).alias("rows_after"),
                 F.col(f"c{i}").alias("rows_changed"))
        for i, r in enumerate(rules)])
    return one.select(F.inline(lines))


def duplicate_report(df: DataFrame, dataset: str, rule: str, kind: str, step: int, ignoring: Sequence[str] = ()) -> DataFrame:
    """One log line for rows equal to an earlier row, over all columns or all but `ignoring`."""
    keys = [c for c in df.columns if c not in set(ignoring)]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_same"))
    one = counts.agg(F.coalesce(F.sum("n_same"), F.lit(0)).alias("rows_before"),
                     F.coalesce(F.sum(F.col("n_same") - 1), F.lit(0)).alias("rows_changed"))
    removed = F.col("rows_changed") if kind == "drop" else F.lit(0)
    return one.select(F.lit(dataset).alias("dataset"), F.lit(step).alias("step"), F.lit(rule).alias("rule"),
                      F.lit(kind).alias("kind"), "rows_before", (F.col("rows_before") - removed).alias("rows_after"), "rows_changed")


def duplicate_counts(df: DataFrame, ignoring: Sequence[str] = ()) -> DataFrame:
    """n_rows, n_distinct and n_repeated (rows beyond the first of each group of equals)."""
    keys = [c for c in df.columns if c not in set(ignoring)]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_same"))
    return counts.agg(F.coalesce(F.sum("n_same"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
                      F.coalesce(F.sum(F.col("n_same") - 1), F.lit(0)).alias("n_repeated"))


# ---- dated visits (patient ids, booking and appointment dates) -------------------------------------------
def visit_rules() -> list[Rule]:
    return [
        Rule("drop_non_integer_patient_id", F.col("patient_id") % 1 != 0),
        Rule("drop_impossible_age", (F.col("age") < 0) | (F.col("age") > MAX_AGE)),
        Rule("drop_appointment_before_scheduled", F.to_date("appointment_date") < F.to_date("scheduled_at")),
    ]


def clean_visits(raw: DataFrame) -> DataFrame:
    """The clean visit table: rules, exact duplicates, whole-number ids, lead time and weekday."""
    kept = keep(raw, visit_rules()).dropDuplicates()
    # an id from 2^53 on may have been rounded by the double it was read as: fail instead of guessing
    exact = F.when(F.abs("patient_id") < 2.0 ** 53, F.col("patient_id")).otherwise(
        F.raise_error(F.lit("patient_id too large to be exact")).cast("double"))
    return (kept.withColumn("patient_id", exact.cast("long"))
            .withColumn("appointment_date", F.to_date("appointment_date"))
            .withColumn("lead_days", C.lead_days(F.col("scheduled_at"), F.col("appointment_date")))
            .withColumn("appt_weekday", C.weekday(F.col("appointment_date"))))


def visit_log(raw: DataFrame, dataset: str) -> DataFrame:
    """The complete cleaning log of `clean_visits`: rule counts, then the two duplicate lines."""
    rules = visit_rules()
    kept = keep(raw, rules)
    step = len(rules) + 1
    return (rule_log(raw, rules, dataset)
            .unionByName(duplicate_report(kept, dataset, "drop_exact_duplicates", "drop", step))
            .unionByName(duplicate_report(kept.dropDuplicates(), dataset, "report_duplicates_ignoring_appointment_id",
                                          "report", step + 1, ["appointment_id"])))


# ---- coded visits (month, weekday and hour codes, no patient id) ------------------------------------------
def coded_rules() -> list[Rule]:
    low, high = CLINIC_HOURS
    return [
        Rule("drop_negative_lead_days", F.col("lead_days") < 0),
        Rule("drop_impossible_age", (F.col("age") < 0) | (F.col("age") > MAX_AGE)),
        Rule("report_hours_outside_clinic_hours", (F.col("appt_hour") < low) | (F.col("appt_hour") > high), "report"),
    ]


def recode_coded(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Drop the cosine columns, rename, cast to whole numbers, sex 1/2 to M/F, weekdays from 0; other sex codes fail."""
    renamed = raw.drop(*[c for c in raw.columns if c.endswith("_c")]).withColumnsRenamed(names)
    whole = {c: F.col(c).cast("long") for c in renamed.columns if c != "no_show"}
    sex = (F.when(F.col("sex") == 1, "M").when(F.col("sex") == 2, "F")
           .otherwise(F.raise_error(F.lit("sex code must be 1 or 2")).cast("string")))
    return (renamed.withColumns(whole).withColumn("sex", sex)
            .withColumn("appt_weekday", F.col("appt_weekday") - 1).withColumn("booked_weekday", F.col("booked_weekday") - 1))


def clean_coded(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    return keep(recode_coded(raw, names), coded_rules()).dropDuplicates().select(*names.values(), "no_show")


def coded_log(raw: DataFrame, names: dict[str, str], dataset: str) -> DataFrame:
    """Drop rules, then exact duplicates, then the report on what is left, in that order."""
    frame, rules = recode_coded(raw, names), coded_rules()
    drops, reports = [r for r in rules if r.kind == "drop"], [r for r in rules if r.kind == "report"]
    kept, step = keep(frame, drops), len(drops) + 1
    return (rule_log(frame, drops, dataset)
            .unionByName(duplicate_report(kept, dataset, "drop_exact_duplicates", "drop", step))
            .unionByName(rule_log(kept.dropDuplicates(), reports, dataset, step + 1)))


# ---- consultations --------------------------------------------------------------------------------------
def consultation_rules() -> list[Rule]:
    seconds = F.col("service_seconds")
    return [
        Rule("drop_missing_or_nonpositive_service_time", seconds.isNull() | (seconds <= 0)),
        Rule("drop_service_time_above_limit", seconds > MAX_SERVICE_SECONDS),
    ]


def clean_consultations(raw: DataFrame) -> DataFrame:
    kept = keep(raw, consultation_rules()).dropDuplicates()
    return (kept.withColumn("service_seconds", F.col("service_seconds").cast("long"))
            .withColumn("service_minutes", F.col("service_seconds") / F.lit(60.0)))


def consultation_log(raw: DataFrame, dataset: str) -> DataFrame:
    rules = consultation_rules()
    return rule_log(raw, rules, dataset).unionByName(
        duplicate_report(keep(raw, rules), dataset, "drop_exact_duplicates", "drop", len(rules) + 1))
