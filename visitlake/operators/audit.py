"""Data-quality audits: uniqueness, references, vocabularies, status transitions, field rules, quoted numbers."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import previous

# fixed values: from which states a booking may move to each state
ALLOWED_FROM = {
    "cancelled": ("confirmed", "closed"),
    "completed": ("confirmed", "completed", "no_show"),
    "no_show": ("confirmed", "completed", "no_show"),
}


def unique_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row; a NULL in the key exempts the row, as in a UNIQUE constraint."""
    return (df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1))


def orphan_count(child: DataFrame, column: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """One line: how many non-NULL references have no parent row."""
    keys = parent.select(F.col(parent_key).alias(column)).distinct()
    # count per value first, so a hot dangling key is one row in the join
    used = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    lost = used.join(keys, column, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_bad")).select(F.lit(name).alias("rule"), "n_bad")


def value_count(df: DataFrame, column: str, allowed: Sequence[str], name: str) -> DataFrame:
    """One line: how many rows hold a value outside the vocabulary."""
    bad = ~F.col(column).isin(*allowed)
    return df.agg(F.count_if(bad).alias("n_bad")).select(F.lit(name).alias("rule"), "n_bad")


def stack(lines: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, lines)


def transition_audit(log: DataFrame, key: str = "booking_id", at: str = "at_us", seq: str = "seq", status: str = "status",
                     start: str = "start_us") -> DataFrame:
    """Each change with its previous status and verdict.

    A first row is confirmed or closed and comes before the start. Cancelling needs a confirmed booking before its start, or a closed slot;
    an outcome needs a started booking that was confirmed or already has an outcome. `at` and `start` are numbers on the same
    scale. The previous row comes from a running value, so one key may hold any share of the log.
    """
    rows = previous(log, [key], [at, seq], [status], prefix="from_")
    before, to = F.col(f"from_{status}"), F.col(status)
    started = F.col(start) <= F.col(at)
    ok = (F.when(before.isNull(), to.isin("confirmed", "closed") & ~started)
          .when(to == "cancelled", (before == "closed") | ((before == "confirmed") & ~started))
          .when(to.isin("completed", "no_show"), before.isin(*ALLOWED_FROM["completed"]) & started)
          .otherwise(F.lit(False)))
    return rows.withColumn("valid", ok.cast("int"))


def latest_state(log: DataFrame, key: str = "booking_id", at: str = "at_us", seq: str = "seq", status: str = "status") -> DataFrame:
    """The current status per key: a partial aggregation, no window."""
    return log.groupBy(key).agg(F.max_by(status, F.struct(at, seq)).alias(status))


# ---- field rules -------------------------------------------------------------------------------------------------
# fixed values: form limits
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
FIRST_DAY, LAST_DAY = "1900-01-01", "2100-12-31"
MAX_ID = 2 ** 31 - 1


def iso_date(text: Column) -> Column:
    """An ISO date between 1900 and 2100, else NULL."""
    trimmed = F.trim(text)
    day = F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(trimmed, "yyyy-MM-dd"))
    return F.when(day.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")), day)


def whole_number(text: Column, low: int | None = None, high: int = MAX_ID) -> Column:
    """A whole number in the range, else NULL."""
    trimmed = F.trim(text)
    n = F.when(trimmed.rlike(r"^[+-]?\d{1,18}$"), trimmed.try_cast("long"))
    inside = n <= high if low is None else (n >= low) & (n <= high)
    return F.when(inside, n)


def is_email(text: Column) -> Column:
    return text.rlike(EMAIL_PATTERN) & (F.length(text) <= 255)


def clock_minute(text: Column) -> Column:
    """HH:MM (seconds allowed) as the minute of the day, else NULL."""
    trimmed = F.trim(text)
    hit = trimmed.rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?$")
    return F.when(hit, F.substring(trimmed, 1, 2).cast("int") * 60 + F.substring(trimmed, 4, 2).cast("int"))


def registration_rules(today: Column) -> dict[str, Column]:
    """message -> condition that must hold, for a patient registration."""
    born = iso_date(F.col("date_of_birth"))
    return {
        "name": F.length(F.trim("name")).between(1, 120),
        "email": is_email(F.lower(F.trim("email"))),
        "password": F.length("password").between(8, 128),
        "date_of_birth": (born <= today) & (born >= F.date_sub(today, 366 * 120)),
        "sex": F.col("sex").isin("F", "M"),
    }


def doctor_rules() -> dict[str, Column]:
    return {
        "name": F.length(F.trim("name")).between(1, 120),
        "email": is_email(F.lower(F.trim("email"))),
        "password": F.length("password").between(8, 128),
        "specialization": F.length(F.trim("specialization")).between(1, 100),
        "slot_minutes": whole_number(F.col("slot_minutes"), 5, 120).isNotNull(),
    }


def leave_rules() -> dict[str, Column]:
    first, last = iso_date(F.col("date_from")), iso_date(F.col("date_to"))
    return {"dates": first.isNotNull() & last.isNotNull(), "order": first.isNull() | last.isNull() | (last >= first),
            "action": F.col("action").isin("close", "reopen")}


def time_window_rules() -> dict[str, Column]:
    start, end = clock_minute(F.col("start_time")), clock_minute(F.col("end_time"))
    return {"times": start.isNotNull() & end.isNotNull(), "order": start.isNull() | end.isNull() | (end > start)}


def validate_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add errors: the messages of the rules a row breaks, in rule order (a rule on a NULL field is broken)."""
    broken = F.array(*[F.when(~F.coalesce(must, F.lit(False)), F.lit(message)) for message, must in rules.items()])
    return df.withColumn("errors", F.filter(broken, lambda m: m.isNotNull()))


# ---- quoted numbers ----------------------------------------------------------------------------------------------
def long_cells(results: DataFrame, source: str, key: str, columns: Sequence[str]) -> DataFrame:
    """A result table as (source, row_key, column_name, value)."""
    return (results.select(F.col(key).cast("string").alias("row_key"), *[F.col(c).cast("double").alias(c) for c in columns])
            .unpivot("row_key", list(columns), "column_name", "value").withColumn("source", F.lit(source)))


MAX_DECIMALS = 15  # more than a double has


def reconcile_numbers(audit: DataFrame, cells: DataFrame) -> DataFrame:
    """Each quoted number against the result cells: problem is missing, ambiguous, changed or NULL when it holds.

    audit(audit_id, source, row_key, column_name, decimals, quoted). The cells are reduced per key before the join.
    """
    per_cell = cells.groupBy("source", "row_key", "column_name").agg(F.count(F.lit(1)).alias("n_cells"), F.min("value").alias("value"))
    joined = audit.join(per_cell, ["source", "row_key", "column_name"], "left")
    current = F.raise_error(F.format_string("decimals must be 0 to %d, not %d", F.lit(MAX_DECIMALS), F.col("decimals"))).cast("string")
    for decimals in range(MAX_DECIMALS + 1):
        current = F.when(F.col("decimals") == decimals, F.format_string(f"%.{decimals}f", F.col("value"))).otherwise(current)
    problem = (F.when(F.col("n_cells").isNull(), "missing").when(F.col("n_cells") > 1, "ambiguous")
               .when(~current.eqNullSafe(F.col("quoted")), "changed"))
    return joined.select("audit_id", "source", "row_key", "column_name", "quoted",
                         F.when(F.col("n_cells") == 1, current).alias("current"), problem.alias("problem"))
