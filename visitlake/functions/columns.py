"""Column expressions shared by the operators. All of them stay on the JVM side."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959964

# fixed values: right-closed bands, as (upper edges, labels); the first band starts above `low`
LEAD_BANDS = ((-1, 0, 3, 7, 14, 30), ("0 (same day)", "1-3", "4-7", "8-14", "15-30", "31+"))
AGE_BANDS = ((-1, 4, 17, 34, 49, 64), ("0-4", "5-17", "18-34", "35-49", "50-64", "65+"))
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")

# fixed values: 0.975 quantiles of Student's t for 1 to 29 degrees of freedom (public table)
T_975 = (12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135,
         2.262157163, 2.228138852, 2.200985160, 2.178812830, 2.160368656, 2.144786688, 2.131449546, 2.119905299,
         2.109815578, 2.100922040, 2.093024054, 2.085963447, 2.079613845, 2.073873068, 2.068657610, 2.063898562,
         2.059538553, 2.055529439, 2.051830516, 2.048407142, 2.045229642)
NORMAL_975 = 1.959963985


# ---- time ------------------------------------------------------------------------------------------------
def micros(ts: Column) -> Column:
    """Microseconds since 1970 on the written clock, whatever the session time zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def at_minute(day: Column, minute: Column) -> Column:
    """The local timestamp `minute` minutes after midnight of `day`."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute.cast("int"))


def weekday(day: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(day)


def monday_of(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def lead_days(booked: Column, appointment: Column) -> Column:
    """Whole days between the two calendar dates."""
    return F.datediff(F.to_date(appointment), F.to_date(booked))


def age_in_years(born: Column, on: Column) -> Column:
    """Completed years on the date `on`; NULL when `on` is before the birth date. 29 February turns a year on 1 March."""
    not_yet = (F.month(on) * 100 + F.dayofmonth(on)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.when(born <= on, F.year(on) - F.year(born) - F.when(not_yet, 1).otherwise(0))


def has_started(start: Column, now: Column) -> Column:
    return start <= now


# ---- bands ------------------------------------------------------------------------------------------------
def right_closed_band(value: Column, bands: tuple[Sequence, Sequence[str]]) -> Column:
    """The label of (edge[i], edge[i+1]]; the last band is open above, values at or below the first edge give NULL."""
    edges, labels = bands
    out = F.when(value <= edges[0], F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        out = out.when(value <= upper, label)
    return out.when(value.isNotNull(), labels[-1])


def weekday_label(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), number + 1)


def risk_band(p: Column, medium: float, high: float) -> Column:
    """Half open: high from `high`, medium from `medium`, else low; NULL without a probability."""
    return F.when(p >= high, "high").when(p >= medium, "medium").when(p.isNotNull(), "low")


# ---- numbers ----------------------------------------------------------------------------------------------
def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, NULL when the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _wilson(successes: Column, n: Column, sign: int, z: float) -> Column:
    n, p = n.cast("double"), ratio(successes, n)
    spread = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z
    return (p + z * z / (2 * n) + sign * spread) / (1 + z * z / n)


def wilson_low(successes: Column, n: Column, z: float = Z95) -> Column:
    """Lower end of the Wilson score interval, exactly 0 without successes, NULL without rows."""
    return F.when(n > 0, F.when(successes == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), _wilson(successes, n, -1, z))))


def wilson_high(successes: Column, n: Column, z: float = Z95) -> Column:
    return F.when(n > 0, F.when(successes == n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), _wilson(successes, n, 1, z))))


def t_975(df: Column) -> Column:
    """0.975 quantile of Student's t: the table below 30 degrees of freedom, the normal expansion from there on."""
    x, n = NORMAL_975, df.cast("double")
    terms = (
        (x ** 3 + x) / 4,
        (5 * x ** 5 + 16 * x ** 3 + 3 * x) / 96,
        (3 * x ** 7 + 19 * x ** 5 + 17 * x ** 3 - 15 * x) / 384,
        (79 * x ** 9 + 776 * x ** 7 + 1482 * x ** 5 - 1920 * x ** 3 - 945 * x) / 92160,
    )
    series = F.lit(x)
    for power, term in enumerate(terms, start=1):
        series = series + term / F.pow(n, F.lit(float(power)))
    table = F.array(*[F.lit(v) for v in T_975])
    return F.when(df < 1, F.lit(None).cast("double")).when(df <= len(T_975), F.try_element_at(table, df.cast("int"))).otherwise(series)


def ceil_to(value: Column, step: float) -> Column:
    return (F.ceil(value / step) * step).cast("int")


def mix(seed: int, *parts: Column) -> Column:
    """A deterministic number in [0, 2147483646] from whole-number columns below 2^31 each.

    Products stay below 2^63, so any SQL engine computes the same value. Three squaring rounds break the linear pattern.
    """
    prime = 2147483647
    h = F.lit(seed).cast("long")
    for part in parts:
        h = ((h * 1103515245 + part.cast("long") * 12345 + 42) % prime)
        h = (h * h + 48271) % prime
    for _ in range(2):
        h = (h * h + 48271) % prime
    return h


# ---- text -------------------------------------------------------------------------------------------------
def normal_email(text: Column) -> Column:
    return F.lower(F.trim(text))


def blank_to_null(text: Column, limit: int) -> Column:
    """Trimmed and cut to `limit` characters; blank becomes NULL."""
    return F.substring(F.nullif(F.trim(text), F.lit("")), 1, limit)


def status_label(status: Column) -> Column:
    """no_show -> No show."""
    spaced = F.replace(status, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 100))


def minutes_text(seconds: Column) -> Column:
    """Whole minutes rounded up, at least 1, in words."""
    minutes = F.greatest(F.lit(1), F.ceil(seconds / 60).cast("int"))
    return F.concat(minutes.cast("string"), F.when(minutes == 1, " minute").otherwise(" minutes"))


def fixed(value: Column, decimals: int) -> Column:
    """Plain fixed decimals, rounded half up by the formatter."""
    return F.format_string(f"%.{decimals}f", value)


def percent(value: Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", value * 100)


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def signed_points(value: Column) -> Column:
    """A share as signed percentage points with one decimal."""
    return F.format_string("%+.1f", value * 100)


def shows_number(text: Column, number: str) -> Column:
    """True if `number` stands in the text as a whole number, not inside a longer one."""
    escaped = number.replace(".", "\\.").replace("+", "\\+")
    return text.rlike(rf"(?<![\d.]){escaped}(?![\d])")
