"""Registered queries: history, cleaning, features, profiles and splits."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cleaning, features, history, profile, risk, splits
from ..schemas import OPENML_NAMES
from . import views as V
from .catalog import query
from .oracle import band, big, day_text, mix, num, t_975, time_text, wilson, with_views

HISTORY_CTE = """probes AS (SELECT *, row_number() OVER () AS rid FROM visits),
h AS (SELECT p.rid, count(v.patient_id) AS n, CAST(coalesce(sum(v.no_show), 0) AS BIGINT) AS missed
      FROM probes p LEFT JOIN visits v ON v.patient_id = p.patient_id AND v.appointment_date < CAST(p.scheduled_at AS DATE)
      GROUP BY p.rid),
hist AS (SELECT p.*, n AS prev_appointments, missed AS prev_no_shows, CASE WHEN n > 0 THEN CAST(missed AS DOUBLE) / n END AS prev_no_show_rate,
      CASE WHEN n > 0 THEN 1 ELSE 0 END AS has_history FROM probes p JOIN h USING (rid))"""
RATE = ("ci_low", "ci_high")


def rate_sql(k="no_show_n", n="n"):
    low, high = wilson(k, n)
    return f"{big(n, 'n')}, {big(k, 'no_show_n')}, {num(f'CAST({k} AS DOUBLE) / {n}', 'rate')}, {num(low, 'ci_low')}, {num(high, 'ci_high')}"


def visits_with_history(spark, sf):
    return history.history_asof(V.visits(spark, sf))


@query("history_asof", with_views(["visits"], f"""
WITH {HISTORY_CTE}
SELECT patient_id, appointment_id, {day_text('hist.scheduled_at', 'booked')}, {day_text('hist.appointment_date', 'appointment_date')}, no_show,
  CAST(prev_appointments AS BIGINT) AS prev_appointments, prev_no_shows, {num('prev_no_show_rate', 'prev_no_show_rate')}, has_history FROM hist"""))
def history_asof(spark, sf):
    return visits_with_history(spark, sf).select(
        "patient_id", "appointment_id", F.to_date("scheduled_at").alias("booked"), "appointment_date", "no_show",
        "prev_appointments", "prev_no_shows", "prev_no_show_rate", "has_history")


SERVING_CTE = """known AS (SELECT patient_id, slot_date, CASE WHEN status = 'no_show' THEN 1 ELSE 0 END AS y FROM bookings WHERE status IN ('completed', 'no_show')),
s AS (SELECT b.booking_id, count(k.y) AS prev_appointments, CAST(coalesce(sum(k.y), 0) AS BIGINT) AS prev_no_shows
  FROM bookings b LEFT JOIN known k ON k.patient_id = b.patient_id AND k.slot_date < CAST(b.created_at AS DATE) GROUP BY b.booking_id)"""


@query("history_serving", with_views(["bookings"], f"""
WITH {SERVING_CTE}
SELECT booking_id, CAST(prev_appointments AS BIGINT) AS prev_appointments, prev_no_shows,
  {num('CASE WHEN prev_appointments > 0 THEN CAST(prev_no_shows AS DOUBLE) / prev_appointments END', 'prev_no_show_rate')} FROM s"""))
def history_serving(spark, sf):
    b = V.bookings(spark, sf)
    known = b.where(F.col("status").isin(*risk.KNOWN)).withColumn("no_show", (F.col("status") == "no_show").cast("int"))
    out = history.history_asof(b.withColumn("no_show", F.lit(None).cast("int")), "patient_id", "created_at", "slot_date", "no_show", known)
    return out.select("booking_id", "prev_appointments", "prev_no_shows", "prev_no_show_rate")


# ---- cleaning ---------------------------------------------------------------------------------------------------
@query("clean_bookings", with_views(["visits"], f"""
SELECT appointment_id, patient_id, sex, {time_text('scheduled_at', 'scheduled_at')}, {day_text('appointment_date', 'appointment_date')}, age, neighbourhood,
  scholarship, hypertension, diabetes, alcoholism, handicap, sms_received, no_show FROM visits"""))
def clean_bookings(spark, sf):
    return V.visits(spark, sf).drop("lead_days", "appt_weekday")


DROPS = ("patient_id % 1 <> 0", "age < 0 OR age > 110", "CAST(appointment_date AS DATE) < CAST(scheduled_at AS DATE)")


@query("clean_log", with_views(["raw_visits"], f"""
WITH f AS (SELECT *, {', '.join(f'({d}) AS d{i}' for i, d in enumerate(DROPS, 1))} FROM raw_visits),
k AS (SELECT * EXCLUDE (d1, d2, d3) FROM f WHERE NOT d1 AND NOT d2 AND NOT d3), u AS (SELECT DISTINCT * FROM k),
c AS (SELECT count(*) AS n0, count(*) FILTER (NOT d1) AS n1, count(*) FILTER (NOT d1 AND NOT d2) AS n2, count(*) FILTER (NOT d1 AND NOT d2 AND NOT d3) AS n3,
  (SELECT count(*) FROM u) AS n4, (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (appointment_id) FROM u)) AS n5 FROM f)
SELECT 'visits' AS dataset, step, rule, kind, CAST(rows_before AS BIGINT) AS rows_before, CAST(rows_after AS BIGINT) AS rows_after, CAST(rows_changed AS BIGINT) AS rows_changed FROM (
SELECT 1 AS step, 'drop_non_integer_patient_id' AS rule, 'drop' AS kind, n0 AS rows_before, n1 AS rows_after, n0 - n1 AS rows_changed FROM c
UNION ALL SELECT 2, 'drop_impossible_age', 'drop', n1, n2, n1 - n2 FROM c
UNION ALL SELECT 3, 'drop_appointment_before_scheduled', 'drop', n2, n3, n2 - n3 FROM c
UNION ALL SELECT 4, 'drop_exact_duplicates', 'drop', n3, n4, n3 - n4 FROM c
UNION ALL SELECT 5, 'report_duplicates_ignoring_appointment_id', 'report', n4, n4, n4 - n5 FROM c)"""))
def clean_log(spark, sf):
    return cleaning.visit_log(V.raw_visits(spark, sf), "visits")


COARSE = ["appointment_id", "sex", "neighbourhood", "age", "appt_weekday", "no_show"]


@query("dup_report", with_views(["visits"], f"""
SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(c - 1) AS BIGINT) AS n_repeated
FROM (SELECT count(*) AS c FROM visits GROUP BY {', '.join(COARSE[1:])})"""))
def dup_report(spark, sf):
    return cleaning.duplicate_counts(V.visits(spark, sf).select(*COARSE), ignoring=["appointment_id"])


@query("lead_features", with_views(["visits"], f"""
SELECT appointment_id, patient_id, {day_text('appointment_date', 'appointment_date')}, lead_days, appt_weekday FROM visits"""))
def lead_features(spark, sf):
    return V.visits(spark, sf).select("appointment_id", "patient_id", "appointment_date", "lead_days", "appt_weekday")


@query("feature_matrix", with_views(["visits"], f"""
WITH {HISTORY_CTE}
SELECT patient_id, CAST(prev_appointments AS BIGINT) AS prev_appointments, {num('prev_no_show_rate', 'prev_no_show_rate')}, has_history, lead_days,
  CASE WHEN lead_days = 0 THEN 1 ELSE 0 END AS lead_same_day, appt_weekday, age, CASE WHEN sex = 'F' THEN 1 ELSE 0 END AS is_female,
  sms_received, scholarship, hypertension, diabetes, alcoholism, handicap, neighbourhood FROM hist"""))
def feature_matrix(spark, sf):
    return features.dated_features(visits_with_history(spark, sf), keep=["patient_id"])


@query("deployable_features", with_views(["bookings", "patients"], f"""
WITH {SERVING_CTE},
r AS (SELECT b.booking_id, b.patient_id, b.status, p.sex, s.prev_appointments, s.prev_no_shows, b.slot_date,
  CAST(b.slot_date - CAST(b.created_at AS DATE) AS INTEGER) AS lead,
  CASE WHEN p.date_of_birth <= b.slot_date THEN CAST(year(b.slot_date) - year(p.date_of_birth)
    - CASE WHEN month(b.slot_date) * 100 + day(b.slot_date) < month(p.date_of_birth) * 100 + day(p.date_of_birth) THEN 1 ELSE 0 END AS INTEGER) END AS yrs
  FROM bookings b JOIN patients p ON p.patient_id = b.patient_id JOIN s ON s.booking_id = b.booking_id),
u AS (SELECT *, coalesce(sex IN ('F', 'M') AND yrs BETWEEN 0 AND 120 AND lead >= 0, FALSE) AS ok FROM r)
SELECT booking_id, patient_id, status, CASE WHEN ok THEN yrs END AS age, CASE WHEN ok THEN CASE WHEN sex = 'F' THEN 1 ELSE 0 END END AS is_female,
  CASE WHEN ok THEN lead END AS lead_days, CASE WHEN ok THEN CAST(isodow(slot_date) - 1 AS INTEGER) END AS appt_weekday,
  CASE WHEN ok THEN CAST(prev_appointments AS BIGINT) END AS prev_appointments,
  {num('CASE WHEN ok AND prev_appointments > 0 THEN CAST(prev_no_shows AS DOUBLE) / prev_appointments END', 'prev_no_show_rate')},
  CASE WHEN ok THEN 1 ELSE 0 END AS usable FROM u"""))
def deployable_features(spark, sf):
    return risk.deployable_features(V.bookings(spark, sf), V.patients(spark, sf))


# ---- rates -------------------------------------------------------------------------------------------------------
@query("wilson_rates", with_views(["visits"], f"""
SELECT neighbourhood, appt_weekday, {rate_sql()} FROM (
  SELECT neighbourhood, appt_weekday, count(*) AS n, sum(no_show) AS no_show_n FROM visits GROUP BY 1, 2)"""))
def wilson_rates(spark, sf):
    return profile.wilson_rates(V.visits(spark, sf), ["neighbourhood", "appt_weekday"])


WEEKDAY_SQL = "['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][appt_weekday + 1]"


@query("rates_grouping_sets", with_views(["visits"], f"""
WITH b AS (SELECT {band('lead_days', C.LEAD_BANDS)} AS l, {WEEKDAY_SQL} AS w, {band('age', C.AGE_BANDS)} AS a, no_show FROM visits),
g AS (SELECT 'lead_time_band' AS variable, l AS grp, count(*) AS n, sum(no_show) AS no_show_n FROM b GROUP BY l
  UNION ALL SELECT 'weekday', w, count(*), sum(no_show) FROM b GROUP BY w UNION ALL SELECT 'age_band', a, count(*), sum(no_show) FROM b GROUP BY a
  UNION ALL SELECT 'overall', 'all rows', count(*), sum(no_show) FROM b)
SELECT variable, grp AS "group", {rate_sql()} FROM g WHERE grp IS NOT NULL"""))
def rates_grouping_sets(spark, sf):
    return profile.rates_by_variable(profile.banded(V.visits(spark, sf)), ["lead_time_band", "weekday", "age_band"])


@query("band_crosstab", with_views(["visits"], f"""
WITH c AS (SELECT {band('lead_days', C.LEAD_BANDS)} AS band, sms_received AS flag, count(*) AS n, sum(no_show) AS no_show_n FROM visits GROUP BY 1, 2),
w AS (SELECT *, CAST(no_show_n AS DOUBLE) / n AS r FROM c WHERE band IS NOT NULL)
SELECT band, flag, {rate_sql()},
  {num("CAST(sum(CASE WHEN flag = 1 THEN n ELSE 0 END) OVER (PARTITION BY band) AS DOUBLE) / sum(n) OVER (PARTITION BY band)", 'share_of_band')},
  {num("max(CASE WHEN flag = 1 THEN r END) OVER (PARTITION BY band) - max(CASE WHEN flag = 0 THEN r END) OVER (PARTITION BY band)", 'rate_difference')} FROM w"""))
def band_crosstab(spark, sf):
    return profile.band_crosstab(V.visits(spark, sf), C.right_closed_band(F.col("lead_days"), C.LEAD_BANDS), "sms_received")


@query("profile_long", with_views(["visits"], """
WITH m AS (SELECT count(*) AS n, count(DISTINCT patient_id) AS np, sum(no_show) AS k, avg(no_show) AS r, min(appointment_date) AS d0, max(appointment_date) AS d1,
  count(DISTINCT appointment_date) AS nd, avg(CASE WHEN lead_days = 0 THEN 1 ELSE 0 END) AS sd, avg(sms_received) AS sms, avg(CASE WHEN sex = 'F' THEN 1 ELSE 0 END) AS fem,
  avg(age) AS am, quantile_cont(lead_days, 0.5) AS l5, quantile_cont(lead_days, 0.95) AS l95, quantile_cont(age, 0.5) AS a5 FROM visits)
SELECT 'visits' AS dataset, metric, value FROM (
SELECT 'rows_clean' AS metric, CAST(n AS VARCHAR) AS value FROM m UNION ALL SELECT 'no_show_n', CAST(k AS VARCHAR) FROM m
UNION ALL SELECT 'no_show_rate', printf('%.4f', r) FROM m UNION ALL SELECT 'unique_patients', CAST(np AS VARCHAR) FROM m
UNION ALL SELECT 'appointment_date_min', CAST(d0 AS VARCHAR) FROM m UNION ALL SELECT 'appointment_date_max', CAST(d1 AS VARCHAR) FROM m
UNION ALL SELECT 'n_appointment_dates', CAST(nd AS VARCHAR) FROM m UNION ALL SELECT 'share_same_day', printf('%.4f', sd) FROM m
UNION ALL SELECT 'share_sms_received', printf('%.4f', sms) FROM m UNION ALL SELECT 'share_female', printf('%.4f', fem) FROM m
UNION ALL SELECT 'age_mean', printf('%.4f', am) FROM m UNION ALL SELECT 'lead_days_median', printf('%.4f', CAST(l5 AS DOUBLE)) FROM m
UNION ALL SELECT 'lead_days_p95', printf('%.4f', CAST(l95 AS DOUBLE)) FROM m UNION ALL SELECT 'age_median', printf('%.4f', CAST(a5 AS DOUBLE)) FROM m
UNION ALL SELECT 'mean_per_patient', printf('%.4f', CAST(n AS DOUBLE) / np) FROM m)"""))
def profile_long(spark, sf):
    return profile.long_profile(V.visits(spark, sf), "visits")


@query("lognormal_fit", f"""
WITH m AS (SELECT event_type, count(*) AS n, avg(ln(value)) AS mu, stddev_pop(ln(value)) AS s, avg(value) AS md FROM events WHERE value > 0 GROUP BY 1),
l AS (SELECT e.event_type, sum(-ln(m.s) - 0.9189385332046727::DOUBLE - pow(ln(e.value) - m.mu, 2) / (2 * m.s * m.s) - ln(e.value)) AS ll
  FROM events e JOIN m ON m.event_type = e.event_type WHERE e.value > 0 GROUP BY 1)
SELECT event_type, {big('n', 'n')}, {num('mu', 'mu')}, {num('s', 'sigma')}, {num('round(ll, 2)', 'log_likelihood')}, {num('round(4 - 2 * ll, 2)', 'aic')},
  {num('exp(mu + s * s / 2)', 'mean_fitted')}, {num('md', 'mean_data')} FROM m JOIN l USING (event_type)""")
def lognormal_fit(spark, sf):
    out = profile.lognormal_fit(V.table(spark, sf, "events"), "value", ["event_type"])
    return out.withColumns({"log_likelihood": F.round("log_likelihood", 2), "aic": F.round("aic", 2)})


@query("default_slot_length", f"""
WITH m AS (SELECT quantile_cont(value, 0.5) AS q FROM events) SELECT {num('q', 'median')}, CAST(ceil(q / 5) * 5 AS INTEGER) AS slot_minutes FROM m""")
def default_slot_length(spark, sf):
    return profile.default_slot_minutes(V.table(spark, sf, "events"), "value")


CI_SQL = "CASE WHEN n < 2 OR sd = 0 THEN 0.0 ELSE ({t}) * sd / sqrt(n) END"


def mean_ci_sql(source: str, keys: str, value: str) -> str:
    half = CI_SQL.format(t=t_975("n - 1"))
    return f"""SELECT {keys}, {big('n', 'n')}, {num('m', 'mean')}, {num(f'm - ({half})', 'ci_low')}, {num(f'm + ({half})', 'ci_high')} FROM (
  SELECT {keys}, count({value}) AS n, avg({value}) AS m, stddev_samp({value}) AS sd FROM {source} GROUP BY {keys})"""


@query("mean_ci", mean_ci_sql("events", "user_id", "value"))
def mean_ci(spark, sf):
    return profile.mean_ci(V.table(spark, sf, "events"), ["user_id"], "value")


@query("paired_diff", f"""
WITH u AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, avg(value) AS v FROM events GROUP BY 1, 2, 3),
d AS (SELECT x.user_id, x.day, y.event_type, y.v - x.v AS diff FROM u x JOIN u y ON y.user_id = x.user_id AND y.day = x.day
  WHERE x.event_type = 'view' AND y.event_type <> 'view')
{mean_ci_sql('d', 'event_type', 'diff')}""")
def paired_diff(spark, sf):
    """Each event type against views of the same user and day."""
    u = (V.table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.avg("value").alias("v")))
    other, view = u.where(F.col("event_type") != "view"), u.where(F.col("event_type") == "view").drop("event_type")
    return profile.paired_diff(other, view, ["user_id", "day"], ["event_type"], "v")


# ---- splits ------------------------------------------------------------------------------------------------------
CUT_SQL = """d AS (SELECT DISTINCT appointment_date AS d FROM visits), k AS (SELECT least(greatest(1, CAST(round_even(count(*) * 0.2, 0) AS INTEGER)), count(*) - 1) AS k FROM d),
cut AS (SELECT d AS cut FROM (SELECT d, row_number() OVER (ORDER BY d DESC) AS r FROM d), k WHERE r = k)"""


@query("holdout_by_date", with_views(["visits"], f"""
WITH {CUT_SQL}, p AS (SELECT v.*, CASE WHEN appointment_date >= cut THEN 'holdout' ELSE 'train' END AS part FROM visits v, cut)
SELECT part, count(*) AS n, {day_text('min(appointment_date)', 'first_date')}, {day_text('max(appointment_date)', 'last_date')},
  count(DISTINCT appointment_date) AS n_dates, {num('avg(no_show)', 'rate')} FROM p GROUP BY part"""))
def holdout_by_date(spark, sf):
    parts = splits.holdout_by_date(V.visits(spark, sf))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("appointment_date").alias("first_date"), F.max("appointment_date").alias("last_date"),
                                     F.countDistinct("appointment_date").alias("n_dates"), F.avg("no_show").alias("rate"))


@query("holdout_last_month", with_views(["visits"], """
WITH m AS (SELECT *, year(appointment_date) * 12 + month(appointment_date) AS mm FROM visits)
SELECT appointment_id, patient_id, CAST(mm AS INTEGER) AS month_index, CASE WHEN mm = (SELECT max(mm) FROM m) THEN 'holdout' ELSE 'train' END AS part FROM m"""))
def holdout_last_month(spark, sf):
    v = V.visits(spark, sf).withColumn("month_index", F.year("appointment_date") * 12 + F.month("appointment_date"))
    return splits.holdout_last_month(v, "month_index").select("appointment_id", "patient_id", "month_index", "part")


FOLD_SQL = f"""g AS (SELECT patient_id, CAST((row_number() OVER (ORDER BY {mix(42, 'patient_id % 2147483647')}, patient_id) - 1) % 5 AS INTEGER) AS fold
  FROM (SELECT DISTINCT patient_id FROM visits)), f AS (SELECT v.*, g.fold FROM visits v JOIN g ON g.patient_id = v.patient_id)"""


@query("grouped_folds", with_views(["visits"], f"WITH {FOLD_SQL} SELECT patient_id, appointment_id, fold FROM f"))
def grouped_folds(spark, sf):
    return splits.grouped_folds(V.visits(spark, sf), "patient_id").select("patient_id", "appointment_id", "fold")


@query("stratified_folds", f"""
SELECT event_id, event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY {mix(42, 'event_id % 2147483647')}, event_id) - 1) % 5 AS INTEGER) AS fold FROM events""")
def stratified_folds(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", "event_type")
    return splits.stratified_folds(e, "event_type", ["event_id"]).select("event_id", "event_type", "fold")


@query("split_profile", with_views(["visits"], f"""
WITH {FOLD_SQL} SELECT fold, count(*) AS n, {num('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM f)', 'share')}, {num('avg(no_show)', 'rate')} FROM f GROUP BY fold"""))
def split_profile(spark, sf):
    return splits.split_profile(splits.grouped_folds(V.visits(spark, sf), "patient_id"), "fold")


@query("fold_audit", with_views(["visits"], f"""
WITH {FOLD_SQL} SELECT fold, count(DISTINCT patient_id) AS n_groups, CAST(count(DISTINCT patient_id) FILTER (patient_id IN (
  SELECT patient_id FROM f GROUP BY 1 HAVING count(DISTINCT fold) > 1)) AS BIGINT) AS n_both_sides FROM f GROUP BY fold"""))
def fold_audit(spark, sf):
    return splits.fold_audit(splits.grouped_folds(V.visits(spark, sf), "patient_id"), "fold", "patient_id")


@query("shared_ids", with_views(["visits"], f"""
WITH {CUT_SQL} SELECT patient_id FROM visits, cut WHERE appointment_date < cut INTERSECT SELECT patient_id FROM visits, cut WHERE appointment_date >= cut"""))
def shared_ids(spark, sf):
    parts = splits.holdout_by_date(V.visits(spark, sf))
    return splits.shared_ids(parts.where(F.col("part") == "train"), parts.where(F.col("part") == "holdout"), "patient_id")


@query("shuffled_labels", f"""
WITH a AS (SELECT event_id, user_id, row_number() OVER (ORDER BY {mix(42, 'event_id % 2147483647')}, event_id) AS i FROM events),
b AS (SELECT event_type, row_number() OVER (ORDER BY {mix(43, 'event_id % 2147483647')}, event_id) AS i FROM events)
SELECT event_id, user_id, event_type FROM a JOIN b USING (i)""")
def shuffled_labels(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return splits.shuffled_labels(e, "event_type", "event_id")


# ---- coded visits and consultations ------------------------------------------------------------------------------
_CODED_TEXT = "specialty, age, sex, appt_month, appt_weekday, appt_hour, booked_month, booked_weekday, booked_hour, lead_days, channel, appt_type, no_show"


@query("clean_coded", with_views(["coded0"], f"SELECT DISTINCT {_CODED_TEXT} FROM coded0 WHERE lead_days >= 0 AND age BETWEEN 0 AND 110"))
def clean_coded(spark, sf):
    return cleaning.clean_coded(V.raw_coded(spark, sf), OPENML_NAMES)


@query("coded_log", with_views(["coded0"], """
WITH c AS (SELECT count(*) AS n0, count(*) FILTER (lead_days >= 0) AS n1, count(*) FILTER (lead_days >= 0 AND age BETWEEN 0 AND 110) AS n2 FROM coded0),
u AS (SELECT count(*) AS n3, count(*) FILTER (appt_hour < 7 OR appt_hour > 21) AS late FROM (SELECT DISTINCT * FROM coded0 WHERE lead_days >= 0 AND age BETWEEN 0 AND 110))
SELECT 'coded' AS dataset, 1 AS step, 'drop_negative_lead_days' AS rule, 'drop' AS kind, n0 AS rows_before, n1 AS rows_after, n0 - n1 AS rows_changed FROM c
UNION ALL SELECT 'coded', 2, 'drop_impossible_age', 'drop', n1, n2, n1 - n2 FROM c
UNION ALL SELECT 'coded', 3, 'drop_exact_duplicates', 'drop', n2, n3, n2 - n3 FROM c, u
UNION ALL SELECT 'coded', 4, 'report_hours_outside_clinic_hours', 'report', n3, n3, late FROM u"""))
def coded_log(spark, sf):
    return cleaning.coded_log(V.raw_coded(spark, sf), OPENML_NAMES, "coded")


_SERVED = "service_seconds > 0 AND service_seconds <= 14400"


@query("clean_consultations", with_views(["consultations0"], f"""
SELECT patient_code, session, am_pm, visit_no, CAST(service_seconds AS BIGINT) AS service_seconds, {num('CAST(service_seconds AS BIGINT) / 60.0::DOUBLE', 'service_minutes')}
FROM (SELECT DISTINCT * FROM consultations0 WHERE {_SERVED})"""))
def clean_consultations(spark, sf):
    return cleaning.clean_consultations(V.raw_consultations(spark, sf))


@query("consultation_log", with_views(["consultations0"], f"""
WITH c AS (SELECT count(*) AS n0, count(*) FILTER (service_seconds > 0) AS n1, count(*) FILTER ({_SERVED}) AS n2 FROM consultations0),
u AS (SELECT count(*) AS n3 FROM (SELECT DISTINCT * FROM consultations0 WHERE {_SERVED}))
SELECT 'consultations' AS dataset, 1 AS step, 'drop_missing_or_nonpositive_service_time' AS rule, 'drop' AS kind, n0 AS rows_before, n1 AS rows_after, n0 - n1 AS rows_changed FROM c
UNION ALL SELECT 'consultations', 2, 'drop_service_time_above_limit', 'drop', n1, n2, n1 - n2 FROM c
UNION ALL SELECT 'consultations', 3, 'drop_exact_duplicates', 'drop', n2, n3, n2 - n3 FROM c, u"""))
def consultation_log(spark, sf):
    return cleaning.consultation_log(V.raw_consultations(spark, sf), "consultations")
