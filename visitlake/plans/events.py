"""Registered queries: batch forms of the streaming jobs over the event table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import attempts, audit
from ..streaming import jobs
from . import views as V
from .catalog import query
from .oracle import big, day_text, num, time_text, with_views

DAY_US = 86_400_000_000


@query("failure_window", f"""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS at_us, event_type = 'error' AS failed FROM events)
SELECT event_id, user_id, at_us, {big(f'''sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_us
  RANGE BETWEEN {DAY_US - 1} PRECEDING AND CURRENT ROW)''', 'n_failures')} FROM e""")
def failure_window(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", "user_id", C.micros(F.col("ts")).alias("at_us"), (F.col("event_type") == "error").alias("failed"))
    return attempts.failures_within(e, ["user_id"], "at_us", "failed", DAY_US).drop("failed")


#: one row per try and address in order: the failures that count so far, of the address and with their emails
LOCKOUT_SQL = f"""
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS address, user_id || '-' || (event_id % 3) AS email, epoch_us(ts) AS at_us, event_id AS attempt_id,
    event_type NOT IN ('error', 'click', 'view') AS ok FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY at_us, attempt_id) AS k FROM e),
walk AS (
  SELECT DISTINCT address, 0::BIGINT AS k, NULL::VARCHAR AS email, NULL::BIGINT AS at_us, NULL::BIGINT AS attempt_id, NULL::VARCHAR AS verdict, 0::BIGINT AS wait_us,
    []::BIGINT[] AS whole, []::STRUCT(e VARCHAR, t BIGINT)[] AS mails FROM t
  UNION ALL
  SELECT address, k, email, at_us, attempt_id, verdict, wait_us, CASE WHEN verdict = 'failed' THEN list_append(whole, at_us) ELSE whole END,
    CASE verdict WHEN 'failed' THEN list_append(mails, {{'e': email, 't': at_us}}) WHEN 'accepted' THEN list_filter(mails, lambda m: m.e <> email) ELSE mails END
  FROM (SELECT *, CASE WHEN wait_us > 0 THEN 'refused' WHEN ok THEN 'accepted' ELSE 'failed' END AS verdict
    FROM (SELECT t.address, t.k, t.email, t.at_us, t.attempt_id, t.ok, w.whole, w.mails, list_filter(w.mails, lambda m: m.e = t.email) AS own,
        greatest(0, CASE WHEN len(own) >= {attempts.PAIR_LIMIT} THEN own[len(own) - {attempts.PAIR_LIMIT - 1}].t + {2 * DAY_US} - t.at_us ELSE 0 END,
          CASE WHEN len(w.whole) >= {attempts.ADDRESS_LIMIT} THEN w.whole[len(w.whole) - {attempts.ADDRESS_LIMIT - 1}] + {2 * DAY_US} - t.at_us ELSE 0 END)::BIGINT AS wait_us
      FROM walk w JOIN t ON t.address = w.address AND t.k = w.k + 1)))
SELECT address, email, at_us, attempt_id, verdict, wait_us FROM walk WHERE k > 0"""


@query("login_lockout", LOCKOUT_SQL)
def login_lockout(spark, sf):
    """An address per user and three emails on each; views, clicks and errors fail."""
    e = V.table(spark, sf, "events")
    tries = e.select(F.col("user_id").cast("string").alias("address"), F.concat_ws("-", "user_id", F.col("event_id") % 3).alias("email"),
                     C.micros(F.col("ts")).alias("at_us"), F.col("event_id").alias("attempt_id"), (~F.col("event_type").isin("error", "click", "view")).alias("ok"))
    return attempts.login_lockout(tries, 2 * DAY_US)


@query("events_daily", f"""
SELECT {day_text('ts', 'day')}, event_type, count(*) AS n, {num('sum(value)', 'total')} FROM events GROUP BY CAST(ts AS DATE), event_type""")
def events_daily(spark, sf):
    return jobs.daily_counts(V.table(spark, sf, "events"), "ts", ["event_type"])


@query("standby_notices", with_views(["bookings", "booking_log", "standby"], f"""
WITH l AS (SELECT *, lag(status) OVER (PARTITION BY booking_id ORDER BY at_us, seq) AS from_status FROM booking_log)
SELECT s.standby_id, s.patient_id, s.doctor_id, {day_text('s.slot_date', 'slot_date')}, b.slot_id, {time_text('b.slot_start', 'slot_start')}
FROM l JOIN bookings b ON b.booking_id = l.booking_id JOIN standby s ON s.doctor_id = b.doctor_id AND s.slot_date = b.slot_date
WHERE l.status = 'cancelled' AND l.from_status IN ('confirmed', 'closed')"""))
def standby_notices(spark, sf):
    log = audit.transition_audit(V.booking_log(spark, sf)).select("booking_id", "status", "from_status")
    where = V.bookings(spark, sf).select("booking_id", "doctor_id", "slot_date", "slot_id", "slot_start")
    return jobs.standby_notices(log.join(where, "booking_id"), V.standby(spark, sf))
