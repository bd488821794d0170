"""Registered queries over the operational tables: schedules, occupancy, clashes, standby, leave, audits."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, schedule
from . import views as V
from .catalog import query
from .oracle import NOW_SQL, big, day_text, time_text, with_views

DAY = "1999-04-07"
HOLDERS = "slots s LEFT JOIN bookings b ON b.active_slot_id = s.slot_id"


def day(text=DAY):
    return F.lit(text).cast("date")


def star(spark, sf):
    return schedule.booking_star(V.bookings(spark, sf), V.doctors(spark, sf), V.users(spark, sf))


STAR_SQL = """SELECT b.booking_id, b.status, b.created_at, b.slot_id, b.slot_date, b.slot_start, b.doctor_id, d.specialization,
  du.name AS doctor_name, b.patient_id, pu.name AS patient_name
  FROM bookings b JOIN doctors d ON d.doctor_id = b.doctor_id JOIN users du ON du.user_id = d.user_id JOIN users pu ON pu.user_id = b.patient_id"""
STAR_OUT = (f"booking_id, status, {time_text('created_at', 'created_at')}, slot_id, {day_text('slot_date', 'slot_date')}, "
            f"{time_text('slot_start', 'slot_start')}, doctor_id, specialization, doctor_name, patient_id, patient_name")
STAR_VIEWS = ["bookings", "doctors", "users"]


@query("booking_star", with_views(STAR_VIEWS, f"SELECT {STAR_OUT} FROM ({STAR_SQL})"))
def booking_star(spark, sf):
    return star(spark, sf)


@query("doctor_list", with_views(["doctors", "users"], "SELECT doctor_id, user_id, specialization, slot_minutes, name FROM doctors JOIN users USING (user_id)"))
def doctor_list(spark, sf):
    return schedule.doctor_list(V.doctors(spark, sf), V.users(spark, sf))


@query("doctor_schedule", with_views(["slots", "bookings", "users"], f"""
SELECT s.doctor_id, {day_text('s.slot_date', 'slot_date')}, {time_text('s.slot_start', 'slot_start')}, s.slot_id, b.booking_id, b.status,
  u.name AS patient_name FROM {HOLDERS} LEFT JOIN users u ON u.user_id = b.patient_id"""))
def doctor_schedule(spark, sf):
    return schedule.doctor_schedule(V.slots(spark, sf), V.bookings(spark, sf), V.users(spark, sf))


@query("slot_state", with_views(["slots", "bookings"], f"""
SELECT s.slot_id, s.doctor_id, {day_text('s.slot_date', 'slot_date')}, {time_text('s.slot_start', 'slot_start')}, b.booking_id,
  CASE WHEN s.slot_start <= {NOW_SQL} THEN 'past' WHEN b.status = 'closed' THEN 'closed' WHEN b.booking_id IS NOT NULL THEN 'taken' ELSE 'free' END AS state
FROM {HOLDERS}"""))
def slot_state(spark, sf):
    return schedule.slot_state(V.slots(spark, sf), V.bookings(spark, sf), V.now())


@query("free_slots", with_views(["slots", "bookings"], f"""
SELECT s.slot_id, s.doctor_id, {day_text('s.slot_date', 'slot_date')}, s.start_minute, {time_text('s.slot_start', 'slot_start')}
FROM slots s WHERE s.slot_start > {NOW_SQL} AND NOT EXISTS (SELECT 1 FROM bookings b WHERE b.active_slot_id = s.slot_id)"""))
def free_slots(spark, sf):
    return schedule.free_slots(V.slots(spark, sf), V.bookings(spark, sf), V.now())


@query("owned_rows", with_views(["bookings"], """
SELECT e.event_id, e.booking_id, e.requester, CASE WHEN b.booking_id IS NULL THEN 0 ELSE 1 END AS found FROM (
  SELECT event_id, event_id * 3 AS booking_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE o_custkey END AS requester
  FROM events LEFT JOIN orders ON o_orderkey = event_id * 3) e
LEFT JOIN bookings b ON b.booking_id = e.booking_id AND b.patient_id = e.requester"""))
def owned_rows(spark, sf):
    """Half of the requests come from the owner, half from some other user, some ask for bookings that do not exist."""
    e, o = V.table(spark, sf, "events"), V.table(spark, sf, "orders")
    asked = e.join(o, o.o_orderkey == e.event_id * 3, "left").select(
        "event_id", (F.col("event_id") * 3).alias("booking_id"),
        F.when(F.col("event_id") % 2 == 0, F.col("user_id")).otherwise(F.col("o_custkey")).alias("requester"))
    return schedule.owned_rows(asked, V.bookings(spark, sf), "booking_id", "patient_id")


@query("semi_ids", with_views(["bookings"], """
SELECT booking_id, patient_id, status FROM bookings WHERE patient_id IN (SELECT user_id FROM events WHERE event_type = 'signup')"""))
def semi_ids(spark, sf):
    wanted = V.table(spark, sf, "events").where(F.col("event_type") == "signup").select(F.col("user_id").alias("patient_id"))
    return schedule.semi_ids(V.bookings(spark, sf).select("booking_id", "patient_id", "status"), wanted, "patient_id").select("booking_id", "patient_id", "status")


ACTIVE = "SELECT b.*, d.slot_minutes, b.start_minute + d.slot_minutes AS end_minute FROM bookings b JOIN doctors d ON d.doctor_id = b.doctor_id WHERE b.status <> 'cancelled'"


@query("overlap_pairs", with_views(["bookings", "doctors"], f"""
WITH a AS ({ACTIVE})
SELECT x.booking_id AS request_id, x.patient_id, {day_text('x.slot_date', 'slot_date')}, {big('count(y.booking_id)', 'n_clashes')}
FROM a x LEFT JOIN a y ON y.patient_id = x.patient_id AND y.slot_date = x.slot_date AND y.booking_id <> x.booking_id
  AND x.start_minute < y.end_minute AND y.start_minute < x.end_minute
GROUP BY x.booking_id, x.patient_id, x.slot_date"""))
def overlap_pairs(spark, sf):
    b, d = V.bookings(spark, sf), V.doctors(spark, sf)
    return schedule.clash_counts(schedule.overlap_requests(b, d), b, d)


@query("patient_clash", with_views(["bookings", "doctors"], f"""
WITH a AS ({ACTIVE}), r AS (SELECT b.booking_id AS request_id, b.patient_id, b.slot_date, b.start_minute + 10 AS s, b.start_minute + 10 + 30 AS e
  FROM bookings b WHERE b.status = 'cancelled')
SELECT r.request_id, r.patient_id, {day_text('r.slot_date', 'slot_date')}, {big('count(a.booking_id)', 'n_clashes')}
FROM r LEFT JOIN a ON a.patient_id = r.patient_id AND a.slot_date = r.slot_date AND r.s < a.end_minute AND a.start_minute < r.e
GROUP BY r.request_id, r.patient_id, r.slot_date"""))
def patient_clash(spark, sf):
    """Cancelled patients ask for a half-hour slot ten minutes later on the same day."""
    b, d = V.bookings(spark, sf), V.doctors(spark, sf)
    asked = b.where(F.col("status") == "cancelled").select(
        F.col("booking_id").alias("request_id"), "patient_id", "slot_date", (F.col("start_minute") + 10).alias("start_minute"),
        F.lit(30).alias("slot_minutes"), F.lit(None).cast("long").alias("ignore_booking_id"))
    return schedule.clash_counts(asked, b, d)


@query("admin_counts", with_views(["bookings", "users"], f"""
SELECT {big("(SELECT count(*) FROM users WHERE role = 'patient')", 'patients')}, {big("(SELECT count(*) FROM users WHERE role = 'doctor')", 'doctors')},
  {big("count(*) FILTER (status = 'confirmed')", 'confirmed')}, {big("count(*) FILTER (status = 'completed')", 'completed')},
  {big("count(*) FILTER (status = 'no_show')", 'no_show')}, {big("count(*) FILTER (status = 'cancelled')", 'cancelled')},
  {big(f"count(*) FILTER (status = 'confirmed' AND slot_start > {NOW_SQL})", 'upcoming')} FROM bookings"""))
def admin_counts(spark, sf):
    return schedule.admin_counts(V.bookings(spark, sf), V.users(spark, sf), V.now())


@query("week_summary", with_views(["slots", "bookings"], f"""
WITH monday AS (SELECT CAST(date_trunc('week', DATE '{DAY}') AS DATE) AS m),
days AS (SELECT doctor_id, m + CAST(i AS INTEGER) AS slot_date FROM (SELECT DISTINCT doctor_id FROM slots), monday, range(0, 7) t(i)),
c AS (SELECT s.doctor_id, s.slot_date, count(*) AS total, count(CASE WHEN b.status <> 'closed' THEN b.booking_id END) AS booked FROM {HOLDERS} GROUP BY 1, 2)
SELECT days.doctor_id, {day_text('days.slot_date', 'slot_date')}, {big('coalesce(total, 0)', 'total')}, {big('coalesce(booked, 0)', 'booked')}
FROM days LEFT JOIN c ON c.doctor_id = days.doctor_id AND c.slot_date = days.slot_date"""))
def week_summary(spark, sf):
    return schedule.week_summary(V.slots(spark, sf), V.bookings(spark, sf), day())


FREE_SQL = (f"SELECT s.doctor_id, s.slot_date, count(*) FILTER (s.slot_start > {NOW_SQL}) AS ahead, "
            f"count(*) FILTER (s.slot_start > {NOW_SQL} AND b.booking_id IS NULL) AS free FROM {HOLDERS} GROUP BY 1, 2")
DAYS_SQL = "SELECT doctor_id, DATE '1999-04-01' + CAST(i AS INTEGER) AS slot_date FROM (SELECT DISTINCT doctor_id FROM slots), range(0, 14) t(i)"


@query("upcoming_days", with_views(["slots", "bookings"], f"""
WITH f AS ({FREE_SQL}), days AS ({DAYS_SQL})
SELECT days.doctor_id, {day_text('days.slot_date', 'slot_date')}, CASE WHEN f.ahead IS NULL THEN 0 ELSE 1 END AS has_slots, {big('coalesce(f.free, 0)', 'free')}
FROM days LEFT JOIN f ON f.doctor_id = days.doctor_id AND f.slot_date = days.slot_date"""))
def upcoming_days(spark, sf):
    return schedule.upcoming_days(V.slots(spark, sf), V.bookings(spark, sf), day("1999-04-01"), 14, V.now())


@query("first_free_day", with_views(["slots", "bookings"], f"""
WITH f AS ({FREE_SQL}), days AS ({DAYS_SQL})
SELECT days.doctor_id, {day_text("coalesce(min(CASE WHEN f.free > 0 THEN days.slot_date END), DATE '1999-04-01')", 'day')}
FROM days LEFT JOIN f ON f.doctor_id = days.doctor_id AND f.slot_date = days.slot_date GROUP BY days.doctor_id"""))
def first_free_day(spark, sf):
    return schedule.first_free_day(V.slots(spark, sf), V.bookings(spark, sf), day("1999-04-01"), 14, V.now())


@query("full_days", with_views(["slots", "bookings"], f"""
SELECT doctor_id, {day_text('slot_date', 'slot_date')}, {big('ahead', 'ahead')}, {big('free', 'free')} FROM ({FREE_SQL}) WHERE ahead > 0 AND free = 0"""))
def full_days(spark, sf):
    return schedule.full_days(V.slots(spark, sf), V.bookings(spark, sf), V.now())


@query("standby_board", with_views(["standby", "slots", "bookings"], f"""
WITH live AS (SELECT * FROM standby WHERE slot_date >= CAST({NOW_SQL} AS DATE)), f AS ({FREE_SQL}),
load AS (SELECT patient_id, count(*) AS waiting FROM live GROUP BY 1)
SELECT l.standby_id, l.patient_id, l.doctor_id, {day_text('l.slot_date', 'slot_date')},
  {big('row_number() OVER (PARTITION BY l.doctor_id, l.slot_date ORDER BY l.created_at, l.standby_id)', 'place')},
  {big('coalesce(f.free, 0)', 'free')}, {big('waiting', 'waiting')}, CASE WHEN waiting >= 10 THEN 1 ELSE 0 END AS at_limit
FROM live l LEFT JOIN f ON f.doctor_id = l.doctor_id AND f.slot_date = l.slot_date JOIN load ON load.patient_id = l.patient_id"""))
def standby_board(spark, sf):
    return schedule.standby_board(V.standby(spark, sf), V.slots(spark, sf), V.bookings(spark, sf), V.now())


@query("standby_cleared", with_views(["standby", "bookings"], """
SELECT standby_id, patient_id, doctor_id FROM standby s WHERE NOT EXISTS (SELECT 1 FROM bookings b WHERE b.status = 'confirmed'
  AND b.patient_id = s.patient_id AND b.doctor_id = s.doctor_id AND b.slot_date = s.slot_date)"""))
def standby_cleared(spark, sf):
    return schedule.clear_standby(V.standby(spark, sf), V.bookings(spark, sf)).select("standby_id", "patient_id", "doctor_id")


@query("upcoming_topn", with_views(STAR_VIEWS, f"""
SELECT {STAR_OUT} FROM ({STAR_SQL}) t WHERE status = 'confirmed' AND t.slot_start > {NOW_SQL} ORDER BY t.slot_start, booking_id LIMIT 25"""))
def upcoming_topn(spark, sf):
    top = schedule.upcoming_topn(V.bookings(spark, sf), 25, V.now())
    return schedule.booking_star(top, V.doctors(spark, sf), V.users(spark, sf)).orderBy("slot_start", "booking_id")


@query("bookings_page", with_views(STAR_VIEWS, f"""
SELECT {STAR_OUT} FROM ({STAR_SQL}) t WHERE status <> 'closed' ORDER BY t.slot_date DESC, t.slot_start DESC, booking_id DESC LIMIT 50 OFFSET 50"""))
def bookings_page(spark, sf):
    """The second page."""
    b = V.bookings(spark, sf)
    rows = schedule.bookings_page(b, 50, after=schedule.page_end(schedule.bookings_page(b, 50)))
    return schedule.booking_star(rows, V.doctors(spark, sf), V.users(spark, sf)).orderBy(*[F.desc(c) for c in schedule.PAGE_ORDER])


@query("bookings_total", with_views(["bookings"], f"""
SELECT status, {big('count(*)', 'total')} FROM bookings WHERE status <> 'closed' GROUP BY status
UNION ALL SELECT 'all', {big('count(*)', 'total')} FROM bookings WHERE status <> 'closed'"""))
def bookings_total(spark, sf):
    return schedule.bookings_total(V.bookings(spark, sf))


@query("patient_history", with_views(["bookings"], f"""
WITH p AS (SELECT patient_id, booking_id, status, slot_start,
  CASE WHEN status = 'confirmed' AND slot_start > {NOW_SQL} THEN 'upcoming' ELSE 'history' END AS part FROM bookings WHERE status <> 'closed')
SELECT patient_id, booking_id, status, {time_text('p.slot_start', 'slot_start')}, part, {big('''row_number() OVER (PARTITION BY patient_id, part
  ORDER BY CASE WHEN part = 'upcoming' THEN epoch_us(p.slot_start) ELSE -epoch_us(p.slot_start) END, booking_id)''', 'position')} FROM p"""))
def patient_history(spark, sf):
    return schedule.patient_history(V.bookings(spark, sf), V.now())


@query("slot_generation", with_views(["slots", "doctors"], f"""
WITH wanted AS (SELECT doctor_id, DATE '1999-04-01' + CAST(i AS INTEGER) AS slot_date, 540 + k * slot_minutes AS start_minute
  FROM doctors, range(0, 14) t(i), range(0, 16) u(k) WHERE 540 + (k + 1) * slot_minutes <= 780 AND isodow(DATE '1999-04-01' + CAST(i AS INTEGER)) < 6)
SELECT w.doctor_id, {day_text('w.slot_date', 'slot_date')}, CAST(w.start_minute AS INTEGER) AS start_minute, CASE WHEN s.doctor_id IS NULL THEN 0 ELSE 1 END AS existing
FROM wanted w LEFT JOIN slots s ON s.doctor_id = w.doctor_id AND s.slot_date = w.slot_date AND s.start_minute = w.start_minute"""))
def slot_generation(spark, sf):
    return schedule.slot_generation(V.doctors(spark, sf), V.slots(spark, sf), day("1999-04-01"), day("1999-04-14"), 540, 780, skip_weekends=True)


@query("leave_plan", with_views(["slots", "bookings"], f"""
SELECT s.doctor_id, s.slot_id, {time_text('s.slot_start', 'slot_start')}, b.booking_id,
  CASE WHEN b.booking_id IS NULL THEN 'close' WHEN b.status = 'closed' THEN 'closed' ELSE 'keep' END AS action
FROM {HOLDERS} WHERE s.slot_date BETWEEN DATE '1999-03-25' AND DATE '1999-05-20' AND s.slot_start > {NOW_SQL}"""))
def leave_plan(spark, sf):
    return schedule.leave_plan(V.slots(spark, sf), V.bookings(spark, sf), day("1999-03-25"), day("1999-05-20"), V.now())


@query("leave_counts", with_views(["slots", "bookings"], f"""
SELECT s.doctor_id, {big('count(*) FILTER (b.booking_id IS NULL)', 'closed')}, {big("count(*) FILTER (b.booking_id IS NOT NULL AND b.status <> 'closed')", 'booked')}
FROM {HOLDERS} WHERE s.slot_date BETWEEN DATE '1999-03-25' AND DATE '1999-05-20' AND s.slot_start > {NOW_SQL} GROUP BY 1"""))
def leave_counts(spark, sf):
    return schedule.leave_counts(schedule.leave_plan(V.slots(spark, sf), V.bookings(spark, sf), day("1999-03-25"), day("1999-05-20"), V.now()))


@query("leave_rows", with_views(["slots", "bookings"], f"""
SELECT -s.slot_id AS booking_id, s.slot_id, s.doctor_id, 'closed' AS status, {time_text('s.slot_start', 'slot_start')}
FROM {HOLDERS} WHERE s.slot_date BETWEEN DATE '1999-03-25' AND DATE '1999-05-20' AND s.slot_start > {NOW_SQL} AND b.booking_id IS NULL"""))
def leave_rows(spark, sf):
    plan = schedule.leave_plan(V.slots(spark, sf), V.bookings(spark, sf), day("1999-03-25"), day("1999-05-20"), V.now())
    return schedule.leave_rows(plan, V.now()).select("booking_id", "slot_id", "doctor_id", "status", "slot_start")


@query("leave_reopen", with_views(["bookings"], f"""
SELECT status, {big('count(*)', 'n')} FROM (SELECT CASE WHEN status = 'closed' AND slot_date BETWEEN DATE '1999-03-25' AND DATE '1999-05-20'
  THEN 'cancelled' ELSE status END AS status FROM bookings) GROUP BY 1"""))
def leave_reopen(spark, sf):
    return schedule.reopen(V.bookings(spark, sf), day("1999-03-25"), day("1999-05-20")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- audits ----------------------------------------------------------------------------------------------------
@query("unique_audit", with_views(["bookings"], f"""
SELECT active_slot_id, {big('count(*)', 'n_rows')} FROM bookings WHERE active_slot_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1"""))
def unique_audit(spark, sf):
    return audit.unique_audit(V.bookings(spark, sf), ["active_slot_id"])


@query("fk_audit", with_views(["slots", "bookings", "doctors", "users", "standby"], f"""
SELECT 'booking.slot' AS rule, {big('count(*)', 'n_bad')} FROM bookings WHERE slot_id NOT IN (SELECT slot_id FROM slots)
UNION ALL SELECT 'booking.patient', CAST(count(*) AS BIGINT) FROM bookings WHERE patient_id NOT IN (SELECT user_id FROM users)
UNION ALL SELECT 'slot.doctor', CAST(count(*) AS BIGINT) FROM slots WHERE doctor_id NOT IN (SELECT doctor_id FROM doctors)
UNION ALL SELECT 'standby.booked', CAST(count(*) AS BIGINT) FROM standby WHERE standby_id NOT IN (SELECT booking_id FROM bookings)
UNION ALL SELECT 'booking.status', CAST(count(*) AS BIGINT) FROM bookings WHERE status NOT IN ('confirmed', 'completed', 'no_show', 'cancelled')
UNION ALL SELECT 'user.role', CAST(count(*) AS BIGINT) FROM users WHERE role NOT IN ('patient', 'doctor', 'admin')"""))
def fk_audit(spark, sf):
    b, s = V.bookings(spark, sf), V.slots(spark, sf)
    u, d = V.users(spark, sf), V.doctors(spark, sf)
    return audit.stack([
        audit.orphan_count(b, "slot_id", s, "slot_id", "booking.slot"),
        audit.orphan_count(b, "patient_id", u, "user_id", "booking.patient"),
        audit.orphan_count(s, "doctor_id", d, "doctor_id", "slot.doctor"),
        audit.orphan_count(V.standby(spark, sf), "standby_id", b, "booking_id", "standby.booked"),
        audit.value_count(b, "status", ("confirmed", "completed", "no_show", "cancelled"), "booking.status"),
        audit.value_count(u, "role", ("patient", "doctor", "admin"), "user.role")])


@query("transition_audit", with_views(["booking_log"], """
WITH l AS (SELECT *, lag(status) OVER (PARTITION BY booking_id ORDER BY at_us, seq) AS from_status FROM booking_log)
SELECT booking_id, start_us, seq, status, at_us, from_status, CASE
  WHEN from_status IS NULL THEN CASE WHEN status IN ('confirmed', 'closed') AND start_us > at_us THEN 1 ELSE 0 END
  WHEN status = 'cancelled' THEN CASE WHEN from_status = 'closed' OR (from_status = 'confirmed' AND start_us > at_us) THEN 1 ELSE 0 END
  WHEN status IN ('completed', 'no_show') THEN CASE WHEN from_status IN ('confirmed', 'completed', 'no_show') AND start_us <= at_us THEN 1 ELSE 0 END
  ELSE 0 END AS valid FROM l"""))
def transition_audit(spark, sf):
    return audit.transition_audit(V.booking_log(spark, sf))


@query("latest_state", with_views(["booking_log"], """
SELECT booking_id, status FROM (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY at_us DESC, seq DESC) AS r FROM booking_log) WHERE r = 1"""))
def latest_state(spark, sf):
    return audit.latest_state(V.booking_log(spark, sf))


@query("validate_rows", r"""
WITH forms AS (SELECT o_orderkey AS form_id, CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE c_name END AS name,
  CASE WHEN o_orderkey % 7 = 0 THEN c_name ELSE c_name || '@clinic.example' END AS email, o_orderpriority AS password,
  CASE WHEN o_orderkey % 13 = 0 THEN '1890-01-01' WHEN o_orderkey % 17 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date_of_birth,
  CASE WHEN o_orderstatus = 'P' THEN 'X' WHEN o_orderstatus = 'F' THEN 'F' ELSE 'M' END AS sex
  FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT *, CASE WHEN regexp_full_match(trim(date_of_birth), '\d{4}-\d{2}-\d{2}') THEN TRY_CAST(trim(date_of_birth) AS DATE) END AS dob FROM forms)
SELECT form_id, concat_ws(',',
  CASE WHEN length(trim(name)) BETWEEN 1 AND 120 THEN NULL ELSE 'name' END,
  CASE WHEN regexp_full_match(lower(trim(email)), '[^@\s]+@[^@\s]+\.[^@\s]+') AND length(lower(trim(email))) <= 255 THEN NULL ELSE 'email' END,
  CASE WHEN length(password) BETWEEN 8 AND 128 THEN NULL ELSE 'password' END,
  CASE WHEN dob BETWEEN DATE '1900-01-01' AND DATE '2100-12-31' AND dob <= DATE '1999-04-01' AND dob >= DATE '1999-04-01' - 43920 THEN NULL ELSE 'date_of_birth' END,
  CASE WHEN sex IN ('F', 'M') THEN NULL ELSE 'sex' END) AS errors FROM f""")
def validate_rows(spark, sf):
    """Registration forms made from orders and customers, with blank names, bad addresses, short passwords and odd dates."""
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    key = F.col("o_orderkey")
    forms = o.join(c, o.o_custkey == c.c_custkey).select(
        key.alias("form_id"), F.when(key % 11 == 0, "  ").otherwise(F.col("c_name")).alias("name"),
        F.when(key % 7 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("@clinic.example"))).alias("email"),
        F.col("o_orderpriority").alias("password"),
        F.when(key % 13 == 0, "1890-01-01").when(key % 17 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_of_birth"),
        F.when(F.col("o_orderstatus") == "P", "X").when(F.col("o_orderstatus") == "F", "F").otherwise("M").alias("sex"))
    checked = audit.validate_rows(forms, audit.registration_rules(day("1999-04-01")))
    return checked.select("form_id", F.array_join("errors", ",").alias("errors"))


@query("reconcile_numbers", with_views(["bookings"], f"""
WITH cells AS (SELECT CAST(doctor_id AS VARCHAR) AS row_key, count(*) AS n, count(*) FILTER (status = 'no_show') AS missed FROM bookings GROUP BY 1),
audits AS (SELECT s_suppkey AS audit_id, CAST(s_suppkey AS VARCHAR) AS row_key, CASE WHEN s_suppkey % 2 = 0 THEN 'n' ELSE 'missed' END AS column_name,
  CASE WHEN s_suppkey % 5 = 0 THEN '150' ELSE CAST(s_suppkey % 9 + 10 AS VARCHAR) END AS quoted FROM supplier
  UNION ALL SELECT s_suppkey + 1000000, 'none' || CAST(s_suppkey AS VARCHAR), 'n', '1' FROM supplier)
SELECT a.audit_id, 'bookings' AS source, a.row_key, a.column_name, a.quoted, v AS current,
  CASE WHEN v IS NULL THEN 'missing' WHEN v <> a.quoted THEN 'changed' END AS problem
FROM (SELECT a.*, CAST(CASE WHEN a.column_name = 'n' THEN c.n ELSE c.missed END AS VARCHAR) AS v FROM audits a LEFT JOIN cells c ON c.row_key = a.row_key) a"""))
def reconcile_numbers(spark, sf):
    b, s = V.bookings(spark, sf), V.table(spark, sf, "supplier")
    results = b.groupBy("doctor_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "no_show").alias("missed"))
    cells = audit.long_cells(results, "bookings", "doctor_id", ["n", "missed"])
    key = F.col("s_suppkey")
    quoted = F.when(key % 5 == 0, "150").otherwise((key % 9 + 10).cast("string"))
    found = s.select(key.alias("audit_id"), key.cast("string").alias("row_key"), F.when(key % 2 == 0, "n").otherwise("missed").alias("column_name"),
                     quoted.alias("quoted"))
    absent = s.select((key + 1000000).alias("audit_id"), F.concat(F.lit("none"), key.cast("string")).alias("row_key"),
                      F.lit("n").alias("column_name"), F.lit("1").alias("quoted"))
    audits = found.unionByName(absent).withColumn("source", F.lit("bookings")).withColumn("decimals", F.lit(0))
    return audit.reconcile_numbers(audits, cells)
