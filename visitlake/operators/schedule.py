"""Schedules, occupancy, free slots, clashes, leave and slot generation, for all doctors and patients at once.

Input columns: bookings(booking_id, slot_id, patient_id, doctor_id, slot_date, slot_start, start_minute, status, created_at),
slots(slot_id, doctor_id, slot_date, slot_start), doctors(doctor_id, user_id, specialization, slot_minutes), users(user_id, name).
A cancelled booking frees its slot; a closed one (leave) holds it but is not an appointment.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import APPOINTMENT_STATUSES
from .running import Run, run_sum, running
from .upsert import upsert_by_key

CLOSED = "closed"


def active(bookings: DataFrame) -> DataFrame:
    return bookings.where(F.col("status") != "cancelled")


# ---- joins -------------------------------------------------------------------------------------------------
def booking_star(bookings: DataFrame, doctors: DataFrame, users: DataFrame) -> DataFrame:
    """Every booking with its doctor and patient details. Small dimensions are broadcast by size, not by promise."""
    doctor_user, patient_user = users.alias("du"), users.alias("pu")
    return (bookings.join(doctors, "doctor_id")
            .join(doctor_user, doctors.user_id == F.col("du.user_id"))
            .join(patient_user, F.col("patient_id") == F.col("pu.user_id"))
            .select("booking_id", "status", "created_at", "slot_id", "slot_date", "slot_start", "doctor_id", "specialization",
                    F.col("du.name").alias("doctor_name"), "patient_id", F.col("pu.name").alias("patient_name")))


def doctor_list(doctors: DataFrame, users: DataFrame) -> DataFrame:
    """Doctors with their names, in name order regardless of case."""
    return (doctors.join(users, "user_id").select("doctor_id", "user_id", "specialization", "slot_minutes", "name")
            .orderBy(F.lower("name"), "doctor_id"))


def slot_holders(slots: DataFrame, bookings: DataFrame) -> DataFrame:
    """Every slot with its active booking, if any. Cancelled rows are filtered before the join."""
    held = active(bookings).select("slot_id", "booking_id", "status", "patient_id")
    return slots.join(held, "slot_id", "left")


def doctor_schedule(slots: DataFrame, bookings: DataFrame, users: DataFrame) -> DataFrame:
    held = slot_holders(slots, bookings)
    return (held.join(users, held.patient_id == users.user_id, "left")
            .select("doctor_id", "slot_date", "slot_start", "slot_id", "booking_id", "status", F.col("name").alias("patient_name")))


def slot_state(slots: DataFrame, bookings: DataFrame, now: Column) -> DataFrame:
    """past, then closed, then taken, then free: the first that applies."""
    state = (F.when(C.has_started(F.col("slot_start"), now), "past").when(F.col("status") == CLOSED, CLOSED)
             .when(F.col("booking_id").isNotNull(), "taken").otherwise("free"))
    return slot_holders(slots, bookings).select("slot_id", "doctor_id", "slot_date", "slot_start", "booking_id", state.alias("state"))


def free_slots(slots: DataFrame, bookings: DataFrame, now: Column) -> DataFrame:
    """Slots ahead that no active booking holds."""
    return slots.where(F.col("slot_start") > now).join(active(bookings).select("slot_id"), "slot_id", "left_anti")


def owned_rows(requests: DataFrame, rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Each requested (key, requester) with found = 1 only if that requester owns the row; absent and not owned look alike."""
    owned = rows.select(F.col(key).alias("__key"), F.col(owner).alias("__owner")).distinct().withColumn("__found", F.lit(1))
    return (requests.join(owned, (F.col(key) == F.col("__key")) & (F.col("requester") == F.col("__owner")), "left")
            .select(*requests.columns, F.coalesce("__found", F.lit(0)).alias("found")))


def semi_ids(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the wanted list."""
    return rows.join(wanted.select(key), key, "left_semi")


# ---- clashes ------------------------------------------------------------------------------------------------
def clash_counts(requests: DataFrame, bookings: DataFrame, doctors: DataFrame) -> DataFrame:
    """n_clashes per request: the patient's active bookings on that day whose time overlaps the requested slot.

    requests(request_id, patient_id, slot_date, start_minute, slot_minutes, ignore_booking_id). Half open: two visits overlap
    when each starts before the other ends, so back-to-back visits do not. No pair of rows is built: an interval overlaps
    [s, e) unless it starts at or after e or ends at or before s, so overlaps = (starts before e) - (ends up to s), two
    running counts over one line per patient and day. Bookings are first counted per distinct minute, so a day line holds
    at most a few thousand entries however many bookings the patient has. The ignored booking is subtracted at the end.
    """
    held = (active(bookings).join(doctors.select("doctor_id", "slot_minutes"), "doctor_id")
            .select("booking_id", "patient_id", "slot_date", F.col("start_minute").cast("long").alias("s"),
                    (F.col("start_minute") + F.col("slot_minutes")).cast("long").alias("e")))
    asked = requests.select("request_id", "patient_id", "slot_date", "ignore_booking_id", F.col("start_minute").cast("long").alias("s"),
                            (F.col("start_minute") + F.col("slot_minutes")).cast("long").alias("e"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    # marks at minute t: bookings starting or ending there; probes read the counts before e and up to s
    marks = held.select("patient_id", "slot_date", F.inline(F.array(
        F.struct(F.col("s").alias("t"), one.alias("starts"), zero.alias("ends")),
        F.struct(F.col("e").alias("t"), zero.alias("starts"), one.alias("ends")))))
    probes = asked.select("patient_id", "slot_date", F.explode(F.array("s", "e")).alias("t")).distinct().select(
        "patient_id", "slot_date", "t", zero.alias("starts"), zero.alias("ends"))
    line = marks.unionByName(probes).groupBy("patient_id", "slot_date", "t").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
    upto = Window.partitionBy("patient_id", "slot_date").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = line.select("patient_id", "slot_date", "t", (F.sum("starts").over(upto) - F.col("starts")).alias("starts_before"),
                          F.sum("ends").over(upto).alias("ends_upto"))
    day = ["patient_id", "slot_date"]
    at_end = counted.select(*day, F.col("t").alias("e"), "starts_before")
    at_start = counted.select(*day, F.col("t").alias("s"), "ends_upto")
    ignored = held.select(F.col("booking_id").alias("ignore_booking_id"), F.col("patient_id").alias("ip"), F.col("slot_date").alias("idt"),
                          F.col("s").alias("is"), F.col("e").alias("ie"))
    joined = asked.join(at_end, day + ["e"]).join(at_start, day + ["s"]).join(ignored, "ignore_booking_id", "left")
    mine = ((F.col("ip") == F.col("patient_id")) & (F.col("idt") == F.col("slot_date"))
            & (F.col("is") < F.col("e")) & (F.col("s") < F.col("ie")))
    return joined.select("request_id", "patient_id", "slot_date",
                         (F.col("starts_before") - F.col("ends_upto") - F.when(mine, 1).otherwise(0)).alias("n_clashes"))


def overlap_requests(bookings: DataFrame, doctors: DataFrame) -> DataFrame:
    """Every active booking as a request that ignores itself: n_clashes > 0 marks a patient in two places at once."""
    return (active(bookings).join(doctors.select("doctor_id", "slot_minutes"), "doctor_id")
            .select(F.col("booking_id").alias("request_id"), "patient_id", "slot_date", "start_minute", "slot_minutes",
                    F.col("booking_id").alias("ignore_booking_id")))


# ---- counts ---------------------------------------------------------------------------------------------------
def is_upcoming(now: Column) -> Column:
    return (F.col("status") == "confirmed") & (F.col("slot_start") > now)


def admin_counts(bookings: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """One row: people by role, bookings by status (zero where none), upcoming bookings."""
    by_role = users.agg(F.count_if(F.col("role") == "patient").alias("patients"), F.count_if(F.col("role") == "doctor").alias("doctors"))
    by_status = bookings.agg(*[F.count_if(F.col("status") == s).alias(s) for s in APPOINTMENT_STATUSES],
                             F.count_if(is_upcoming(now)).alias("upcoming"))
    return by_role.crossJoin(F.broadcast(by_status))  # two single rows


def calendar(slots: DataFrame, first: Column, days: int) -> DataFrame:
    """Every doctor that has slots, on every day of a short range (`days` is a parameter, at most a few weeks)."""
    return slots.select("doctor_id").distinct().select(
        "doctor_id", F.explode(F.sequence(first, F.date_add(first, days - 1))).alias("slot_date"))


def week_summary(slots: DataFrame, bookings: DataFrame, day: Column) -> DataFrame:
    """Monday to Sunday of the week of `day`, per doctor: total and booked slots, days without slots included."""
    monday = C.monday_of(day)
    inside = F.col("slot_date").between(monday, F.date_add(monday, 6))
    counts = (slot_holders(slots.where(inside), bookings.where(inside)).groupBy("doctor_id", "slot_date")
              .agg(F.count("slot_id").alias("total"), F.count_if(F.col("booking_id").isNotNull() & (F.col("status") != CLOSED)).alias("booked")))
    return (calendar(slots, monday, 7).join(counts, ["doctor_id", "slot_date"], "left")
            .select("doctor_id", "slot_date", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("booked", F.lit(0)).alias("booked")))


def free_per_day(slots: DataFrame, bookings: DataFrame, now: Column) -> DataFrame:
    """Per doctor and day: slots still ahead and how many of them are free."""
    ahead = F.col("slot_start") > now
    return (slot_holders(slots, bookings).groupBy("doctor_id", "slot_date")
            .agg(F.count_if(ahead).alias("ahead"), F.count_if(ahead & F.col("booking_id").isNull()).alias("free")))


def upcoming_days(slots: DataFrame, bookings: DataFrame, first: Column, days: int, now: Column) -> DataFrame:
    """For each of `days` days from `first`: free slots ahead, and whether the day has slots at all."""
    inside = F.col("slot_date").between(first, F.date_add(first, days - 1))
    counts = free_per_day(slots.where(inside), bookings.where(inside), now)
    return (calendar(slots, first, days).join(counts, ["doctor_id", "slot_date"], "left")
            .select("doctor_id", "slot_date", F.col("ahead").isNotNull().cast("int").alias("has_slots"), F.coalesce("free", F.lit(0)).alias("free")))


def first_free_day(slots: DataFrame, bookings: DataFrame, first: Column, days: int, now: Column) -> DataFrame:
    """The first day with a free slot per doctor, else `first`."""
    listed = upcoming_days(slots, bookings, first, days, now)
    return listed.groupBy("doctor_id").agg(F.coalesce(F.min(F.when(F.col("free") > 0, F.col("slot_date"))), first).alias("day"))


def full_days(slots: DataFrame, bookings: DataFrame, now: Column) -> DataFrame:
    """Days with slots ahead and none of them free: the only days one can wait for."""
    today = F.col("slot_date") >= F.to_date(now)
    return free_per_day(slots.where(today), bookings.where(today), now).where((F.col("ahead") > 0) & (F.col("free") == 0))


# ---- lists -------------------------------------------------------------------------------------------------------
def upcoming_topn(bookings: DataFrame, n: int, now: Column) -> DataFrame:
    """The next `n` confirmed appointments; the id breaks ties so that the list is stable. Details are joined to these rows only."""
    return bookings.where(is_upcoming(now)).orderBy("slot_start", "booking_id").limit(n)


PAGE_ORDER = ("slot_date", "slot_start", "booking_id")


def bookings_page(bookings: DataFrame, per_page: int, after: Column | None = None, status: str | None = None) -> DataFrame:
    """A page of appointments, newest first: the `per_page` rows that follow the row with key `after` (`page_end` of the page before).

    Every page costs the same however far down it is; details are joined to its rows only. The totals are `bookings_total`.
    """
    rows = bookings.where(F.col("status") != CLOSED)
    if status:
        rows = rows.where(F.col("status") == status)
    if after is not None:
        rows = rows.where(F.struct(*PAGE_ORDER) < after)
    return rows.orderBy(*[F.desc(c) for c in PAGE_ORDER]).limit(per_page)


def page_end(page: DataFrame) -> Column:
    """The key of the last row of a page."""
    return page.agg(F.min(F.struct(*PAGE_ORDER))).scalar()


def bookings_total(bookings: DataFrame) -> DataFrame:
    """Appointments by status, and of all statuses together under `all`, in one pass."""
    rows = bookings.where(F.col("status") != CLOSED)
    return rows.rollup("status").agg(F.count(F.lit(1)).alias("total"), F.grouping("status").alias("g")).select(
        F.when(F.col("g") == 1, "all").otherwise(F.col("status")).alias("status"), "total")


def patient_history(bookings: DataFrame, now: Column) -> DataFrame:
    """A patient's own list: part upcoming (soonest first) or history (latest first), with the position in each part."""
    upcoming = is_upcoming(now)
    rows = bookings.where(F.col("status") != CLOSED).select(
        "patient_id", "booking_id", "status", "slot_start", F.when(upcoming, "upcoming").otherwise("history").alias("part"))
    at = C.micros(F.col("slot_start"))
    rows = rows.withColumn("__t", F.when(F.col("part") == "upcoming", at).otherwise(-at))
    return running(rows, ["patient_id", "part"], ["__t", "booking_id"], {"position": Run("sum", F.lit(1).cast("long"))}).drop("__t")


# ---- writes expressed as tables ---------------------------------------------------------------------------------
def wanted_slots(doctors: DataFrame, first: Column, last: Column, start_minute: int, end_minute: int,
                 skip_weekends: bool = False) -> DataFrame:
    """Every whole slot that fits between the two times, per doctor and day of the range."""
    days = F.explode(F.sequence(first, last)).alias("slot_date")
    fits = F.lit(end_minute) - F.col("slot_minutes")
    listed = doctors.where(fits >= start_minute).select("doctor_id", "slot_minutes", days)
    if skip_weekends:
        listed = listed.where(C.weekday(F.col("slot_date")) < 5)
    return listed.select("doctor_id", "slot_date", F.explode(F.sequence(F.lit(start_minute), fits, F.col("slot_minutes"))).alias("start_minute"))


def slot_generation(doctors: DataFrame, slots: DataFrame, first: Column, last: Column, start_minute: int, end_minute: int,
                    skip_weekends: bool = False) -> DataFrame:
    """Wanted slots with existing = 1 where the slot is already there; the rows with 0 are the ones to insert."""
    have = slots.where(F.col("slot_date").between(first, last)).select("doctor_id", "slot_date", "start_minute").distinct()
    wanted = wanted_slots(doctors, first, last, start_minute, end_minute, skip_weekends)
    return (wanted.join(have.withColumn("existing", F.lit(1)), ["doctor_id", "slot_date", "start_minute"], "left")
            .select("doctor_id", "slot_date", "start_minute", F.coalesce("existing", F.lit(0)).alias("existing")))


def missing_slots(wanted: DataFrame, slots: DataFrame) -> DataFrame:
    """Wanted minus existing."""
    return wanted.exceptAll(slots.select(*wanted.columns).distinct())


def leave_plan(slots: DataFrame, bookings: DataFrame, first: Column, last: Column, now: Column) -> DataFrame:
    """Per slot ahead in the range: close (free), keep (booked by a patient) or closed (already)."""
    inside = F.col("slot_date").between(first, last)
    held = slot_holders(slots.where(inside & (F.col("slot_start") > now)), bookings.where(inside))
    action = F.when(F.col("booking_id").isNull(), "close").when(F.col("status") == CLOSED, CLOSED).otherwise("keep")
    return held.select("doctor_id", "slot_id", "slot_start", "booking_id", action.alias("action"))


def leave_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("doctor_id").agg(F.count_if(F.col("action") == "close").alias("closed"), F.count_if(F.col("action") == "keep").alias("booked"))


def leave_rows(plan: DataFrame, now: Column) -> DataFrame:
    """The rows to write for a leave, from `leave_plan`: one closed booking without a patient for each free slot.

    The key follows from the slot (its negative number), so a plan written twice, or a slot closed again after it was reopened, replaces
    its own row.
    """
    return plan.where(F.col("action") == "close").select((-F.col("slot_id")).alias("booking_id"), "slot_id", "doctor_id", "slot_start", F.to_date("slot_start").alias("slot_date"),
                                                         F.lit(None).cast("long").alias("patient_id"), F.lit(CLOSED).alias("status"), now.alias("created_at"))


def reopen_rows(bookings: DataFrame, first: Column, last: Column, now: Column) -> DataFrame:
    """The rows to change when a range is reopened: its closed bookings, cancelled now."""
    return bookings.where((F.col("status") == CLOSED) & F.col("slot_date").between(first, last)).withColumns({"status": F.lit("cancelled"), "cancelled_at": now})


def write_rows(bookings: DataFrame, rows: DataFrame) -> DataFrame:
    """The bookings after rows were written: by key, and a closed row only where no other booking holds the slot, as a patient may have
    been faster. Writing the same rows twice changes nothing."""
    held = bookings.where((F.col("status") != "cancelled") & (F.col("booking_id") >= 0)).select("slot_id").distinct().withColumn("__held", F.lit(True))
    fit = rows.join(held, "slot_id", "left").where(F.col("__held").isNull() | (F.col("status") != CLOSED)).drop("__held")
    return upsert_by_key(bookings, fit, ["booking_id"]).select(*bookings.columns)


def reopen(bookings: DataFrame, first: Column, last: Column) -> DataFrame:
    """All bookings after reopening a range: closed rows in it become cancelled, appointments are untouched."""
    hit = (F.col("status") == CLOSED) & F.col("slot_date").between(first, last)
    return bookings.withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status")))


# ---- standby ------------------------------------------------------------------------------------------------------
def standby_board(standby: DataFrame, slots: DataFrame, bookings: DataFrame, now: Column, max_waiting: int = 10) -> DataFrame:
    """Entries from today on: free slots now, place in the queue of that doctor and day, the patient's own load."""
    live = standby.where(F.col("slot_date") >= F.to_date(now))
    waited, today = live.select("doctor_id", "slot_date").distinct(), F.col("slot_date") >= F.to_date(now)
    asked = slots.where(today).join(waited, ["doctor_id", "slot_date"], "left_semi")
    free = free_per_day(asked, bookings.where(today), now).select("doctor_id", "slot_date", "free")
    load = live.groupBy("patient_id").agg(F.count(F.lit(1)).alias("waiting"))
    placed = running(live.withColumn("__t", C.micros(F.col("created_at"))), ["doctor_id", "slot_date"], ["__t", "standby_id"],
                     {"place": run_sum(F.lit(1).cast("long"))}).drop("__t")
    return (placed.join(free, ["doctor_id", "slot_date"], "left").join(load, "patient_id")
            .select("standby_id", "patient_id", "doctor_id", "slot_date", "place", F.coalesce("free", F.lit(0)).alias("free"), "waiting",
                    (F.col("waiting") >= max_waiting).cast("int").alias("at_limit")))


def clear_standby(standby: DataFrame, bookings: DataFrame) -> DataFrame:
    """Standby entries left after bookings: the wait is over once the patient holds a slot with that doctor on that day."""
    got = bookings.where(F.col("status") == "confirmed").select("patient_id", "doctor_id", "slot_date").distinct()
    return standby.join(got, ["patient_id", "doctor_id", "slot_date"], "left_anti")
