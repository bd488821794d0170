from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from visitlake.operators import audit, risk, schedule
from visitlake.operators.upsert import lineage_entry, merge_versions, record_result, upsert_by_key
from visitlake.plans.views import slot_key

DAY = date(2030, 1, 7)
DOCTORS = "doctor_id long, slot_minutes int"


def bookings(spark, rows):
    """rows: (booking_id, patient_id, doctor_id, start_minute, status)"""
    df = spark.createDataFrame([(b, p, d, DAY, m, s) for b, p, d, m, s in rows], "booking_id long, patient_id long, doctor_id long, slot_date date, start_minute int, status string")
    return df.withColumn("slot_id", slot_key(F.col("doctor_id"), F.col("slot_date"), F.col("start_minute")))


def request(spark, patient, minute, minutes, ignore=None):
    return spark.createDataFrame([(1, patient, DAY, minute, minutes, ignore)],
                                 "request_id long, patient_id long, slot_date date, start_minute int, slot_minutes int, ignore_booking_id long")


@pytest.mark.parametrize("start,minutes,ignore,expected", [(555, 15, None, 1), (570, 15, None, 0), (525, 15, None, 0), (530, 15, None, 1), (555, 15, 1, 0)])
def test_clash_is_half_open(spark, start, minutes, ignore, expected):
    doctors = spark.createDataFrame([(1, 30), (2, 15)], DOCTORS)
    held = bookings(spark, [(1, 9, 1, 540, "confirmed"), (2, 9, 2, 540, "cancelled"), (3, 8, 2, 555, "confirmed")])
    assert schedule.clash_counts(request(spark, 9, start, minutes, ignore), held, doctors).first()["n_clashes"] == expected


def slots_from(df):
    return df.select("doctor_id", "slot_date", "start_minute").withColumn("slot_start", F.expr("slot_date::timestamp_ntz + make_dt_interval(0, 0, start_minute)"))


def test_slot_generation_twice(spark):
    doctors = spark.createDataFrame([(1, 15)], DOCTORS)
    none = spark.createDataFrame([], "doctor_id long, slot_date date, start_minute int")
    day = F.lit(DAY)
    first = schedule.slot_generation(doctors, none, day, day, 540, 780)
    assert [r["existing"] for r in first.collect()] == [0] * 16
    again = schedule.slot_generation(doctors, first.drop("existing"), day, day, 540, 780)
    assert [r["existing"] for r in again.collect()] == [1] * 16
    half = spark.createDataFrame([(1, 30)], DOCTORS)
    have = schedule.wanted_slots(half, day, day, 540, 660)
    more = schedule.slot_generation(half, have, day, day, 540, 720).collect()
    assert sum(1 - r["existing"] for r in more) == 2 and sum(r["existing"] for r in more) == 4
    assert schedule.missing_slots(schedule.wanted_slots(half, day, day, 540, 720), have).count() == 2


def test_slot_generation_fits_and_weekends(spark):
    hour, twenty = spark.createDataFrame([(1, 60)], DOCTORS), spark.createDataFrame([(1, 20)], DOCTORS)
    friday, monday = F.lit(date(2030, 1, 4)), F.lit(date(2030, 1, 7))
    assert schedule.wanted_slots(hour, friday, monday, 540, 600, skip_weekends=True).count() == 2
    assert [r["start_minute"] for r in schedule.wanted_slots(twenty, monday, monday, 540, 610).orderBy("start_minute").collect()] == [540, 560, 580]
    assert schedule.wanted_slots(hour, monday, monday, 540, 570).count() == 0


def test_leave_closes_free_slots_only(spark):
    held = bookings(spark, [(1, 9, 1, 540, "confirmed"), (2, 9, 1, 555, "cancelled"), (3, 1, 1, 570, "closed")])
    slots = slots_from(held).withColumn("slot_id", slot_key(F.col("doctor_id"), F.col("slot_date"), F.col("start_minute")))
    now = F.lit(datetime(2030, 1, 7, 8, 0)).cast("timestamp_ntz")
    plan = {r["slot_start"].minute: r["action"] for r in schedule.leave_plan(slots, held, F.lit(DAY), F.lit(DAY), now).collect()}
    assert plan == {0: "keep", 15: "close", 30: "closed"}
    states = {r["slot_start"].minute: r["state"] for r in schedule.slot_state(slots, held, F.lit(datetime(2030, 1, 7, 9, 0)).cast("timestamp_ntz")).collect()}
    assert states == {0: "past", 15: "free", 30: "closed"}


def test_cancelled_rows_do_not_break_uniqueness(spark):
    rows = [(1, 5, "cancelled"), (2, 5, "cancelled"), (3, 5, "confirmed")]
    df = spark.createDataFrame(rows, "id long, slot_id long, status string")
    active = lambda d: d.withColumn("active", F.when(F.col("status") != "cancelled", F.col("slot_id")))
    assert audit.unique_audit(active(df), ["active"]).count() == 0
    two = spark.createDataFrame(rows + [(4, 5, "closed")], df.schema)
    assert audit.unique_audit(active(two), ["active"]).collect()[0]["n_rows"] == 2


def test_transitions(spark):
    log = [(1, 1, 0, 100, "confirmed"), (1, 2, 10, 100, "cancelled"), (1, 3, 120, 100, "completed"), (2, 1, 0, 100, "confirmed"), (2, 2, 110, 100, "cancelled"),
           (3, 1, 0, 100, "confirmed"), (3, 2, 110, 100, "completed"), (3, 3, 115, 100, "no_show"), (4, 1, 0, 100, "closed"), (4, 2, 200, 100, "cancelled"), (5, 1, 0, 100, "completed")]
    df = spark.createDataFrame(log, "booking_id long, seq long, at_us long, start_us long, status string")
    got = {(r["booking_id"], r["seq"]): r["valid"] for r in audit.transition_audit(df).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 3): 0, (2, 1): 1, (2, 2): 0, (3, 1): 1, (3, 2): 1, (3, 3): 1, (4, 1): 1, (4, 2): 1, (5, 1): 0}


def test_form_rules(spark):
    df = spark.createDataFrame([("A", "a@b.org", "longenough", "2000-02-30", "F"), ("A", "a@b", "short", "1990-01-01", "Q")],
                               "name string, email string, password string, date_of_birth string, sex string")
    got = audit.validate_rows(df, audit.registration_rules(F.lit(date(2030, 1, 1)))).collect()
    assert got[0]["errors"] == ["date_of_birth"] and got[1]["errors"] == ["email", "password", "sex"]
    windows = spark.createDataFrame([("09:00", "08:00"), ("9am", "10:00"), ("09:00", "09:30:00")], "start_time string, end_time string")
    assert [r["errors"] for r in audit.validate_rows(windows, audit.time_window_rules()).collect()] == [["order"], ["times"], []]
    leave = spark.createDataFrame([("2030-01-02", "2030-01-01", "close"), ("2030-01-01", "2030-01-01", "open")], "date_from string, date_to string, action string")
    assert [r["errors"] for r in audit.validate_rows(leave, audit.leave_rules()).collect()] == [["order"], ["action"]]
    doctor = spark.createDataFrame([("D", "d@e.org", "longenough", "GP", "4"), ("D", "d@e.org", "longenough", "GP", " 15 ")],
                                   "name string, email string, password string, specialization string, slot_minutes string")
    assert [r["errors"] for r in audit.validate_rows(doctor, audit.doctor_rules()).collect()] == [["slot_minutes"], []]


def test_band_monitor_counts_current_scores_with_outcomes(spark):
    data = [("completed", 0.1, "v1")] * 3 + [("no_show", 0.1, "v1"), ("completed", 0.19, "v1"), ("no_show", 0.37, "v1"), ("no_show", 0.38, "v1"),
            ("no_show", 0.9, "v1"), ("completed", 0.5, "v1"), ("confirmed", 0.9, "v1"), ("no_show", 0.9, "v0")]
    rows = [(i, *r) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "booking_id long, status string, no_show_probability double, model_version string")
    got = {r["band"]: (r["bookings"], r["no_shows"]) for r in risk.band_monitor(df.drop("status"), df.select("booking_id", "status"), "v1", 0.19, 0.38).collect()}
    assert got == {"high": (3, 2), "medium": (2, 1), "low": (4, 1)}
    empty = risk.band_monitor(df.drop("status"), df.select("booking_id", "status"), "v9", 0.19, 0.38).collect()
    assert [(r["band"], r["bookings"], r["rate"]) for r in empty] == [("low", 0, None), ("medium", 0, None), ("high", 0, None)]


def test_upsert_lineage_and_versions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 2)], "k long, v string, w int")
    assert {tuple(r) for r in upsert_by_key(old, new, ["k"]).collect()} == {(1, "a", None), (2, "c", 1), (3, "d", 2)}
    files = spark.createDataFrame([("x.csv", "ab")], "path string, sha256 string")
    entry = lineage_entry("t.parquet", "job", 42, files)
    assert record_result(entry, lineage_entry("t.parquet", "job2", 42, files)).collect()[0]["script"] == "job2"
    with pytest.raises(Exception, match="fingerprint"):
        lineage_entry("t", "j", 1, spark.createDataFrame([("x", None)], "path string, sha256 string")).collect()
    versions = spark.createDataFrame([(1, 0, "old"), (1, 1, "new")], "k long, batch long, v string")
    assert merge_versions(versions, ["k"], [F.col("batch")]).collect()[0]["v"] == "new"


def test_quoted_numbers(spark):
    cells = spark.createDataFrame([("f", "a", "x", 0.73249), ("f", "b", "x", 1.0), ("f", "b", "x", 2.0)], "source string, row_key string, column_name string, value double")
    quoted = spark.createDataFrame([(1, "f", "a", "x", 3, "0.732"), (2, "f", "a", "x", 3, "0.733"), (3, "f", "b", "x", 3, "1.000"), (4, "f", "z", "x", 3, "1.000")],
                                   "audit_id long, source string, row_key string, column_name string, decimals int, quoted string")
    got = {r["audit_id"]: r["problem"] for r in audit.reconcile_numbers(quoted, cells).collect()}
    assert got == {1: None, 2: "changed", 3: "ambiguous", 4: "missing"}
