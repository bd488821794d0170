"""Clinic tables derived from the driver's Parquet tables, each a plain DataFrame over one or two scans."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import OPENML_NAMES, TABLES

CALENDAR_START = "1999-01-01"
CALENDAR_DAYS = 180
NOW = "1999-04-01 10:00:00"
DOCTOR_USER_BASE = 1_000_000_000_000  # user ids of doctors start here, patients keep their own id
TASK_ROWS = 250_000  # visits that a task of a large table joins and cleans: it sorts and hashes all of them in its memory
FEW_TASKS = 16  # up to so many, Spark's own merged partitions are small enough


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def now(spark: SparkSession | None = None):
    return F.lit(NOW).cast("timestamp_ntz")


# ---- operational tables ------------------------------------------------------------------------------------
def doctors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("doctor_id"), (F.col("s_suppkey") + DOCTOR_USER_BASE).alias("user_id"),
        F.col("n_name").alias("specialization"), (15 + 5 * (F.col("s_suppkey") % 4)).cast("int").alias("slot_minutes"))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("patient_id"), F.when(key % 2 == 0, "F").otherwise("M").alias("sex"),
        F.date_add(F.lit("1930-01-01").cast("date"), (key * 37 % 20000).cast("int")).alias("date_of_birth"),
        F.col("c_mktsegment").alias("neighbourhood"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.lit("patient").alias("role"))
    staff = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + DOCTOR_USER_BASE).alias("user_id"), F.col("s_name").alias("name"), F.lit("doctor").alias("role"))
    return people.unionByName(staff)


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One booking per order, spread over a fixed calendar; slot_id encodes doctor and quarter hour."""
    o = table(spark, sf_dir, "orders")
    n_doctors = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    key = F.col("o_orderkey")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    low = F.col("o_orderpriority") == "5-LOW"
    rows = o.select(
        key.alias("booking_id"), F.col("o_custkey").alias("patient_id"), (key % n_doctors).alias("doctor_id"),
        F.date_add(F.lit(CALENDAR_START).cast("date"),
                   (F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) % CALENDAR_DAYS).cast("int")).alias("slot_date"),
        (540 + 15 * (key % 16)).cast("int").alias("start_minute"),
        F.when(F.col("o_orderstatus") == "F", F.when(urgent, "no_show").otherwise("completed"))
         .when(F.col("o_orderstatus") == "O", "confirmed")
         .otherwise(F.when(low, "closed").otherwise("cancelled")).alias("status"),
        ((key * 13 + F.col("o_custkey") * 7) % 45).cast("int").alias("ahead_days"),
        (key % 600).cast("int").alias("created_minute"))
    return (rows
            .withColumn("slot_start", C.at_minute(F.col("slot_date"), F.col("start_minute")))
            .withColumn("created_at", C.at_minute(F.date_sub("slot_date", F.col("ahead_days")), F.col("created_minute")))
            .withColumn("slot_id", slot_key(F.col("doctor_id"), F.col("slot_date"), F.col("start_minute")))
            .withColumn("active_slot_id", F.when(F.col("status") != "cancelled", F.col("slot_id")))
            .drop("ahead_days", "created_minute"))


def slot_key(doctor, day, minute):
    return (doctor * 10_000_000 + F.datediff(day, F.lit("1990-01-01").cast("date")) * 96 + F.floor(minute / 15)).cast("long")


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every booked quarter hour, and for every third quarter the one after it, so that some slots are free."""
    b = bookings(spark, sf_dir).select("doctor_id", "slot_date", "start_minute")
    both = b.select("doctor_id", "slot_date", F.explode(F.array_compact(F.array(
        "start_minute", F.when(F.col("start_minute") % 45 == 0, F.col("start_minute") + 15)))).alias("start_minute"))
    return (both.distinct()
            .withColumn("slot_start", C.at_minute(F.col("slot_date"), F.col("start_minute")))
            .withColumn("slot_id", slot_key(F.col("doctor_id"), F.col("slot_date"), F.col("start_minute"))))


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of every three bookings have a stored score, most of them from the current model version."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(key % 3 != 0).select(
        key.alias("booking_id"), ((key * 7919 % 1000) / F.lit(1000.0)).alias("no_show_probability"),
        F.when(key % 10 < 8, "v1").otherwise("v0").alias("model_version"))


def standby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per patient, doctor and day, from the event stream."""
    n_doctors = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    e = table(spark, sf_dir, "events")
    return (e.select(F.col("user_id").alias("patient_id"), (F.col("event_id") % n_doctors).alias("doctor_id"),
                     F.date_add(F.lit(CALENDAR_START).cast("date"), (F.col("event_id") * 7 % CALENDAR_DAYS).cast("int")).alias("slot_date"),
                     "event_id", "ts")
            .groupBy("patient_id", "doctor_id", "slot_date")
            .agg(F.min("event_id").alias("standby_id"), F.min("ts").alias("created_at")))


def booking_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes: every booking is made, most change once, every seventh is marked completed after its start."""
    b = bookings(spark, sf_dir)
    made, start = C.micros(F.col("created_at")), C.micros(F.col("slot_start"))
    day, half_hour = 86_400_000_000, 1_800_000_000

    def row(seq, status, at):
        return F.struct(F.lit(seq).alias("seq"), status.alias("status"), at.alias("at_us"))

    first = F.when(F.col("status") == "closed", "closed").otherwise("confirmed")
    changes = F.array(
        row(1, first, made),
        F.when(~F.col("status").isin("confirmed", "closed"), row(2, F.col("status"), made + (F.col("booking_id") % 60) * day)),
        F.when(F.col("booking_id") % 7 == 0, row(3, F.lit("completed"), start + half_hour)))
    return (b.select("booking_id", start.alias("start_us"), F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("c"))
            .select("booking_id", "start_us", "c.seq", "c.status", "c.at_us"))


# ---- research tables ---------------------------------------------------------------------------------------
def raw_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits with a known outcome, still carrying the defects that cleaning removes.

    The tasks of a large table follow its rows, as merged shuffle partitions would grow with them; cleaning keeps these partitions by appointment.
    """
    lines = table(spark, sf_dir, "lineitem")
    parts = -(-lines.count() // TASK_ROWS)
    li = lines.where(F.col("l_returnflag").isin("R", "A"))
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    booked = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_custkey", "o_orderdate", "c_mktsegment")
    if parts > FEW_TASKS:
        li, booked = li.repartition(parts, "l_orderkey"), booked.repartition(parts, "o_orderkey")
    wide = li.join(booked, li.l_orderkey == booked.o_orderkey)
    key = F.col("o_custkey")
    return wide.select(
        F.col("l_orderkey").alias("appointment_id"),
        (key + F.when(F.col("l_quantity") == 50, 0.5).otherwise(0.0)).alias("patient_id"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("sex"),
        F.col("o_orderdate").alias("scheduled_at"), F.col("l_shipdate").alias("appointment_date"),
        (key % 125 - 5).cast("int").alias("age"), F.col("c_mktsegment").alias("neighbourhood"),
        F.when(F.col("l_tax") >= 0.06, 1).otherwise(0).alias("scholarship"),
        F.when(F.col("l_discount") >= 0.08, 1).otherwise(0).alias("hypertension"),
        F.when(F.col("l_tax") == 0, 1).otherwise(0).alias("diabetes"),
        F.when(F.col("l_linenumber") == 7, 1).otherwise(0).alias("alcoholism"),
        (F.col("l_linenumber") % 3).cast("int").alias("handicap"),
        (F.col("l_linenumber") % 2).cast("int").alias("sms_received"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("no_show"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.cleaning import clean_visits

    return clean_visits(raw_visits(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per visit with a known outcome: patient, y, a near-continuous score p and a coarse second score p2."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A"))
    o = table(spark, sf_dir, "orders")
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    noise = (F.round(F.col("l_extendedprice") * 100).cast("long") * 7919 % 10007) / F.lit(10007.0)
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("patient_id"), F.col("l_linenumber").alias("fold"), y.alias("y"),
        (0.2 * y + 0.7 * noise + 0.05).alias("p"),
        ((F.col("l_linenumber") % 4 + y) / F.lit(8.0) + F.col("l_discount") * 2).alias("p2"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue rows: one session per half day, in event order; risk is the chance that the patient stays away."""
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        F.to_date(ts).alias("day"), F.floor(F.hour(ts) / 12).cast("int").alias("half_day"), C.micros(ts).alias("at_us"), "event_id",
        ((F.hour(ts) % 12 * 60 + F.minute(ts)) * F.lit(1.0)).alias("arrival"), F.col("value").alias("service"),
        (F.col("event_type") != "error").alias("attends"), ((F.col("event_id") * 7919 % 1000) / F.lit(1000.0)).alias("risk"))


def raw_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded visits as their file has them, by the file's column names: no patient id, sex as 1 and 2, weekdays from 1."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).where(F.col("l_returnflag").isin("R", "A"))
    values = {
        "specialty": F.col("l_suppkey") % 9, "age": F.col("o_custkey") % 125 - 5, "sex": 1 + F.col("o_custkey") % 2,
        "appt_month": F.month("l_shipdate"), "appt_weekday": 1 + C.weekday(F.to_date("l_shipdate")), "appt_hour": 5 + F.col("l_orderkey") % 18,
        "booked_month": F.month("o_orderdate"), "booked_weekday": 1 + C.weekday(F.to_date("o_orderdate")), "booked_hour": 6 + 2 * F.col("l_linenumber"),
        "lead_days": F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")) - 5, "channel": 1 + F.col("l_linenumber") % 3, "appt_type": 1 + F.col("l_orderkey") % 2,
    }
    raw_name = {new: old for old, new in OPENML_NAMES.items()}
    return rows.select(*[v.cast("double").alias(raw_name[k]) for k, v in values.items()], F.cos(F.col("l_orderkey") % 18).alias("reserva_hora_c"),
                       F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("no_show"))


def raw_consultations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consultations with their service time, missing for errors, of sessions of half a day."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("patient_code"), F.date_format("ts", "yyyy-MM-dd").alias("session"),
        F.when(F.hour("ts") < 12, "AM").otherwise("PM").alias("am_pm"), (F.col("event_id") % 50).cast("int").alias("visit_no"),
        F.when(F.col("event_type") != "error", F.floor(F.col("value") * 300)).cast("double").alias("service_seconds"))
