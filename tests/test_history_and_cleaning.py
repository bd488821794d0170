from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from visitlake.functions import columns as C
from visitlake.operators import cleaning
from visitlake.operators.history import before_booking, feature_mismatches, history_asof
from visitlake.sources.synthetic import synthetic_visits

SCHEMA = "id long, patient_id long, scheduled_at timestamp_ntz, appointment_date date, no_show int"


def visit(i, patient, booked, appointment, missed):
    return (i, patient, datetime.fromisoformat(booked), date.fromisoformat(appointment), missed)


def test_same_day_visits_do_not_count(spark):
    rows = [visit(0, 1, "2030-05-01", "2030-05-02", 1), visit(1, 1, "2030-05-03", "2030-05-10", 0),
            visit(2, 1, "2030-05-10", "2030-05-12", 1), visit(3, 2, "2030-05-04", "2030-05-05", 0)]
    got = {r["id"]: r for r in history_asof(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i]["prev_appointments"] for i in range(4)] == [0, 1, 1, 0]
    assert [got[i]["prev_no_shows"] for i in range(4)] == [0, 1, 1, 0]
    assert [got[i]["prev_no_show_rate"] for i in range(4)] == [None, 1.0, 1.0, None]
    assert [got[i]["has_history"] for i in range(4)] == [0, 1, 1, 0]


def test_a_visit_between_booking_and_appointment_is_unknown(spark):
    rows = [visit(0, 1, "2030-05-01", "2030-05-02", 0), visit(1, 1, "2030-05-03", "2030-05-20", 0), visit(2, 1, "2030-05-04", "2030-05-10", 1)]
    got = {r["id"]: (r["prev_appointments"], r["prev_no_shows"]) for r in history_asof(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == (1, 0) and got[2] == (1, 0)


def test_history_equals_a_loop_and_ignores_later_outcomes(spark):
    data = synthetic_visits(spark, 12, 300, hot_share=0.34).select(
        F.col("appointment_id").alias("id"), "patient_id", "scheduled_at", "appointment_date", "no_show").collect()
    rows = [tuple(r) for r in data]
    assert max(sum(r[1] == p for r in rows) for p in range(12)) > 100  # one patient holds a third
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: (r["prev_appointments"], r["prev_no_shows"]) for r in history_asof(df).collect()}
    for r in rows:
        earlier = [q for q in rows if q[1] == r[1] and q[3] < r[2].date()]
        assert got[r[0]] == (len(earlier), sum(q[4] for q in earlier))
    flipped = df.withColumn("no_show", F.when(F.col("appointment_date") >= "2030-01-20", 1 - F.col("no_show")).otherwise(F.col("no_show")))
    again = {r["id"]: (r["prev_appointments"], r["prev_no_shows"]) for r in history_asof(flipped).where(F.to_date("scheduled_at") <= "2030-01-20").collect()}
    assert all(got[i] == v for i, v in again.items()) and again
    assert before_booking(df).count() == 0


def test_an_appointment_before_its_booking_fails(spark):
    from datetime import datetime

    row = (1, 1, datetime(2016, 5, 3), datetime(2016, 5, 2), 1)
    df = spark.createDataFrame([row], "id long, patient_id long, scheduled_at timestamp, appointment_date timestamp, no_show int")
    with pytest.raises(Exception, match="before its booking"):
        history_asof(df).collect()


def test_feature_mismatch_treats_null_as_equal(spark):
    a = spark.createDataFrame([(1, 0.5), (2, None), (3, 1.0)], "k long, f double")
    b = spark.createDataFrame([(1, 0.5), (2, None), (3, 2.0), (4, 0.0)], "k long, f double")
    assert {r["k"] for r in feature_mismatches(a, b, "k", ["f"]).collect()} == {3, 4}
    assert feature_mismatches(a, a, "k", ["f"]).count() == 0


@pytest.mark.parametrize("born,on,age", [("1990-06-15", "2016-06-14", 25), ("1990-06-15", "2016-06-15", 26), ("2000-02-29", "2001-02-28", 0),
                                         ("2000-02-29", "2001-03-01", 1), ("2020-01-01", "2019-01-01", None)])
def test_age_in_completed_years(spark, born, on, age):
    assert spark.range(1).select(C.age_in_years(F.lit(born).cast("date"), F.lit(on).cast("date")).alias("a")).first()["a"] == age


def test_bands_are_right_closed_and_risk_bands_half_open(spark):
    df = spark.createDataFrame([(v,) for v in (-1, 0, 1, 3, 4, 30, 31, None)], "v int")
    got = [r[0] for r in df.select(C.right_closed_band(F.col("v"), C.LEAD_BANDS)).collect()]
    assert got == [None, "0 (same day)", "1-3", "1-3", "4-7", "15-30", "31+", None]
    risk = spark.createDataFrame([(v,) for v in (0.18, 0.19, 0.37, 0.38, None)], "v double")
    assert [r[0] for r in risk.select(C.risk_band(F.col("v"), 0.19, 0.38)).collect()] == ["low", "medium", "medium", "high", None]


def test_text_and_number_helpers(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first()["x"]
    assert pick(C.minutes_text(F.lit(61))) == "2 minutes" and pick(C.minutes_text(F.lit(1))) == "1 minute"
    assert pick(C.status_label(F.lit("no_show"))) == "No show"
    assert pick(C.blank_to_null(F.lit("   "), 500)) is None and len(pick(C.blank_to_null(F.lit("x" * 600), 500))) == 500
    assert pick(C.normal_email(F.lit("  A@B.Org "))) == "a@b.org"
    assert pick(C.signed_points(F.lit(-0.02))) == "-2.0" and pick(C.percent(F.lit(0.1852), 1)) == "18.5%"
    assert pick(C.thousands(F.lit(110527))) == "110,527"
    assert pick(C.shows_number(F.lit("AUC 0.7321."), "0.732")) is False and pick(C.shows_number(F.lit("AUC 0.732."), "0.732")) is True
    assert pick(C.t_975(F.lit(29))) == pytest.approx(2.045229642) and pick(C.t_975(F.lit(60))) == pytest.approx(2.000297822, abs=1e-6)


def test_wilson_ends(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (5, 10), (0, 0)], "k long, n long")
    got = df.select(C.wilson_low(F.col("k"), F.col("n")), C.wilson_high(F.col("k"), F.col("n"))).collect()
    assert got[0][0] == 0.0 and got[1][1] == 1.0 and got[3] == (None, None)
    assert got[2][0] == pytest.approx(0.2366, abs=1e-4) and got[2][1] == pytest.approx(0.7634, abs=1e-4)


RAW = "appointment_id long, patient_id double, sex string, scheduled_at timestamp_ntz, appointment_date timestamp_ntz, age int, no_show int"


def test_rules_apply_in_order_and_are_logged(spark):
    at = datetime.fromisoformat
    rows = [(1, 7.0, "F", at("2016-04-29T18:38:08"), at("2016-04-29"), 62, 0), (1, 7.0, "F", at("2016-04-29T18:38:08"), at("2016-04-29"), 62, 0),
            (2, 7.0, "F", at("2016-04-29T18:38:08"), at("2016-04-29"), 62, 0), (3, 7.5, "M", at("2016-04-29"), at("2016-05-02"), -1, 1),
            (4, 8.0, "M", at("2016-04-29"), at("2016-05-02"), 115, 1), (5, 8.0, "M", at("2016-05-03"), at("2016-05-02"), 50, 1)]
    raw = spark.createDataFrame(rows, RAW)
    log = {r["rule"]: (r["rows_before"], r["rows_after"], r["rows_changed"]) for r in cleaning.visit_log(raw, "t").collect()}
    assert log == {"drop_non_integer_patient_id": (6, 5, 1), "drop_impossible_age": (5, 4, 1), "drop_appointment_before_scheduled": (4, 3, 1),
                   "drop_exact_duplicates": (3, 2, 1), "report_duplicates_ignoring_appointment_id": (2, 2, 1)}
    clean = cleaning.clean_visits(raw)
    assert {r["appointment_id"] for r in clean.collect()} == {1, 2} and dict(clean.dtypes)["patient_id"] == "bigint"
    assert clean.first()["appt_weekday"] == 4 and clean.first()["lead_days"] == 0
    with pytest.raises(Exception, match="too large"):
        cleaning.clean_visits(raw.withColumn("patient_id", F.lit(2.0 ** 53))).collect()


def test_tasks_follow_the_visits_of_a_large_table(spark, tmp_path, monkeypatch):
    """Each task joins and cleans few visits, also where shuffle partitions are fewer; the rows are those of merged partitions."""
    from visitlake.plans import views

    day = F.lit("1995-01-01").cast("timestamp_ntz")
    tables = {
        "customer": spark.range(30).select(F.col("id").alias("c_custkey"), F.lit("FIELD").alias("c_mktsegment")),
        "orders": spark.range(200).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") % 50 > 0, F.col("id") % 30).alias("o_custkey"), day.alias("o_orderdate")),
        "lineitem": spark.range(800).select(
            F.when(F.col("id") % 97 > 0, F.col("id") % 200).alias("l_orderkey"), (F.col("id") % 3).cast("int").alias("l_linenumber"), (F.col("id") % 51).cast("double").alias("l_quantity"),
            F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"), F.when(F.col("id") % 4 > 0, "R").otherwise("A").alias("l_returnflag"), day.alias("l_shipdate")),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    merged = sorted(views.visits(spark, str(tmp_path)).collect())
    monkeypatch.setattr(views, "TASK_ROWS", 20, raising=False)
    split = views.visits(spark, str(tmp_path))
    assert split.rdd.getNumPartitions() == 40
    assert sorted(split.collect()) == merged and len(merged) > 300
