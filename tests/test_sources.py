import hashlib

import pytest
from pyspark.sql import functions as F

from visitlake.operators import cleaning
from visitlake.schemas import OPENML_NAMES
from visitlake.sources import readers, sinks, synthetic

HEAD = "PatientId,AppointmentID,Gender,ScheduledDay,AppointmentDay,Age,Neighbourhood,Scholarship,Hipertension,Diabetes,Alcoholism,Handcap,SMS_received,No-show"
CODED = list(OPENML_NAMES) + ["reserva_mes_c", "show"]


def arff(rows):
    lines = ["% a comment", "@RELATION visits", *[f"@ATTRIBUTE {c} REAL" for c in CODED], "", "@DATA"]
    return "\n".join(lines + [",".join(map(str, r)) for r in rows]) + "\n"


def coded(show, **changes):
    row = dict.fromkeys(CODED, 1) | {"edad": 40, "sexo": 2, "reserva_hora_d": 9, "latencia": 3, "show": show} | changes
    return [row[c] for c in CODED]


def test_visit_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(f"{HEAD}\n29872499824296,5000000,F,2016-04-29T18:38:08Z,2016-04-29T00:00:00Z,62,JARDIM,0,1,0,0,0,0,No\n"
                    "7.5,5000001,M,2016-04-29T18:38:08Z,2016-05-02T00:00:00Z,30,JARDIM,0,1,0,0,0,0,Yes\n")
    rows = readers.read_visits_csv(spark, str(path))
    first = rows.orderBy("appointment_id").first()
    assert first["patient_id"] == 29872499824296.0 and str(first["scheduled_at"]) == "2016-04-29 18:38:08" and first["no_show"] == 0
    assert {r["appointment_id"] for r in cleaning.clean_visits(rows).collect()} == {5000000}
    path.write_text(f"{HEAD}\n1,5000000,F,2016-04-29T18:38:08Z,2016-04-29T00:00:00Z,62,J,0,1,0,0,0,0,Maybe\n")
    with pytest.raises(Exception, match="No-show"):
        readers.read_visits_csv(spark, str(path)).collect()


def test_visit_arff_has_the_opposite_polarity(spark, tmp_path):
    path = tmp_path / "a.arff"
    path.write_text(arff([coded(1), coded(0, edad=50), coded(0, edad=50), coded(1, edad=200), coded(1, latencia=-1), coded(1, reserva_hora_d=5)]))
    raw = readers.read_visits_arff(spark, str(path))
    clean = cleaning.clean_coded(raw, OPENML_NAMES)
    assert sorted((r["age"], r["no_show"], r["sex"], r["appt_weekday"]) for r in clean.collect()) == [(40, 0, "F", 0), (40, 0, "F", 0), (50, 1, "F", 0)]
    log = {r["rule"]: r["rows_changed"] for r in cleaning.coded_log(raw, OPENML_NAMES, "coded").collect()}
    assert log == {"drop_negative_lead_days": 1, "drop_impossible_age": 1, "drop_exact_duplicates": 1, "report_hours_outside_clinic_hours": 1}
    path.write_text(arff([coded(2)]))
    with pytest.raises(Exception, match="show"):
        readers.read_visits_arff(spark, str(path)).collect()


def test_consultations(spark, tmp_path):
    path = tmp_path / "d.csv"
    head = "ID,Session,Month,DayOfWeek,WorkingDay,AM_PM,Visit.No,Gender,M.Cancer,S.Cancer,StartTime,PayTime,Address,ServTime"
    rows = [f"H{i},1,January,Wednesday,TRUE,morning,7,F,TRUE,FALSE,8:31:40,8:44:28,Out,{s}" for i, s in enumerate(["691", "oops", "0", "20000"])]
    path.write_text("\n".join([head, *rows]) + "\n")
    raw = readers.read_consultations_csv(spark, str(path))
    clean = cleaning.clean_consultations(raw).collect()
    assert [(r["service_seconds"], round(r["service_minutes"], 4)) for r in clean] == [(691, 11.5167)]
    assert {r["rule"]: r["rows_changed"] for r in cleaning.consultation_log(raw, "c").collect()} == {
        "drop_missing_or_nonpositive_service_time": 2, "drop_service_time_above_limit": 1, "drop_exact_duplicates": 0}


def test_fingerprints_and_tables(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_bytes(b"abc")
    got = readers.fingerprints(spark, str(path)).first()
    assert got["sha256"] == hashlib.sha256(b"abc").hexdigest() and got["bytes"] == 3
    df = spark.createDataFrame([(1, 2, 3.0, 4)], "z int, n int, auc_roc double, model int")
    sinks.write_table(df, str(tmp_path / "out"), "csv")
    described = readers.describe_files(spark.read.schema("z int, n int, auc_roc double, model int").option("header", True).csv(str(tmp_path / "out")))
    assert described.first()["rows"] == 1 and described.first()["columns"] == 4


def test_synthetic_visits_are_repeatable(spark):
    a = synthetic.synthetic_visits(spark, 50, 2000, hot_share=0.33)
    again = synthetic.synthetic_visits(spark, 50, 2000, hot_share=0.33)
    assert a.exceptAll(again).count() == 0
    assert 0.30 < a.where(F.col("patient_id") == 0).count() / 2000 < 0.40
    rate = a.where(F.col("patient_id") != 0).agg(F.avg("no_show")).first()[0]
    assert 0.08 < rate < 0.32 and a.where("appointment_date < to_date(scheduled_at)").count() == 0
