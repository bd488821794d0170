"""Explicit schemas: nothing is inferred at read time."""
from __future__ import annotations

# the driver's tables, in DDL form
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                 "l_shipdate timestamp_ntz"),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# raw research files. The column names of the published files.
KAGGLE_RAW = ("PatientId string, AppointmentID bigint, Gender string, ScheduledDay string, AppointmentDay string, "
              "Age int, Neighbourhood string, Scholarship int, Hipertension int, Diabetes int, Alcoholism int, "
              "Handcap int, SMS_received int, `No-show` string")
KAGGLE_NAMES = {
    "PatientId": "patient_id", "AppointmentID": "appointment_id", "Gender": "sex", "ScheduledDay": "scheduled_at",
    "AppointmentDay": "appointment_date", "Age": "age", "Neighbourhood": "neighbourhood",
    "Scholarship": "scholarship", "Hipertension": "hypertension", "Diabetes": "diabetes",
    "Alcoholism": "alcoholism", "Handcap": "handicap", "SMS_received": "sms_received",
}
OPENML_NAMES = {
    "especialidad": "specialty", "edad": "age", "sexo": "sex", "reserva_mes_d": "appt_month",
    "reserva_dia_d": "appt_weekday", "reserva_hora_d": "appt_hour", "creacion_mes_d": "booked_month",
    "creacion_dia_d": "booked_weekday", "creacion_hora_d": "booked_hour", "latencia": "lead_days",
    "canal": "channel", "tipo": "appt_type",
}
HANGU_RAW = ("ID string, Session int, Month string, DayOfWeek string, WorkingDay string, AM_PM string, `Visit.No` int, "
             "Gender string, `M.Cancer` string, `S.Cancer` string, StartTime string, PayTime string, Address string, "
             "ServTime string")
HANGU_NAMES = {
    "ID": "patient_code", "Session": "session", "Month": "month", "DayOfWeek": "day_of_week",
    "WorkingDay": "working_day", "AM_PM": "am_pm", "Visit.No": "visit_no", "Gender": "sex", "M.Cancer": "m_cancer",
    "S.Cancer": "s_cancer", "StartTime": "start_time", "PayTime": "pay_time", "Address": "address",
    "ServTime": "service_seconds",
}

# fixed vocabularies
APPOINTMENT_STATUSES = ("confirmed", "completed", "no_show", "cancelled")
BANDS = ("low", "medium", "high")
