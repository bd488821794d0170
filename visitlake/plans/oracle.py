"""SQL text of the clinic tables, for checking the DataFrame plans in another engine."""
from __future__ import annotations

from ..functions.columns import T_975
from .views import CALENDAR_DAYS, CALENDAR_START, DOCTOR_USER_BASE, NOW

NOW_SQL = f"TIMESTAMP '{NOW}'"

_KEY = "CAST({d} * 10000000 + (CAST({day} AS DATE) - DATE '1990-01-01') * 96 + CAST(FLOOR({m} / 15) AS BIGINT) AS BIGINT)"

VIEWS = {
    "doctors": f"""SELECT s_suppkey AS doctor_id, s_suppkey + {DOCTOR_USER_BASE} AS user_id, n_name AS specialization,
        CAST(15 + 5 * (s_suppkey % 4) AS INTEGER) AS slot_minutes FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "patients": """SELECT c_custkey AS patient_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
        DATE '1930-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER) AS date_of_birth, c_mktsegment AS neighbourhood FROM customer""",
    "users": f"""SELECT c_custkey AS user_id, c_name AS name, 'patient' AS role FROM customer
        UNION ALL SELECT s_suppkey + {DOCTOR_USER_BASE}, s_name, 'doctor' FROM supplier""",
    "bookings0": f"""SELECT o_orderkey AS booking_id, o_custkey AS patient_id,
        o_orderkey % (SELECT count(*) FROM supplier) AS doctor_id,
        DATE '{CALENDAR_START}' + CAST((CAST(o_orderdate AS DATE) - DATE '1995-01-01') % {CALENDAR_DAYS} AS INTEGER) AS slot_date,
        CAST(540 + 15 * (o_orderkey % 16) AS INTEGER) AS start_minute,
        CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'no_show' ELSE 'completed' END
            WHEN 'O' THEN 'confirmed' ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'closed' ELSE 'cancelled' END END AS status,
        CAST((o_orderkey * 13 + o_custkey * 7) % 45 AS INTEGER) AS ahead_days, CAST(o_orderkey % 600 AS INTEGER) AS created_minute FROM orders""",
    "bookings": f"""SELECT *, CASE WHEN status <> 'cancelled' THEN slot_id END AS active_slot_id FROM (
        SELECT booking_id, patient_id, doctor_id, slot_date, start_minute, status,
        CAST(slot_date AS TIMESTAMP) + to_minutes(start_minute) AS slot_start,
        CAST(slot_date - ahead_days AS TIMESTAMP) + to_minutes(created_minute) AS created_at,
        {_KEY.format(d='doctor_id', day='slot_date', m='start_minute')} AS slot_id FROM bookings0)""",
    "slots": f"""SELECT doctor_id, slot_date, start_minute, CAST(slot_date AS TIMESTAMP) + to_minutes(start_minute) AS slot_start,
        {_KEY.format(d='doctor_id', day='slot_date', m='start_minute')} AS slot_id FROM (
        SELECT doctor_id, slot_date, start_minute FROM bookings UNION SELECT doctor_id, slot_date, start_minute + 15 FROM bookings WHERE start_minute % 45 = 0)""",
    "risk_scores": """SELECT o_orderkey AS booking_id, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS no_show_probability,
        CASE WHEN o_orderkey % 10 < 8 THEN 'v1' ELSE 'v0' END AS model_version FROM orders WHERE o_orderkey % 3 <> 0""",
    "standby": f"""SELECT user_id AS patient_id, event_id % (SELECT count(*) FROM supplier) AS doctor_id,
        DATE '{CALENDAR_START}' + CAST(event_id * 7 % {CALENDAR_DAYS} AS INTEGER) AS slot_date,
        min(event_id) AS standby_id, min(ts) AS created_at FROM events GROUP BY 1, 2, 3""",
    "booking_log": """SELECT booking_id, epoch_us(slot_start) AS start_us, seq, status, at_us FROM (
        SELECT booking_id, slot_start, 1 AS seq, CASE WHEN status = 'closed' THEN 'closed' ELSE 'confirmed' END AS status,
          epoch_us(created_at) AS at_us FROM bookings
        UNION ALL SELECT booking_id, slot_start, 2, status, epoch_us(created_at) + (booking_id % 60) * 86400000000 FROM bookings
          WHERE status NOT IN ('confirmed', 'closed')
        UNION ALL SELECT booking_id, slot_start, 3, 'completed', epoch_us(slot_start) + 1800000000 FROM bookings WHERE booking_id % 7 = 0)""",
    "coded0": """SELECT CAST(l_suppkey % 9 AS BIGINT) AS specialty, CAST(o_custkey % 125 - 5 AS BIGINT) AS age, CASE WHEN o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
        month(l_shipdate) AS appt_month, isodow(l_shipdate) - 1 AS appt_weekday, CAST(5 + l_orderkey % 18 AS BIGINT) AS appt_hour,
        month(o_orderdate) AS booked_month, isodow(o_orderdate) - 1 AS booked_weekday, CAST(6 + 2 * l_linenumber AS BIGINT) AS booked_hour,
        CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) - 5 AS BIGINT) AS lead_days, CAST(1 + l_linenumber % 3 AS BIGINT) AS channel,
        CAST(1 + l_orderkey % 2 AS BIGINT) AS appt_type, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS no_show
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'A')""",
    "consultations0": """SELECT CAST(user_id AS VARCHAR) AS patient_code, strftime(ts, '%Y-%m-%d') AS session, CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS am_pm,
        CAST(event_id % 50 AS INTEGER) AS visit_no, CASE WHEN event_type <> 'error' THEN floor(value * 300) END AS service_seconds FROM events""",
    "raw_visits": """SELECT l_orderkey AS appointment_id,
        CAST(o_custkey AS DOUBLE) + CASE WHEN l_quantity = 50 THEN 0.5 ELSE 0.0 END AS patient_id,
        CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, o_orderdate AS scheduled_at, l_shipdate AS appointment_date,
        CAST(o_custkey % 125 - 5 AS INTEGER) AS age, c_mktsegment AS neighbourhood,
        CASE WHEN l_tax >= 0.06 THEN 1 ELSE 0 END AS scholarship, CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END AS hypertension,
        CASE WHEN l_tax = 0 THEN 1 ELSE 0 END AS diabetes, CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS alcoholism,
        l_linenumber % 3 AS handicap, l_linenumber % 2 AS sms_received,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS no_show
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag IN ('R', 'A')""",
    "visits": """SELECT DISTINCT appointment_id, CAST(patient_id AS BIGINT) AS patient_id, sex, scheduled_at,
        CAST(appointment_date AS DATE) AS appointment_date, age, neighbourhood, scholarship, hypertension, diabetes, alcoholism,
        handicap, sms_received, no_show, CAST(CAST(appointment_date AS DATE) - CAST(scheduled_at AS DATE) AS INTEGER) AS lead_days,
        CAST(isodow(appointment_date) - 1 AS INTEGER) AS appt_weekday FROM raw_visits
        WHERE patient_id % 1 = 0 AND age BETWEEN 0 AND 110 AND CAST(appointment_date AS DATE) >= CAST(scheduled_at AS DATE)""",
    "scored": """SELECT o_custkey AS patient_id, l_linenumber AS fold, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
        0.2::DOUBLE * CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END
          + 0.7::DOUBLE * ((CAST(round(l_extendedprice * 100) AS BIGINT) * 7919 % 10007) / 10007.0::DOUBLE) + 0.05::DOUBLE AS p,
        (l_linenumber % 4 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / 8.0::DOUBLE + l_discount * 2 AS p2
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'A')""",
    "sessions": """SELECT CAST(ts AS DATE) AS day, CAST(floor(hour(ts) / 12) AS INTEGER) AS half_day, epoch_us(ts) AS at_us, event_id,
        CAST(hour(ts) % 12 * 60 + minute(ts) AS DOUBLE) AS arrival, value AS service, event_type <> 'error' AS attends,
        (event_id * 7919 % 1000) / 1000.0::DOUBLE AS risk FROM events""",
}
_NEEDS = {"bookings": ["bookings0"], "slots": ["bookings"], "booking_log": ["bookings"], "visits": ["raw_visits"]}


def with_views(names: list[str], body: str) -> str:
    """`body` behind the WITH clauses of the named clinic tables and what they are built from."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body
    clauses = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in ordered)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {clauses},\n{body[5:]}"
    return f"WITH {clauses}\n{body}"


def day_text(expr: str, name: str) -> str:
    return f"CAST(CAST({expr} AS DATE) AS VARCHAR) AS {name}"


def time_text(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name}"


def num(expr: str, name: str) -> str:
    """Six decimals, nudged like catalog.present so that a decimal tie rounds the same way in both engines."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-9::DOUBLE, 6) + 0.0::DOUBLE AS {name}"


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def wilson(k: str, n: str) -> tuple[str, str]:
    """SQL text of the two ends of the Wilson interval."""
    z = "1.959964::DOUBLE"
    p = f"(CAST({k} AS DOUBLE) / {n})"
    centre = f"({p} + {z} * {z} / (2 * {n}))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0::DOUBLE * {n} * {n})))"
    low = f"CASE WHEN {n} = 0 THEN NULL WHEN {k} = 0 THEN 0.0 ELSE greatest(0.0, ({centre} - {half}) / (1 + {z} * {z} / {n})) END"
    high = f"CASE WHEN {n} = 0 THEN NULL WHEN {k} = {n} THEN 1.0 ELSE least(1.0, ({centre} + {half}) / (1 + {z} * {z} / {n})) END"
    return low, high


def t_975(df: str) -> str:
    table = "[" + ", ".join(f"{v}::DOUBLE" for v in T_975) + "]"
    x = "1.959963985::DOUBLE"
    series = (f"({x} + (pow({x},3) + {x}) / 4 / ({df}) + (5*pow({x},5) + 16*pow({x},3) + 3*{x}) / 96 / pow({df}, 2)"
              f" + (3*pow({x},7) + 19*pow({x},5) + 17*pow({x},3) - 15*{x}) / 384 / pow({df}, 3)"
              f" + (79*pow({x},9) + 776*pow({x},7) + 1482*pow({x},5) - 1920*pow({x},3) - 945*{x}) / 92160 / pow({df}, 4))")
    return f"CASE WHEN ({df}) < 1 THEN NULL WHEN ({df}) <= 29 THEN ({table})[CAST({df} AS INTEGER)] ELSE {series} END"


def band(expr: str, bands) -> str:
    edges, labels = bands
    parts = [f"WHEN {expr} <= {edges[0]} THEN NULL"]
    parts += [f"WHEN {expr} <= {upper} THEN '{label}'" for upper, label in zip(edges[1:], labels)]
    return f"CASE {' '.join(parts)} WHEN {expr} IS NOT NULL THEN '{labels[-1]}' END"


def mix(seed: int, *parts: str) -> str:
    """The same whole-number mixing as functions.columns.mix."""
    prime = 2147483647
    h = f"{seed}::BIGINT"
    for part in parts:
        h = f"(({h} * 1103515245 + CAST({part} AS BIGINT) * 12345 + 42) % {prime})"
        h = square(h)
    for _ in range(2):
        h = square(h)
    return h


def square(h: str) -> str:
    # a list lambda names the operand once, so the text does not double with every round
    return f"list_transform([{h}], lambda v: (v * v + 48271) % 2147483647)[1]"
