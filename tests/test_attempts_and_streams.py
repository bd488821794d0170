import random

import pytest
from pyspark.sql import functions as F

from visitlake.operators.attempts import Lockout, failures_within, login_lockout
from visitlake.streaming import jobs

MINUTE = 60_000_000
TRIES = "address string, email string, at_us long, attempt_id long, ok boolean"


def test_five_failures_block_for_the_window():
    lock = Lockout(15 * MINUTE)
    for _ in range(5):
        assert lock.attempt("a", 0, False)[0] == "failed"
    for i in range(10):
        assert lock.attempt("a", MINUTE, False)[0] == "refused"
    assert lock.attempt("a", 14 * MINUTE + 50_000_000, True) == ("refused", 10_000_000)
    assert lock.attempt("a", 15 * MINUTE + 10_000_000, True)[0] == "accepted"


def test_a_hundred_thousand_emails_leave_nothing_behind():
    lock = Lockout(15 * MINUTE)
    for i in range(100_000):
        lock.attempt(f"e{i}", i * MINUTE, False)
        assert len(lock.emails) <= 16 and len(lock.address) <= 20


def test_an_address_that_is_never_idle(spark):
    data = [("x", f"x{i % 40}", i * MINUTE, i, i % 3 > 0) for i in range(600)]
    got = {r["attempt_id"]: (r["verdict"], r["wait_us"]) for r in login_lockout(spark.createDataFrame(data, TRIES), 15 * MINUTE).collect()}
    assert got == expected(data)


def test_address_limit_spans_emails_and_success_clears_only_its_email():
    lock = Lockout(15 * MINUTE)
    for i in range(20):
        assert lock.attempt(f"e{i}", i, False)[0] == "failed"
    assert lock.attempt("fresh", 30, True)[0] == "refused"
    other = Lockout(15 * MINUTE)
    for i in range(4):
        other.attempt("a", i, False)
    assert other.attempt("a", 5, True)[0] == "accepted"
    assert [other.attempt("a", 6 + i, False)[0] for i in range(6)] == ["failed"] * 5 + ["refused"]


def tries(n=400, seed=4):
    rng, at, out = random.Random(seed), {}, []
    for i in range(n):
        address = rng.choice(["x", "x", "x", "y"])
        at[address] = at.get(address, 0) + rng.choice([1, 1, 1, 2, 3, 40]) * MINUTE // 2
        out.append((address, f"{address}{rng.randint(0, 2)}", at[address], i, rng.random() < 0.15))
    return out


def expected(data):
    locks, out = {}, {}
    for address, email, at, i, ok in sorted(data, key=lambda r: (r[2], r[3])):
        out[i] = locks.setdefault(address, Lockout(15 * MINUTE)).attempt(email, at, ok)
    return out


def test_batch_lockout_equals_a_loop(spark, cut_groups):
    data = tries()
    got = {r["attempt_id"]: (r["verdict"], r["wait_us"]) for r in login_lockout(spark.createDataFrame(data, TRIES), 15 * MINUTE).collect()}
    assert got == expected(data) and {v for v, _ in got.values()} == {"accepted", "failed", "refused"}


def test_stream_lockout_equals_a_loop_across_micro_batches(spark, tmp_path):
    data = sorted(tries(200), key=lambda r: (r[2], r[3]))
    source = str(tmp_path / "in")
    for part in range(0, 200, 50):
        spark.createDataFrame(data[part:part + 50], TRIES).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.table_stream(spark, TRIES, source, files_per_trigger=1)
    jobs.run_to_end(jobs.lockout_stream(stream, 15 * MINUTE, expire=False), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["attempt_id"]: (r["verdict"], r["wait_us"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == expected(data)


@pytest.mark.parametrize("limit", ["1000000", "20"])
def test_window_count_has_an_open_lower_edge(spark, limit):
    from visitlake.operators.running import HOT_ROWS_CONF

    spark.conf.set(HOT_ROWS_CONF, limit)
    try:
        rng = random.Random(3)
        rows = [("k", rng.randint(0, 300), rng.random() < 0.5) for _ in range(150)]
        got = failures_within(spark.createDataFrame(rows, "k string, at long, failed boolean"), ["k"], "at", "failed", 20).collect()
        assert len(got) == 150
        for r in got:
            assert r["n_failures"] == sum(f for _, t, f in rows if r["at"] - 20 < t <= r["at"])
    finally:
        spark.conf.unset(HOT_ROWS_CONF)


def test_daily_counts_as_a_stream(spark, tmp_path):
    from visitlake.plans.views import table
    from visitlake.schemas import TABLES

    events = table(spark, "/root/testdata/sf0.001", "events")
    source = str(tmp_path / "in")
    events.orderBy("ts").coalesce(1).write.parquet(source)
    stream = jobs.table_stream(spark, TABLES["events"], source)
    jobs.run_to_end(jobs.daily_counts(stream, "ts", ["event_type"], "1 day"), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = {(r["day"], r["event_type"]): r["n"] for r in jobs.daily_counts(events, "ts", ["event_type"]).collect()}
    got = {(r["day"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and all(batch[k] == n for k, n in got.items())
    assert max(d for d, _ in batch) not in {d for d, _ in got}  # the last day is still open


def test_scoring_stream_keeps_the_newest_score_and_the_rejects(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "booking_id long, x double, usable int"
    spark.createDataFrame([(1, 0.2, 1), (2, 1.0, 1), (3, 0.5, 0)], schema).coalesce(1).write.parquet(source)

    def start(cp):
        stream = jobs.table_stream(spark, schema, source, files_per_trigger=1)
        q = jobs.start_scoring(stream, lambda d: d, lambda d: d.withColumn("no_show_probability", F.col("x")), out, cp, "v1")
        assert q.awaitTermination(120)

    start(str(tmp_path / "cp"))
    spark.createDataFrame([(1, 0.7, 1)], schema).coalesce(1).write.mode("append").parquet(source)
    start(str(tmp_path / "cp"))
    assert {(r["booking_id"], r["no_show_probability"]) for r in jobs.current_scores(spark, out).collect()} == {(1, 0.7)}
    assert {(r["booking_id"], r["reason"]) for r in spark.read.parquet(f"{out}/rejects").collect()} == {(2, "probability"), (3, "refused")}


def test_batch_scores_use_a_history_snapshot(spark):
    """New bookings take their history from the table of known outcomes, not from the batch."""
    from datetime import date, datetime

    from visitlake.operators.risk import deployable_features

    schema = "booking_id long, patient_id long, created_at timestamp_ntz, slot_date date, status string"
    past = spark.createDataFrame([(1, 9, datetime(2030, 1, 1), date(2030, 1, 5), "no_show"), (2, 9, datetime(2030, 1, 1), date(2030, 1, 9), "completed"),
                                  (3, 9, datetime(2030, 1, 1), date(2030, 1, 8), "cancelled")], schema)
    new = spark.createDataFrame([(10, 9, datetime(2030, 1, 10, 8), date(2030, 1, 14), "confirmed"), (11, 9, datetime(2030, 1, 9), date(2030, 1, 8), "confirmed"),
                                 (12, 8, datetime(2030, 1, 9), date(2030, 1, 9), "confirmed")], schema)
    profiles = spark.createDataFrame([(9, date(1990, 1, 15), "F")], "patient_id long, date_of_birth date, sex string")
    got = {r["booking_id"]: r for r in deployable_features(new, profiles, past).collect()}
    assert set(got) == {10, 11}  # patient 8 has no profile
    r = got[10]
    assert (r["age"], r["is_female"], r["lead_days"], r["appt_weekday"], r["prev_appointments"], r["prev_no_show_rate"], r["usable"]) == (39, 1, 4, 0, 2, 0.5, 1)
    assert got[11]["usable"] == 0 and got[11]["age"] is None
