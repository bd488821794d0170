"""Tables replaced bucket by bucket, leave as rows, the standby list as a stream, fingerprints in slices, groups of any type."""
import hashlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from visitlake.operators import bootstrap, schedule, upsert
from visitlake.sources.readers import fingerprints
from visitlake.streaming import jobs


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    old = spark.range(300).selectExpr("IF(id = 7, NULL, id) AS id", "'old' AS v")
    upsert.create_buckets(old, path, ["id"], 8)

    def files():
        return {str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*.parquet")}

    def rows():
        return sorted([(r["id"] is None, r["id"] or 0, r["v"]) for r in spark.read.parquet(path).collect()])

    before = files()
    new = spark.createDataFrame([(3, "new"), (None, "new"), (1_000, "new")], "id long, v string")
    upsert.replace_in_buckets(spark, path, new, ["id"], 8)
    touched = {r[0] for r in new.select(F.pmod(F.xxhash64("id"), F.lit(8))).collect()}
    assert {f for f in before - files()} == {f for f in before if any(f"bucket={b}/" in f for b in touched)} and before & files()
    want = sorted([(i == 7, 0 if i == 7 else i, "new" if i in (3, 7) else "old") for i in range(300)] + [(False, 1_000, "new")])
    assert rows() == want
    upsert.replace_in_buckets(spark, path, new, ["id"], 8)
    upsert.replace_in_buckets(spark, path, new.limit(0), ["id"], 8)
    assert rows() == want


def test_leave_written_twice_adds_nothing(spark):
    day, now = date(2030, 1, 7), F.lit(datetime(2030, 1, 1)).cast("timestamp_ntz")
    slots = spark.createDataFrame([(i, 1, day, datetime(2030, 1, 7, 9, 10 * i)) for i in range(1, 5)], "slot_id long, doctor_id long, slot_date date, slot_start timestamp_ntz")
    bookings = spark.createDataFrame([(50, 1, 9, "confirmed", day, 1, None), (51, 2, 9, "cancelled", day, 2, None)],
                                     "booking_id long, doctor_id long, patient_id long, status string, slot_date date, slot_id long, cancelled_at timestamp_ntz")
    bookings = bookings.withColumn("active_slot_id", F.when(F.col("status") != "cancelled", F.col("slot_id")))

    def active(df):
        return df.withColumn("active_slot_id", F.when(F.col("status") != "cancelled", F.col("slot_id")))

    def plan(b):
        return schedule.leave_plan(slots, b, F.lit(day), F.lit(day), now)

    rows = schedule.leave_rows(plan(bookings), now)
    counts = schedule.leave_counts(plan(bookings)).first()
    assert (counts["closed"], counts["booked"]) == (3, 1) and rows.count() == counts["closed"]
    once = active(schedule.write_rows(bookings, rows))
    twice = active(schedule.write_rows(once, rows))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and once.where("status = 'closed'").count() == 3
    assert schedule.leave_rows(plan(once), now).count() == 0  # a new plan finds nothing to close
    late = bookings.unionByName(spark.createDataFrame([(60, 1, 8, "confirmed", day, 3, None, 3)], bookings.schema))
    assert schedule.write_rows(late, rows).where("status = 'closed'").count() == 2  # a patient was faster
    opened = schedule.write_rows(once, schedule.reopen_rows(once, F.lit(day), F.lit(day), now))
    assert opened.where("status = 'closed'").count() == 0 and opened.where("status = 'confirmed'").count() == 1
    again = active(schedule.write_rows(active(opened), schedule.leave_rows(plan(active(opened)), now)))
    assert again.where("status = 'closed'").count() == 3 and again.count() == once.count()


EVENTS = "doctor_id long, slot_date date, kind string, patient_id long, slot_id long, at_us long, event_id long"


def test_standby_list_as_a_stream_with_a_restart(spark, tmp_path):
    day, other = date(2030, 1, 7), date(2030, 1, 8)
    first = [(1, day, "join", 10, None, 1, 1), (1, day, "join", 11, None, 2, 2), (1, day, "join", 10, None, 3, 3), (1, other, "join", 12, None, 3, 4),
             (1, day, "freed", None, 100, 4, 5)]
    second = [(1, day, "freed", None, 101, 5, 6), (1, day, "booked", 10, 101, 6, 7), (1, day, "freed", None, 102, 7, 8)]
    third = [(1, day, "leave", 11, None, 8, 9), (1, day, "freed", None, 103, 9, 10), (1, day, "booked", 99, 103, 9, 11), (1, other, "odd", 12, None, 9, 12)]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in (first, second, third):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        jobs.run_to_end(jobs.standby_stream(jobs.table_stream(spark, EVENTS, source)), out, checkpoint)  # each run starts anew from the state
    got = sorted((r["slot_id"], r["place"], r["patient_id"]) for r in spark.read.parquet(out).collect())
    assert got == [(100, 1, 10), (100, 2, 11), (101, 1, 10), (101, 2, 11), (102, 1, 11)]


def test_fingerprints_in_slices(spark, tmp_path):
    content = {"a.bin": b"1", "b c.bin": b"x" * 70_001, "d.bin": bytes(range(256)) * 999}
    for name, raw in content.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1].replace("%20", " "): (r["bytes"], r["sha256"]) for r in fingerprints(spark, f"file://{tmp_path}", slice_bytes=4_096).collect()}
    assert got == {n: (len(raw), hashlib.sha256(raw).hexdigest()) for n, raw in content.items()}


@pytest.mark.parametrize("kind", ["string", "long"])
def test_poisson_groups_of_any_type(spark, kind):
    ids = {"string": ["ann", "bob", None, "0"], "long": [0, 2 ** 31 - 1, None, -5]}[kind]
    rows = [(ids[i % 4], i % 2, (i * 37 % 100) / 100) for i in range(200)]
    frame = spark.createDataFrame(rows, f"g {kind}, y int, p double")
    numbered, _ = bootstrap._numbered(frame, "g", 10, "poisson")
    assert numbered.select("__gi").distinct().count() == 4
    residues = {r["__gi"] % bootstrap.MIX_PRIME for r in numbered.select("__gi").distinct().collect()}
    assert len(residues) == 4  # no two groups share their draws
    out = {r["metric"]: r for r in bootstrap.bootstrap_ci(frame, "y", "p", "g", 50, scheme="poisson").collect()}
    assert out["auc_roc"]["lo"] <= out["auc_roc"]["value"] <= out["auc_roc"]["hi"]
