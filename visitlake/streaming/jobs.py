"""Structured Streaming forms of the operators: daily counts, login lockout, standby notices, scoring after booking."""
from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.attempts import ADDRESS_LIMIT, PAIR_LIMIT, Lockout
from ..operators.upsert import merge_versions


def table_stream(spark: SparkSession, schema: str, path: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


# ---- daily counts ---------------------------------------------------------------------------------------------
def daily_counts(events: DataFrame, ts: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    """Rows and value per day and key as tumbling windows; on a stream, rows later than the watermark are dropped.

    Watermarks need a zoned timestamp, so on a stream the local time is cast (the session time zone must be UTC there).
    """
    timed = events.withColumn("__at", F.col(ts).cast("timestamp") if watermark else F.col(ts))
    if watermark:
        timed = timed.withWatermark("__at", watermark)
    return (timed.groupBy(F.window("__at", "1 day").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
            .select(F.to_date(F.col("w.start")).alias("day"), *keys, "n", "total"))


# ---- lockout --------------------------------------------------------------------------------------------------
LOCKOUT_OUT = "address string, email string, at_us long, attempt_id long, verdict string, wait_us long"
LOCKOUT_STATE = "failures string"


def lockout_stream(attempts: DataFrame, window_us: int, pair_limit: int = PAIR_LIMIT, address_limit: int = ADDRESS_LIMIT,
                   expire: bool = True) -> DataFrame:
    """The verdict of each try, with state kept per address between micro-batches.

    attempts(address string, email string, at_us long, attempt_id long, ok boolean). The state holds failure times inside the window
    and never more than the limits allow, since refused tries are not recorded. Tries of a micro-batch are put in time order first.
    An address without failures has no state, and one that has been silent for a window of processing time loses it. `expire` turns
    that clock off for runs that drain what is there and stop: waiting for it would keep them open.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        lock = Lockout(window_us, pair_limit, address_limit)
        if state.exists:
            lock.restore(json.loads(state.get[0]))
        rows = pd.concat(list(chunks)).sort_values(["at_us", "attempt_id"])  # one address in one micro-batch
        verdicts = [lock.attempt(e, int(t), bool(ok)) for e, t, ok in zip(rows["email"], rows["at_us"], rows["ok"])]
        lock.forget_old(int(rows["at_us"].iloc[-1]))
        if lock.address or lock.emails:
            state.update((json.dumps(lock.dump()),))
            if expire:
                state.setTimeoutDuration(max(1, window_us // 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"address": key[0], "email": rows["email"], "at_us": rows["at_us"], "attempt_id": rows["attempt_id"],
                            "verdict": [v for v, _ in verdicts], "wait_us": [w for _, w in verdicts]})

    clock = GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    return attempts.groupBy("address").applyInPandasWithState(step, LOCKOUT_OUT, LOCKOUT_STATE, "append", clock)


# ---- standby notices -------------------------------------------------------------------------------------------
def standby_notices(changes: DataFrame, standby: DataFrame) -> DataFrame:
    """Who hears about a freed slot: cancelled or reopened slots joined with the standby list of that doctor and day.

    Entries stay on the list until the patient books; several freed slots give several notices.
    """
    freed = changes.where((F.col("status") == "cancelled") & F.col("from_status").isin("confirmed", "closed"))
    return (freed.select("doctor_id", "slot_date", "slot_id", "slot_start")
            .join(standby.select("standby_id", "patient_id", "doctor_id", "slot_date"), ["doctor_id", "slot_date"])
            .select("standby_id", "patient_id", "doctor_id", "slot_date", "slot_id", "slot_start"))


STANDBY_OUT = "doctor_id long, slot_date date, slot_id long, patient_id long, place int, at_us long, event_id long"


def standby_stream(events: DataFrame) -> DataFrame:
    """The notices of a stream of events, with the waiting list of each doctor and day kept as state.

    events(doctor_id long, slot_date date, kind string, patient_id long, slot_id long, at_us long, event_id long). `join` puts a patient on
    the list once, `leave` and `booked` take them off, `freed` tells everyone on it, in the order they joined; they stay on the list. Of
    one moment, events go by event_id. A list without patients has no state. Unknown kinds change nothing.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting: list[int] = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(chunks)).sort_values(["at_us", "event_id"])  # one doctor's day in one micro-batch
        told = []
        for kind, patient, slot, at, event in zip(rows["kind"], rows["patient_id"], rows["slot_id"], rows["at_us"], rows["event_id"]):
            if kind == "join" and int(patient) not in waiting:
                waiting.append(int(patient))
            elif kind in ("leave", "booked") and patient == patient and int(patient) in waiting:
                waiting.remove(int(patient))
            elif kind == "freed":
                told += [(key[0], key[1], int(slot), p, place, int(at), int(event)) for place, p in enumerate(waiting, 1)]
        if waiting:
            state.update((json.dumps(waiting),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(told, columns=[c.split()[0] for c in STANDBY_OUT.split(", ")])

    return events.groupBy("doctor_id", "slot_date").applyInPandasWithState(step, STANDBY_OUT, "waiting string", "append", GroupStateTimeout.NoTimeout)


# ---- scoring after the booking ------------------------------------------------------------------------------------
def start_scoring(bookings: DataFrame, features: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], out: str,
                  checkpoint: str, version: str):
    """Score every micro-batch of new bookings into `out`/scores and unusable rows into `out`/rejects; the bookings are untouched.

    Each batch overwrites its own folder, so a repeated batch writes the same rows once. `current_scores` reads the newest per key.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        ready = features(batch).persist()
        try:
            usable = score(ready.where(F.col("usable") == 1))
            p = F.col("no_show_probability")
            good = F.coalesce((p > 0) & (p < 1), F.lit(False))
            stamped = usable.select("booking_id", p, F.lit(version).alias("model_version"), good.alias("__good"))
            (stamped.where("__good").drop("__good").write.mode("overwrite").parquet(f"{out}/scores/batch={batch_id}"))
            refused = ready.where(F.col("usable") == 0).select("booking_id", F.lit("refused").alias("reason"))
            (refused.unionByName(stamped.where(~F.col("__good")).select("booking_id", F.lit("probability").alias("reason")))
             .write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}"))
        finally:
            ready.unpersist()

    return bookings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_scores(spark: SparkSession, out: str) -> DataFrame:
    """One row per booking: the score of its newest batch."""
    schema = "booking_id long, no_show_probability double, model_version string, batch long"
    return merge_versions(spark.read.schema(schema).parquet(f"{out}/scores"), ["booking_id"], [F.col("batch")])


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet", timeout: int = 300):
    """Drain the available input into files and stop."""
    query = (stream.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream did not finish in {timeout} s")
    return query

