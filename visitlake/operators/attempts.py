"""Failed attempts: counts in a sliding window, and the lockout that refuses tries while a key is blocked."""
from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .running import _null_safe_left, hot_rows, large_keys, run_max, run_sum, running

# fixed values: limits per email and address, per address, and the window
PAIR_LIMIT, ADDRESS_LIMIT, WINDOW_SECONDS = 5, 20, 15 * 60


def failures_within(df: DataFrame, keys: Sequence[str], at: str, failed: str, window_us: int, name: str = "n_failures") -> DataFrame:
    """Failures of the key in (at - window, at], for every row. It does not know that blocked tries are not recorded.

    With no large key this is one window over a range of times. Otherwise the count is the difference of two running counts, at `at` and
    at `at - window`, which split like any running value. NULL keys are a key; rows whose time is NULL count the failures of that key
    without a time.
    """
    keys = list(keys)
    hit = F.when(F.col(failed), 1).otherwise(0).cast("long")
    if isinstance(df.schema[at].dataType, T.IntegralType) and large_keys(df, keys, hot_rows(df)).isEmpty():
        return df.withColumn(name, F.sum(hit).over(Window.partitionBy(*keys).orderBy(at).rangeBetween(1 - window_us, Window.currentRow)))
    marks = df.select(*keys, F.inline(F.array(F.struct(F.col(at).alias("__t"), hit.alias("__n")),
                                              F.struct((F.col(at) - window_us).alias("__t"), F.lit(0).cast("long").alias("__n")))))
    line = running(marks.groupBy(*keys, "__t").agg(F.sum("__n").alias("__n")), keys, ["__t"], {"__upto": run_sum(F.col("__n"))}).drop("__n")
    now = line.withColumnRenamed("__upto", "__now").withColumnRenamed("__t", at)
    then = line.where(F.col("__t").isNotNull()).select(*keys, (F.col("__t") + window_us).alias(at), F.col("__upto").alias("__then"))
    both = _null_safe_left(_null_safe_left(df, now, [*keys, at]), then, [*keys, at])
    return both.withColumn(name, F.col("__now") - F.coalesce("__then", F.lit(0))).drop("__now", "__then")


class Lockout:
    """The accepted failures of one address: a ring of the newest ones of the address, and one for each email that has any.

    A ring holds as many times as its limit, so it is full exactly when the limit was reached, and blocks for as long as its oldest
    time is inside the window. Emails are kept in the order of their newest failure and leave when that has aged out, so the state
    is bounded by what failed within one window and, at the address limit, by that limit.
    """

    def __init__(self, window: int, pair_limit: int = PAIR_LIMIT, address_limit: int = ADDRESS_LIMIT) -> None:
        self.window, self.pair_limit = window, pair_limit
        self.address = deque(maxlen=address_limit)
        self.emails: OrderedDict[str, deque] = OrderedDict()

    def _blocked_for(self, ring: deque | None, now: int) -> int:
        full = ring is not None and len(ring) == ring.maxlen
        return max(0, ring[0] + self.window - now) if full else 0

    def attempt(self, email: str, now: int, ok: bool) -> tuple[str, int]:
        """(accepted | failed | refused, microseconds to wait). A refused try leaves no trace; a success clears its email only."""
        self.forget_old(now)
        ring = self.emails.get(email)
        wait = max(self._blocked_for(ring, now), self._blocked_for(self.address, now))
        if wait:
            return "refused", wait
        if ok:
            self.emails.pop(email, None)
            return "accepted", 0
        if ring is None:
            ring = self.emails[email] = deque(maxlen=self.pair_limit)
        ring.append(now)
        self.emails.move_to_end(email)
        self.address.append(now)
        return "failed", 0

    def forget_old(self, now: int) -> None:
        while self.emails:
            email, ring = next(iter(self.emails.items()))
            if ring[-1] + self.window > now:
                break
            del self.emails[email]
        if self.address and self.address[-1] + self.window <= now:
            self.address.clear()

    def dump(self) -> dict:
        return {"address": list(self.address), "emails": [[e, list(r)] for e, r in self.emails.items()]}

    def restore(self, saved: dict) -> None:
        self.address.extend(saved["address"])
        for email, times in saved["emails"]:
            self.emails[email] = deque(times, maxlen=self.pair_limit)


def login_lockout(attempts: DataFrame, window_us: int, pair_limit: int = PAIR_LIMIT, address_limit: int = ADDRESS_LIMIT) -> DataFrame:
    """Verdict of every try in attempts(address, email, at_us, attempt_id, ok), in time order per address.

    A try depends on the failures before it. An address is cut wherever no try failed for a whole window: only failures leave state,
    so the pieces are independent. A piece with fewer failing tries than the smaller limit can refuse nothing, and its verdicts are
    an expression. Only the other pieces are walked, sorted and as a stream, with one address state of bounded size.
    """
    order = ["at_us", "attempt_id"]
    failed_at = F.when(~F.col("ok"), F.col("at_us"))
    gaps = running(attempts, ["address"], order, {"__last": run_max(failed_at, before=True)})
    fresh = (F.col("__last").isNull() | (F.col("at_us") - F.col("__last") >= window_us)).cast("long")
    pieces = running(gaps.withColumn("__fresh", fresh), ["address"], order, {"__piece": run_sum(F.col("__fresh"))})
    ready = pieces.select("address", "__piece", "email", "at_us", "attempt_id", "ok")
    failing = ready.groupBy("address", "__piece").agg(F.count_if(~F.col("ok")).alias("__failing"))
    counted = _null_safe_left(ready, failing, ["address", "__piece"])
    may_block = F.col("__failing") >= min(pair_limit, address_limit)
    calm = counted.where(~may_block).select("address", "email", "at_us", "attempt_id", F.when(F.col("ok"), "accepted").otherwise("failed").alias("verdict"),
                                            F.lit(0).cast("long").alias("wait_us"))
    walked = counted.where(may_block).drop("__failing").repartition("address", "__piece").sortWithinPartitions("address", "__piece", "at_us", "attempt_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, Lockout(window_us, pair_limit, address_limit)
        for batch in batches:
            verdicts, waits = [], []
            for address, piece, email, at, ok in zip(batch["address"], batch["__piece"], batch["email"], batch["at_us"], batch["ok"]):
                if (address, piece) != current:
                    current, state = (address, piece), Lockout(window_us, pair_limit, address_limit)
                verdict, wait = state.attempt(email, at, ok)
                verdicts.append(verdict)
                waits.append(wait)
            yield pd.DataFrame({"address": batch["address"], "email": batch["email"], "at_us": batch["at_us"], "attempt_id": batch["attempt_id"],
                                "verdict": verdicts, "wait_us": waits})

    kinds = dict(attempts.dtypes)
    return calm.unionByName(walked.mapInPandas(walk, f"address {kinds['address']}, email {kinds['email']}, at_us long, attempt_id long, verdict string, wait_us long"))
