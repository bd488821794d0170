"""The skew-proof running operators against plain Python."""
import random
from statistics import quantiles

import pytest
from pyspark.sql import functions as F

from visitlake.operators.running import exact_percentiles, positions, previous, run_max, run_min, run_sum, running


def rows(n=600, seed=3):
    rng = random.Random(seed)
    # one key holds most rows, the others are small, one key is NULL
    return [(rng.choice(["hot"] * 6 + ["a", "b", "c", None]), rng.randint(-50, 50), i, rng.randint(-5, 9)) for i in range(n)]


def expected(data):
    groups = {}
    for r in data:
        groups.setdefault(r[0], []).append(r)
    out = {}
    for members in groups.values():
        members.sort(key=lambda r: (r[1], r[2]))
        total, top, low = 0, None, None
        for i, r in enumerate(members):
            total += r[3]
            before = top
            top = r[3] if top is None else max(top, r[3])
            low = r[3] if low is None else min(low, r[3])
            out[r[2]] = (i + 1, total, before, low, members[i - 1][3] if i else None)
    return out


@pytest.mark.parametrize("limit", ["1000000", "20", "8"])
def test_running_matches_a_loop(spark, limit):
    from visitlake.operators.running import HOT_ROWS_CONF

    spark.conf.set(HOT_ROWS_CONF, limit)
    try:
        data = rows()
        df = spark.createDataFrame(data, "k string, t long, id long, v long")
        got = running(df, ["k"], ["t", "id"], {"total": run_sum(F.col("v")), "top": run_max(F.col("v"), before=True),
                                               "low": run_min(F.col("v"))})
        got = positions(got, ["k"], ["t", "id"])
        got = previous(got, ["k"], ["t", "id"], ["v"])
        want = expected(data)
        seen = {r["id"]: (r["position"], r["total"], r["top"], r["low"], r["previous_v"]) for r in got.collect()}
        assert seen == want
    finally:
        spark.conf.unset(HOT_ROWS_CONF)


def test_a_global_order_is_cut_too(spark, cut_groups):
    df = spark.range(500).withColumn("v", (F.col("id") * 37) % 11)
    got = positions(df, [], ["v", "id"]).collect()
    order = sorted(((r["id"] * 37) % 11, r["id"]) for r in got)
    assert {r["id"]: r["position"] for r in got} == {i: n + 1 for n, (_, i) in enumerate(order)}


def test_percentiles_interpolate(spark, cut_groups):
    values = [((i * 7919) % 997) / 10 for i in range(300)] + [5.0] * 40
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_percentiles(df, "v", {"q10": 0.1, "q50": 0.5, "q90": 0.9, "q100": 1.0}).first()
    cuts = quantiles(values, n=10, method="inclusive")
    assert got["q10"] == pytest.approx(cuts[0])
    assert got["q50"] == pytest.approx(cuts[4])
    assert got["q90"] == pytest.approx(cuts[8])
    assert got["q100"] == max(values)


def test_percentiles_of_a_worked_case(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "v double")
    assert exact_percentiles(df, "v", {"p95": 0.95}).first()["p95"] == pytest.approx(8.8)


def test_every_large_key_is_cut_by_its_own_size(spark):
    """Forty keys at disjoint stretches of the order, and one whose key is NULL: no piece is much larger than the limit."""
    from visitlake.operators import running as R

    data = [(None if k == 7 else f"k{k}", 1_000 * k + i, k * 90 + i, 1) for k in range(40) for i in range(90)]
    df = spark.createDataFrame(data, "k string, t long, id long, v long")
    pieces = []
    original = R.stored

    def watched(cut, name):
        out = original(cut, name)
        pieces.extend(r["count"] for r in out.groupBy("k", "__range").count().collect())
        return out

    spark.conf.set(R.HOT_ROWS_CONF, "30")
    R.stored = watched
    try:
        got = {r["id"]: r["total"] for r in running(df, ["k"], ["t"], {"total": run_sum(F.col("v"))}).collect()}
    finally:
        R.stored = original
        spark.conf.unset(R.HOT_ROWS_CONF)
    assert got == {row[2]: row[2] % 90 + 1 for row in data}
    assert len(pieces) > 80 and max(pieces) <= 45
