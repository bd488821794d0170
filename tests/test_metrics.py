import random

import pytest
from pyspark.sql import functions as F

from visitlake.operators import bootstrap, calibration, metrics, queue, selection

SCORES = "y int, s double"


def scored(spark, y, s):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], SCORES)


def test_worked_case(spark):
    m = metrics.binary_metrics(scored(spark, [0, 0, 1, 1], [.1, .4, .35, .8]), "y", "s").first()
    assert m["auc_roc"] == pytest.approx(0.75) and m["avg_precision"] == pytest.approx(5 / 6)
    assert m["brier"] == pytest.approx((.01 + .16 + .4225 + .04) / 4)


def test_recall_at_precision(spark):
    df = scored(spark, [1, 0, 1, 0, 0, 1, 0, 0, 0, 0], [1 - i / 10 for i in range(10)])
    m = metrics.binary_metrics(df, "y", "s", targets=(0.6, 1.0, 0.35)).first()
    assert (m["sens_at_prec_60"], m["sens_at_prec_100"], m["sens_at_prec_35"]) == (pytest.approx(2 / 3), pytest.approx(1 / 3), 1.0)
    constant = scored(spark, [1] + [0] * 4, [0.5] * 5)
    m = metrics.binary_metrics(constant, "y", "s").first()
    assert m["sens_at_prec_30"] == 0.0 and m["auc_roc"] == pytest.approx(0.5)


def test_one_class_gives_null(spark):
    assert metrics.binary_metrics(scored(spark, [0, 0], [.1, .2]), "y", "s").first()["auc_roc"] is None


def test_weights_equal_repeated_rows(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.randint(0, 9) / 10, rng.randint(0, 3)) for _ in range(80)]
    weighted = spark.createDataFrame(rows, "y int, s double, w int")
    repeated = scored(spark, *zip(*[(y, s) for y, s, w in rows for _ in range(w)]))
    a, b = metrics.binary_metrics(weighted, "y", "s", weight="w").first(), metrics.binary_metrics(repeated, "y", "s").first()
    assert a.asDict() == pytest.approx(b.asDict())


def test_threshold_needs_a_minimum_share(spark):
    df = scored(spark, [1] * 5 + [0] * 5000, [.99] * 5 + [.1] * 5000)
    assert metrics.threshold_for_precision(df, "y", "s", [0.9]).first()["threshold"] is None
    cut = metrics.threshold_for_precision(df, "y", "s", [0.9], min_share=0.0).first()["threshold"]
    assert df.where(F.col("s") >= cut).count() == 5


def test_intervals_have_the_right_spread_under_both_schemes(spark):
    rng = random.Random(5)
    rows = [(g, int(rng.random() < 0.3), round(rng.random(), 2)) for g in range(200) for _ in range(2)]
    df = spark.createDataFrame(rows, "g long, y int, s double")
    widths = []
    for scheme in ("multinomial", "poisson"):
        ci = {r["metric"]: r for r in bootstrap.bootstrap_ci(df, "y", "s", "g", 100, scheme=scheme).collect()}
        assert ci["auc_roc"]["lo"] < ci["auc_roc"]["value"] < ci["auc_roc"]["hi"]
        widths.append(ci["brier"]["hi"] - ci["brier"]["lo"])
    assert widths[0] == pytest.approx(widths[1], rel=0.5)
    weights = bootstrap.multinomial_weights(df, "g", 30)
    totals = weights.groupBy("rep").agg(F.sum("w").alias("n")).collect()
    assert len(totals) == 30 and all(r["n"] == 200 for r in totals)
    shares = weights.groupBy("rep").count().agg(F.avg("count")).first()[0] / 200
    assert 0.58 < shares < 0.68  # about 1 - 1/e of the groups are drawn


def test_quantile_bins_cover_all_rows(spark, cut_groups):
    rng = random.Random(2)
    df = scored(spark, [rng.randint(0, 1) for _ in range(200)], [rng.choice([.1, .1, .2, .5, rng.random()]) for _ in range(200)])
    t = calibration.reliability_bins(df, "y", "s", strategy="quantile").collect()
    assert sum(r["n"] for r in t) == 200 and [r["bin"] for r in t] == list(range(1, len(t) + 1))
    assert calibration.expected_calibration_error(scored(spark, [0, 1], [0.0, 1.0]), "y", "s").first()["ece"] == 0.0


def test_evenly_spaced_positions(spark):
    for n, m in ((16, 5), (7, 3), (10, 10), (9, 1), (6, 0)):
        df = spark.range(n).withColumn("g", F.lit(1)).withColumn("m", F.lit(m))
        got = sorted(r["position"] - 1 for r in selection.evenly_spaced(df, ["g"], ["id"], F.col("m")).collect())
        assert got == [int((j + 0.5) * n / m) for j in range(m)]


def test_queue_equals_the_recurrence(spark, cut_groups):
    rng = random.Random(9)
    rows = [(s, i, 5.0 * i, rng.uniform(1, 14), rng.random() < 0.8) for s in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "s long, i long, arrival double, service double, attends boolean")
    timeline = queue.queue_timeline(df, ["s"], ["i"])
    got = {(r["s"], r["i"]): (r["start"], r["end"]) for r in timeline.collect()}
    for session in range(3):
        free, busy, last = 0.0, 0.0, 0.0
        for s, i, arrival, service, attends in (r for r in rows if r[0] == session):
            if not attends:
                assert got[(s, i)] == (None, None)
                continue
            start = max(arrival, free)
            free = last = start + service
            busy += max(0.0, min(free, 240) - min(start, 240))
            assert got[(s, i)] == (pytest.approx(start), pytest.approx(free))
        m = queue.queue_metrics(timeline, ["s"], 240).where(F.col("s") == session).first()
        assert m["overtime"] == pytest.approx(max(0, last - 240)) and m["idle"] == pytest.approx(240 - busy)


def test_nobody_attends(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 5.0, False)], "s long, i long, arrival double, service double, attends boolean")
    m = queue.queue_metrics(queue.queue_timeline(df, ["s"], ["i"]), ["s"], 240).first()
    assert (m["served"], m["mean_wait"], m["overtime"], m["idle"]) == (0, None, 0.0, 240.0)
