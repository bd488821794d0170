"""Isotonic pooling by ranges, and calibrated models that are stored."""
import random

import pytest
from pyspark.sql import functions as F

from tests.test_models import COLUMNS, train  # noqa: F401  (the fixture)
from visitlake.models import training
from visitlake.models.calibrators import ScoreCalibrator, fit_calibrator, isotonic_blocks


def plain(rows):
    """Pool adjacent violators over all merged scores at once."""
    merged = {}
    for p, y, w in rows:
        if p is not None and y is not None and w > 0:
            a, b = merged.get(p, (0.0, 0.0))
            merged[p] = (a + y * w, b + w)
    stack = []
    for p in sorted(merged):
        a, w = merged[p]
        block = [p, p, a / w, w]
        while stack and stack[-1][2] >= block[2]:
            lo, _, m, v = stack.pop()
            block = [lo, block[1], (m * v + block[2] * block[3]) / (v + block[3]), v + block[3]]
        stack.append(block)
    return [pytest.approx(tuple(b)) for b in stack]


def blocks(spark, rows, **how):
    frame = spark.createDataFrame(rows, "p double, y int, w double")
    return [tuple(r) for r in isotonic_blocks(frame, "p", "y", "w", **how).orderBy("lo").collect()]


@pytest.mark.parametrize("range_rows", [100_000, 40, 7])
def test_blocks_equal_pooling_at_once(spark, range_rows):
    rnd = random.Random(range_rows)
    rows = [(round(rnd.random(), 2), int(rnd.random() < 0.5), float(rnd.randint(0, 3))) for _ in range(200)]
    rows += [(0.5, int(rnd.random() < 0.3), 1.0) for _ in range(150)] + [(None, 1, 1.0), (0.2, None, 1.0)]
    assert blocks(spark, rows, range_rows=range_rows) == plain(rows)


def test_rising_falling_and_no_scores(spark):
    rising = [(i / 100, int(i >= 50), 1.0) for i in range(100)]
    falling = [(i / 100, int(i < 50), 1.0) for i in range(100)]
    steps = [(i / 60, int(i % 6 < i // 10), 1.0) for i in range(60)]
    for rows in (rising, falling, steps):
        assert blocks(spark, rows, range_rows=9) == plain(rows)
    assert blocks(spark, []) == []


def test_every_distinct_score_a_block(spark):
    """Nothing to pool: labels as weights of rising means; ranges end without one task that takes all."""
    rows = [(i / 50, y, w) for i in range(50) for y, w in ((1, float(i)), (0, float(50 - i)))]
    assert blocks(spark, rows, range_rows=6) == plain(rows)


def test_calibrators_between_and_beyond_blocks(spark, tmp_path):
    rows = spark.createDataFrame([(p, y) for p, y in ((0.2, 0), (0.4, 1), (0.4, 0), (0.6, 0), (0.8, 1))], "p double, y int")
    iso = fit_calibrator(rows, "isotonic", "y")
    frame = spark.createDataFrame([(0.0,), (0.3,), (0.5,), (0.7,), (1.0,), (None,)], "p double")
    got = [r["p"] for r in iso.transform(frame).collect()]
    assert got[:5] == pytest.approx([0.0, 1 / 6, 1 / 3, 2 / 3, 1.0]) and got[5] is None
    iso.write().overwrite().save(f"file://{tmp_path}/iso")
    assert [r["p"] for r in ScoreCalibrator.load(f"file://{tmp_path}/iso").transform(frame).collect()][:5] == got[:5]


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_a_stored_calibrated_model_scores_alike_in_another_session(spark, train, tmp_path, method):  # noqa: F811
    recipe = training.Recipe("logistic_regression", COLUMNS, row_id=("appointment_id",))
    model = training.fit_calibrated(recipe, train, "patient_id", method, inner=2)
    model.save(f"file://{tmp_path}/model", "v7")
    again, version = training.load_calibrated(spark.newSession(), f"file://{tmp_path}/model")
    assert version == "v7"
    a, b = ({r["appointment_id"]: r["p"] for r in m(train).collect()} for m in (model, again))
    assert len(a) == 900 and a == pytest.approx(b) and 0 <= min(a.values()) < max(a.values()) <= 1
    model.bases[0].save(f"file://{tmp_path}/model/member-0", "v8")
    with pytest.raises(ValueError, match="versions"):
        training.load_calibrated(spark, f"file://{tmp_path}/model")
