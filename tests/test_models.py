"""Model jobs on small synthetic data: what is fitted where, not how good it is."""
import pytest
from pyspark.sql import functions as F

from visitlake.models import encoding, training
from visitlake.operators import features
from visitlake.operators.metrics import argmax, binary_metrics
from visitlake.operators.splits import fold_audit, grouped_folds
from visitlake.sources.synthetic import synthetic_visits

COLUMNS = ("lead_days", "age", "is_female", "appt_weekday", "neighbourhood")


@pytest.fixture(scope="module")
def train(spark):
    v = synthetic_visits(spark, 150, 900)
    v = v.withColumns({"is_female": (F.col("sex") == "F").cast("int"), "neighbourhood": F.concat(F.lit("n"), (F.col("patient_id") % 7).cast("string")),
                       "no_show": ((F.col("lead_days") + F.col("appointment_id") % 9) > 11).cast("int")})
    rows = v.select("appointment_id", "patient_id", "no_show", *COLUMNS)
    return grouped_folds(rows, "patient_id", 2).persist()


def test_folds_hold_whole_groups_and_cover_everything(train):
    audit = fold_audit(train, "fold", "patient_id").collect()
    assert all(r["n_both_sides"] == 0 for r in audit) and abs(audit[0]["n_groups"] - audit[1]["n_groups"]) <= 1
    assert train.count() == 900


def test_a_fold_is_scored_by_a_model_that_never_saw_it(train):
    recipe = training.Recipe("logistic_regression", COLUMNS, row_id=("appointment_id",))
    oof = training.out_of_fold(recipe, train, 2)
    a = {r["appointment_id"]: r["p"] for r in oof.where("fold = 0").collect()}
    flipped = train.withColumn("no_show", F.when(F.col("fold") == 0, 1 - F.col("no_show")).otherwise(F.col("no_show")))
    b = {r["appointment_id"]: r["p"] for r in training.out_of_fold(recipe, flipped, 2).where("fold = 0").collect()}
    assert len(a) > 300 and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    assert binary_metrics(oof, "no_show", "p").first()["auc_roc"] > 0.8


def test_target_codes_leave_out_the_own_fold(spark, train):
    identity = ["appointment_id"]
    rows = train.select("appointment_id", "neighbourhood", "no_show").collect()
    cells = encoding.category_cells(train, "neighbourhood", "no_show", identity)
    coded = encoding.cross_fit(train, "neighbourhood", cells, "code", identity).select("appointment_id", "code", encoding.inner_fold(identity).alias("f")).collect()
    fold = {r["appointment_id"]: r["f"] for r in coded}
    label = {r["appointment_id"]: (r["neighbourhood"], r["no_show"]) for r in rows}
    for r in coded[:40]:
        other = [label[i] for i in label if fold[i] != r["f"]]
        overall = sum(y for _, y in other) / len(other)
        mine = [y for n, y in other if n == label[r["appointment_id"]][0]]
        mean, n = sum(mine) / len(mine), len(mine)
        trust = overall * (1 - overall) * n / (overall * (1 - overall) * n + mean * (1 - mean))
        assert r["code"] == pytest.approx(trust * mean + (1 - trust) * overall)
    unseen = encoding.apply_encoding(spark.createDataFrame([("nowhere",)], "neighbourhood string"), "neighbourhood", encoding.encoding_of(cells), "code").first()
    assert unseen["code"] == pytest.approx(sum(y for _, y in label.values()) / len(label))


def test_a_row_never_sees_its_own_label(train):
    """Flipping one label changes codes of other folds and leaves that row's own code as it was."""
    identity = ["appointment_id"]
    pick = train.orderBy("appointment_id").first()

    def codes(df):
        cells = encoding.category_cells(df, "neighbourhood", "no_show", identity)
        return {r["appointment_id"]: r["code"] for r in encoding.cross_fit(df, "neighbourhood", cells, "code", identity).select("appointment_id", "code").collect()}

    flipped = train.withColumn("no_show", F.when(F.col("appointment_id") == pick["appointment_id"], 1 - F.col("no_show")).otherwise(F.col("no_show")))
    before, after = codes(train), codes(flipped)
    assert before[pick["appointment_id"]] == after[pick["appointment_id"]] and before != after


def test_codes_of_coin_flips_tell_nothing(spark):
    rows = spark.range(4_000).selectExpr("id AS appointment_id", "concat('n', id % 20) AS neighbourhood", "CAST(pmod(xxhash64(id, 5), 2) AS INT) AS no_show")
    cells = encoding.category_cells(rows, "neighbourhood", "no_show", ["appointment_id"])
    auc = binary_metrics(encoding.cross_fit(rows, "neighbourhood", cells, "code", ["appointment_id"]), "no_show", "code").first()["auc_roc"]
    assert 0.42 < auc < 0.56
    with pytest.raises(ValueError):
        training.fit(training.Recipe("logistic_regression", ("neighbourhood",)), rows)


def test_under_sampling_balances_the_classes(train):
    out = training.under_sample(train, "no_show", ["appointment_id"])
    pos, neg = training.class_counts(out, "no_show")
    assert pos == neg == min(training.class_counts(train, "no_show"))


def test_calibrated_scores_are_probabilities(train):
    recipe = training.Recipe("logistic_regression", COLUMNS[:3])
    for method in ("sigmoid", "isotonic"):
        scored = training.fit_calibrated(recipe, train, "patient_id", method, inner=2)(train)
        low, high, n = scored.agg(F.min("p"), F.max("p"), F.count("p")).first()
        assert 0.0 <= low < high <= 1.0 and n == 900


def test_grids_variants_and_ties(spark):
    assert training.grid({"b": [1, 2], "a": [3, 4]}) == [{"a": 3, "b": 1}, {"a": 3, "b": 2}, {"a": 4, "b": 1}, {"a": 4, "b": 2}]
    names = training.ablation_variants(features.DATED_GROUPS)
    assert list(names)[:2] == ["all_features", "no_sms_received"] and len(names) == 12 and "sms_received" not in names["drop_flags"]
    assert features.DATED_COLUMNS[0] == "prev_appointments" and len(features.DATED_COLUMNS) == 15 and len(features.CODED_COLUMNS) == 11
    tied = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "rank int, v double")
    assert argmax(tied, [], "v", "rank").first()["rank"] == 1
    assert argmax(spark.createDataFrame([(0, 0.2), (1, 0.2)], "rank int, v double"), [], "v", "rank", lowest=True).first()["rank"] == 0


def test_a_stored_model_scores_alike_in_another_session(spark, train, tmp_path):
    recipe = training.Recipe("logistic_regression", COLUMNS, {"C": 0.5}, row_id=("appointment_id",))
    fitted = training.fit(recipe, train)
    fitted.save(f"file://{tmp_path}/model", "v1")
    again, version = training.load(spark.newSession(), f"file://{tmp_path}/model")
    assert version == "v1" and again.recipe == recipe
    a = {r["appointment_id"]: r["p"] for r in fitted.score(train).collect()}
    b = {r["appointment_id"]: r["p"] for r in again.score(train).collect()}
    assert len(a) == 900 and a == b
