"""Registered model jobs over the visit and booking tables. A fitted model has no SQL text; its target codes do."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..models import encoding, training
from ..operators import features, history, risk, splits
from ..session import stored
from . import views as V
from .catalog import query
from .oracle import big, mix, num, with_views

COLUMNS = features.DATED_COLUMNS
VISIT = ("appointment_id",)
LR = training.Recipe("logistic_regression", COLUMNS, row_id=VISIT)
SIX = training.Recipe("logistic_regression", risk.FEATURES, row_id=VISIT)
K, N_BOOT = 5, 1000
BOOSTED_SIX = training.Recipe("gradient_boosting", risk.FEATURES, row_id=VISIT)
#: settings that a query can run in its time; the README has figures, the library's defaults are the real ones
HOLDOUT_RECIPES = {"logistic_regression": LR,
                   "random_forest": training.Recipe("random_forest", COLUMNS, {"n_estimators": 20, "max_depth": 6}, row_id=VISIT),
                   "gradient_boosting": training.Recipe("gradient_boosting", COLUMNS, {"max_iter": 10, "max_leaf_nodes": 15}, row_id=VISIT)}


def prepared(spark, sf):
    """(train with folds, holdout): clean visits with history, cut by date, whole patients per fold."""
    # written before they are read more than once: history reads the visits twice, the cut, the folds and both parts read the rows
    v = splits.holdout_by_date(stored(history.history_asof(stored(V.visits(spark, sf), "visits")), "history"))
    rows = features.dated_features(v, keep=["appointment_id", "patient_id", "part", "no_show"])
    train = splits.grouped_folds(rows.where(F.col("part") == "train"), "patient_id", K)
    return stored(train, "train"), stored(rows.where(F.col("part") == "holdout"), "holdout")


def booked(spark, sf):
    """Bookings with an outcome and the six features that exist when a booking is made."""
    f = risk.deployable_features(V.bookings(spark, sf), V.patients(spark, sf))
    known = f.where(F.col("status").isin(*risk.KNOWN) & (F.col("usable") == 1))
    return known.withColumns({"no_show": (F.col("status") == "no_show").cast("int"), "lead_same_day": (F.col("lead_days") == 0).cast("int")})


@query("target_codes", with_views(["visits"], f"""
WITH r AS (SELECT appointment_id, neighbourhood AS c, no_show AS y, {mix(7, 'appointment_id % 2147483647')} % 5 AS f FROM visits),
cells AS (SELECT c, f, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS y FROM r GROUP BY 1, 2),
folds AS (SELECT f, sum(n) AS n, sum(y) AS y FROM cells GROUP BY 1),
rest AS (SELECT f, ((SELECT sum(y) FROM cells) - y) / ((SELECT sum(n) FROM cells) - n) AS overall FROM folds),
other AS (SELECT c, f, sum(n) OVER w - n AS n, sum(y) OVER w - y AS y FROM cells WINDOW w AS (PARTITION BY c)),
own AS (SELECT o.c, o.f, o.n, CASE WHEN o.n > 0 THEN o.y / o.n END AS mean, overall FROM other o JOIN rest USING (f)),
trusted AS (SELECT *, overall * (1 - overall) * n / nullif(overall * (1 - overall) * n + mean * (1 - mean), 0) AS trust FROM own),
codes AS (SELECT c, f, coalesce(trust * mean + (1 - trust) * overall, overall) AS code FROM trusted)
SELECT r.c AS neighbourhood, {big('r.f', 'fold')}, {big('count(*)', 'n')}, {num('min(code)', 'code')} FROM r JOIN codes USING (c, f) GROUP BY r.c, r.f"""))
def target_codes(spark, sf):
    """The cross-fitted code of every neighbourhood and fold: what training rows see of their neighbourhood."""
    v = V.visits(spark, sf).select("appointment_id", "neighbourhood", "no_show")
    cells = encoding.category_cells(v, "neighbourhood", "no_show", VISIT)
    coded = encoding.cross_fit(v, "neighbourhood", cells, "code", VISIT).withColumn("fold", encoding.inner_fold(VISIT).cast("long"))
    return coded.groupBy("neighbourhood", "fold").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("code"))


@query("oof_scores")
def oof_scores(spark, sf):
    train, _ = prepared(spark, sf)
    return training.fold_scores(training.out_of_fold(SIX, train, K), "no_show")


@query("tuning")
def tuning(spark, sf):
    train, _ = prepared(spark, sf)
    return training.tune(SIX, train, K)


@query("model_holdout")
def model_holdout(spark, sf):
    """Three models fitted on the training part and scored once on the holdout (small trees settings; the grids are in the library)."""
    train, holdout = prepared(spark, sf)
    scored = holdout
    for name, recipe in HOLDOUT_RECIPES.items():
        scored = training.fit(recipe, train).score(scored, name)
    long = scored.select("no_show", F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("p")) for n in HOLDOUT_RECIPES])))
    return training.binary_metrics(long, "no_show", "p", ["model"])


@query("model_ladder")
def model_ladder(spark, sf):
    """The earlier-rate rule, then three models, each against the one before it, paired by patient."""
    train, scored = prepared(spark, sf)
    for name, recipe in HOLDOUT_RECIPES.items():
        scored = training.fit(recipe, train).score(scored, name)
    scored = stored(scored.withColumn("earlier_rate_rule", F.coalesce("prev_no_show_rate", F.lit(0.0))).select("patient_id", "no_show", "earlier_rate_rule", *HOLDOUT_RECIPES), "scored")
    return training.ladder(scored, "no_show", "patient_id", ["earlier_rate_rule", *HOLDOUT_RECIPES], N_BOOT)


@query("calibration_methods")
def calibration_methods(spark, sf):
    train, _ = prepared(spark, sf)
    return training.calibration_methods(SIX, train, "patient_id", K)


@query("ablation")
def ablation(spark, sf):
    train, _ = prepared(spark, sf)
    return training.ablation(SIX, train, K, training.ablation_variants(features.DATED_GROUPS))


@query("imbalance")
def imbalance(spark, sf):
    """Six strategies on two base models, each with the library's defaults: boosting runs 200 rounds of 31 leaves."""
    train, holdout = prepared(spark, sf)
    return training.imbalance([SIX, BOOSTED_SIX], train, holdout, K)


@query("transfer")
def transfer(spark, sf):
    """Both directions between the visit table and bookings: the target's own model against the other table's, on the target's holdout."""
    train, holdout = prepared(spark, sf)
    parts = stored(splits.grouped_folds(booked(spark, sf).select("patient_id", "no_show", *features.COMMON), "patient_id", 2), "booked")
    recipe = training.Recipe("logistic_regression", features.COMMON)
    of_bookings, of_visits = training.fit(recipe, parts.where(F.col("fold") == 0)), training.fit(recipe, train)
    there = training.transfer(of_visits, of_bookings, parts.where(F.col("fold") == 1), "no_show", "patient_id", N_BOOT)
    back = training.transfer(of_bookings, of_visits, holdout, "no_show", "patient_id", N_BOOT)
    return there.withColumn("direction", F.lit("visits_to_bookings")).unionByName(back.withColumn("direction", F.lit("bookings_to_visits")))


@query("bulk_score")
def bulk_score(spark, sf):
    """Every usable booking scored by the six-feature model; the band counts of the run."""
    train, _ = prepared(spark, sf)
    model = training.fit(SIX, train)
    f = risk.deployable_features(V.bookings(spark, sf), V.patients(spark, sf))
    good, bad = risk.split_scores(model.score(f.where(F.col("usable") == 1), "no_show_probability"))
    return risk.band_counts(good, 0.19, 0.38).crossJoin(F.broadcast(bad.agg(F.count(F.lit(1)).alias("rejected"))))
