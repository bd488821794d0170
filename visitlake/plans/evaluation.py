"""Registered queries: metrics, thresholds, bootstrap, calibration, risk bands."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap, calibration, history, metrics, profile, risk, upsert
from . import views as V
from .catalog import query
from .oracle import big, mix, num, wilson, with_views
from .research import CUT_SQL, HISTORY_CTE

MEDIUM, HIGH = 0.35, 0.6
TARGETS = (0.30, 0.50, 0.60, 0.999)


def metric_ctes(source: str, by: str) -> str:
    """Metrics by counting pairs per distinct score; `source` has (by, s, y, w)."""
    return f"""cnt AS (SELECT {by}, s, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS tp, sum(CASE WHEN y = 1 THEN 0 ELSE w END) AS fp FROM {source} GROUP BY {by}, s),
cur AS (SELECT *, sum(tp) OVER (PARTITION BY {by} ORDER BY s DESC) AS ctp, sum(fp) OVER (PARTITION BY {by} ORDER BY s DESC) AS cfp,
  sum(fp) OVER (PARTITION BY {by} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below,
  sum(tp) OVER (PARTITION BY {by}) AS pos, sum(fp) OVER (PARTITION BY {by}) AS neg FROM cnt),
met AS (SELECT {by}, any_value(pos) AS n_positive, any_value(pos + neg) AS n,
  sum(tp * (coalesce(below, 0) + fp / 2.0::DOUBLE)) / nullif(any_value(pos) * any_value(neg), 0) AS auc_roc,
  sum(tp * (ctp / CAST(ctp + cfp AS DOUBLE))) / nullif(any_value(pos), 0) AS avg_precision,
  sum(tp * pow(1 - s, 2) + fp * pow(s, 2)) / any_value(pos + neg) AS brier,
  coalesce(max(CASE WHEN ctp / CAST(ctp + cfp AS DOUBLE) >= 0.3 - 1e-12 THEN ctp END), 0) / CAST(any_value(pos) AS DOUBLE) AS sens_at_prec_30,
  coalesce(max(CASE WHEN ctp / CAST(ctp + cfp AS DOUBLE) >= 0.4 - 1e-12 THEN ctp END), 0) / CAST(any_value(pos) AS DOUBLE) AS sens_at_prec_40,
  coalesce(max(CASE WHEN ctp / CAST(ctp + cfp AS DOUBLE) >= 0.5 - 1e-12 THEN ctp END), 0) / CAST(any_value(pos) AS DOUBLE) AS sens_at_prec_50
  FROM cur GROUP BY {by})"""


def metric_out(names=metrics.METRICS) -> str:
    return ", ".join(num(f"CASE WHEN n_positive > 0 AND n > n_positive THEN {m} END", m) for m in names)


@query("binary_metrics", with_views(["scored"], f"""
WITH src AS (SELECT fold, p AS s, y, 1 AS w FROM scored), {metric_ctes('src', 'fold')}
SELECT fold, {big('n', 'n')}, {big('n_positive', 'n_positive')}, {metric_out(metrics.METRICS[:3])} FROM met"""))
def binary_metrics(spark, sf):
    return metrics.binary_metrics(V.scored(spark, sf), "y", "p", ["fold"]).select("fold", "n", "n_positive", *metrics.METRICS[:3])


@query("binary_metrics_weighted", with_views(["scored"], f"""
WITH src AS (SELECT 1 AS one, p2 AS s, y, fold - 1 AS w FROM scored WHERE fold > 1), {metric_ctes('src', 'one')}
SELECT {big('n', 'n')}, {big('n_positive', 'n_positive')}, {metric_out()} FROM met"""))
def binary_metrics_weighted(spark, sf):
    return metrics.binary_metrics(V.scored(spark, sf).withColumn("w", F.col("fold") - 1), "y", "p2", weight="w")


@query("recall_at_precision", with_views(["scored"], f"""
WITH src AS (SELECT fold, p AS s, y, 1 AS w FROM scored), {metric_ctes('src', 'fold')}
SELECT fold, {metric_out(metrics.METRICS[3:])} FROM met"""))
def recall_at_precision(spark, sf):
    return metrics.binary_metrics(V.scored(spark, sf), "y", "p", ["fold"]).select("fold", *metrics.METRICS[3:])


@query("fold_metrics", with_views(["scored"], f"""
WITH src AS (SELECT fold, 'p' AS variant, p AS s, y, 1 AS w FROM scored UNION ALL SELECT fold, 'p2', p2, y, 1 FROM scored), {metric_ctes('src', 'variant, fold')},
d AS (SELECT m.*, m.auc_roc - b.auc_roc AS da, m.avg_precision - b.avg_precision AS dp FROM met m JOIN met b ON b.fold = m.fold AND b.variant = 'p')
SELECT variant, count(*) AS n_folds, {num('avg(auc_roc)', 'cv_auc_mean')}, {num('stddev_samp(auc_roc)', 'cv_auc_std')}, {num('avg(avg_precision)', 'cv_ap_mean')},
  {num('stddev_samp(avg_precision)', 'cv_ap_std')}, {num('avg(brier)', 'cv_brier_mean')}, {num('avg(da)', 'delta_auc')}, {num('stddev_samp(da)', 'delta_auc_std')},
  {num('avg(dp)', 'delta_ap')} FROM d GROUP BY variant"""))
def fold_metrics(spark, sf):
    return metrics.fold_metrics(V.scored(spark, sf), "y", ["p", "p2"])


RANGES = [(f"{t:.2f}", t, float("inf")) for t in (0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7)] + metrics.band_ranges(MEDIUM, HIGH)
RANGES_SQL = ", ".join(f"('{name}', {low}::DOUBLE, {'CAST(1e308 AS DOUBLE)' if high == float('inf') else f'{high}::DOUBLE'})" for name, low, high in RANGES)


@query("threshold_table", with_views(["scored"], f"""
WITH r(label, low, high) AS (VALUES {RANGES_SQL}), t AS (SELECT count(*) AS n, sum(y) AS pos FROM scored),
c AS (SELECT label, low, count(y) AS f, coalesce(sum(y), 0) AS k FROM r LEFT JOIN scored ON p >= low AND p < high GROUP BY 1, 2)
SELECT label, {num('low', 'low')}, {big('f', 'flagged_n')}, {num('f / CAST(n AS DOUBLE)', 'share_flagged')}, {num('CASE WHEN f > 0 THEN k / CAST(f AS DOUBLE) END', 'precision')},
  {num('k / CAST(pos AS DOUBLE)', 'sensitivity')} FROM c, t"""))
def threshold_table(spark, sf):
    return metrics.threshold_table(V.scored(spark, sf), "y", "p", RANGES)


GRID_SQL = """grid AS (SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(1, 100) t(i)),
gt AS (SELECT threshold, count(y) AS f, coalesce(sum(y), 0) AS k, (SELECT count(*) FROM scored) AS n FROM grid LEFT JOIN scored ON p >= threshold GROUP BY threshold)"""


@query("threshold_grid", with_views(["scored"], f"""
WITH {GRID_SQL} SELECT {num('threshold', 'threshold')}, {big('f', 'flagged_n')}, {big('k', 'tp')}, {big('n', 'n')}, {big('(SELECT sum(y) FROM scored)', 'n_positive')} FROM gt"""))
def threshold_grid(spark, sf):
    return metrics.grid_table(V.scored(spark, sf), "y", "p")


@query("threshold_for_precision", with_views(["scored"], f"""
WITH {GRID_SQL}, tg(target) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in TARGETS)}),
e AS (SELECT target, threshold, CAST(k AS DOUBLE) / f >= target AS ok FROM gt, tg WHERE f > 0 AND CAST(f AS DOUBLE) / n >= 0.01),
top_miss AS (SELECT target, max(threshold) AS t FROM e WHERE NOT ok GROUP BY target)
SELECT {num('tg.target', 'target')}, {num('min(e.threshold)', 'threshold')} FROM tg LEFT JOIN top_miss m ON m.target = tg.target
  LEFT JOIN e ON e.target = tg.target AND e.threshold > coalesce(m.t, -1) GROUP BY tg.target"""))
def threshold_for_precision(spark, sf):
    return metrics.threshold_for_precision(V.scored(spark, sf), "y", "p", TARGETS)


CUTOFFS = [round(0.1 * i, 2) for i in range(1, 11)]


def points_sql(source: str, score: str) -> str:
    cuts = ", ".join(f"({c}::DOUBLE)" for c in CUTOFFS)
    return f"""cuts(cutoff) AS (VALUES {cuts}),
pt AS (SELECT cutoff, count(*) FILTER ({score} >= cutoff) AS f, count(*) FILTER ({score} >= cutoff AND y = 1) AS k, count(*) FILTER (y = 1) AS pos, count(*) AS n
  FROM cuts, {source} GROUP BY cutoff),
pr AS (SELECT cutoff, CASE WHEN f > 0 THEN k / CAST(f AS DOUBLE) ELSE 0 END AS precision, CASE WHEN pos > 0 THEN k / CAST(pos AS DOUBLE) ELSE 0 END AS recall,
  (n - pos - f + 2 * k) / CAST(n AS DOUBLE) AS accuracy FROM pt),
op AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""


OP_OUT = ", ".join(num(c, c) for c in ("cutoff", "precision", "recall", "f1", "accuracy"))


@query("operating_points", with_views(["scored"], f"WITH {points_sql('scored', 'p')} SELECT {OP_OUT} FROM op"))
def operating_points(spark, sf):
    return metrics.operating_points(V.scored(spark, sf), "y", "p", CUTOFFS)


@query("best_f1_cutoff", with_views(["scored"], f"WITH {points_sql('scored', 'p')} SELECT {OP_OUT} FROM op ORDER BY f1 DESC, cutoff LIMIT 1"))
def best_f1_cutoff(spark, sf):
    return metrics.best_cutoff(V.scored(spark, sf), "y", "p", CUTOFFS)


@query("best_f1_threshold", with_views(["scored"], f"""
WITH c AS (SELECT p AS s, sum(y) AS tp, count(*) AS n FROM scored GROUP BY p), w AS (SELECT s, sum(tp) OVER (ORDER BY s DESC) AS ctp, sum(n) OVER (ORDER BY s DESC) AS cn,
  sum(tp) OVER () AS pos FROM c)
SELECT {num('s', 'threshold')}, {num('2.0::DOUBLE * ctp / (cn + pos)', 'f1')} FROM w ORDER BY 2.0::DOUBLE * ctp / (cn + pos) DESC, s LIMIT 1"""))
def best_f1_threshold(spark, sf):
    return metrics.best_f1_threshold(V.scored(spark, sf), "y", "p")


@query("argmax_ties", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) WHERE r = 1""")
def argmax_ties(spark, sf):
    counts = V.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return metrics.argmax(counts, ["user_id"], "n", "event_type")


# the earlier-rate rule: cutoff chosen on the training part, reported on the holdout
@query("baseline_rule", with_views(["visits"], f"""
WITH {HISTORY_CTE}, {CUT_SQL},
r AS (SELECT h.no_show AS y, coalesce(h.prev_no_show_rate, 0) AS rate, h.appointment_date >= cut AS late FROM hist h, cut),
tr AS (SELECT y, rate FROM r WHERE NOT late), ho AS (SELECT y, rate FROM r WHERE late), {points_sql('tr', 'rate')},
best AS (SELECT cutoff FROM op ORDER BY f1 DESC, cutoff LIMIT 1),
res AS (SELECT 'earlier_no_show_rate_rule' AS model, cutoff, count(*) AS n, count(*) FILTER (y = 1) AS pos, count(*) FILTER (rate >= cutoff) AS f,
  count(*) FILTER (rate >= cutoff AND y = 1) AS k FROM ho, best GROUP BY cutoff
  UNION ALL SELECT 'always_show', 0.5::DOUBLE, count(*), count(*) FILTER (y = 1), 0, 0 FROM ho)
SELECT model, {num('cutoff', 'cutoff')}, {big('n', 'n')}, {num('pos / CAST(n AS DOUBLE)', 'prevalence')}, {num('(n - pos - f + 2 * k) / CAST(n AS DOUBLE)', 'accuracy')},
  {num('CASE WHEN f > 0 THEN k / CAST(f AS DOUBLE) ELSE 0 END', 'precision')}, {num('CASE WHEN pos > 0 THEN k / CAST(pos AS DOUBLE) ELSE 0 END', 'recall')} FROM res"""))
def baseline_rule(spark, sf):
    from ..operators import splits

    v = splits.holdout_by_date(history.history_asof(V.visits(spark, sf)))
    rows = v.select("part", F.col("no_show").alias("y"), F.coalesce("prev_no_show_rate", F.lit(0.0)).alias("rate"))
    train, holdout = rows.where(F.col("part") == "train"), rows.where(F.col("part") == "holdout")
    cutoff = metrics.best_cutoff(train, "y", "rate", CUTOFFS).select("cutoff").scalar()
    models = holdout.select("y", F.inline(F.array(
        F.struct(F.lit("always_show").alias("model"), F.lit(0.5).alias("cutoff"), F.lit(0.0).alias("score")),
        F.struct(F.lit("earlier_no_show_rate_rule").alias("model"), cutoff.alias("cutoff"), F.col("rate").alias("score")))))
    flagged, hit = F.col("score") >= F.col("cutoff"), F.col("y") == 1
    m = models.groupBy("model", "cutoff").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("pos"), F.count_if(flagged).alias("f"), F.count_if(flagged & hit).alias("k"))
    return m.select("model", "cutoff", "n", (F.col("pos") / F.col("n")).alias("prevalence"),
                    ((F.col("n") - F.col("pos") - F.col("f") + 2 * F.col("k")) / F.col("n")).alias("accuracy"),
                    F.coalesce(F.try_divide("k", "f"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("k", "pos"), F.lit(0.0)).alias("recall"))


@query("mean_vs_prevalence", with_views(["scored"], f"""
SELECT 'p' AS model, {num('avg(p)', 'mean_predicted')}, {num('avg(y)', 'prevalence')} FROM scored
UNION ALL SELECT 'p2', {num('avg(p2)', 'm')}, {num('avg(y)', 'v')} FROM scored"""))
def mean_vs_prevalence(spark, sf):
    return profile.mean_vs_prevalence(V.scored(spark, sf), {"p": "p", "p2": "p2"})


# ---- bootstrap ------------------------------------------------------------------------------------------------------
N_BOOT = 1000
DRAWS_SQL = f"""grp AS (SELECT patient_id, row_number() OVER (ORDER BY patient_id) - 1 AS i FROM (SELECT DISTINCT patient_id FROM scored)),
draws AS (SELECT rep, {mix(42, 'rep', 'i')} % (SELECT count(*) FROM grp) AS i FROM grp, range(1, {N_BOOT + 1}) t(rep)),
wts AS (SELECT rep, patient_id, count(*) AS w FROM draws JOIN grp USING (i) GROUP BY 1, 2),
reps AS (SELECT rep, y, p, p2, w FROM scored JOIN wts USING (patient_id) UNION ALL SELECT 0, y, p, p2, 1 FROM scored)"""


def interval_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, {num('max(CASE WHEN rep = 0 THEN value END)', 'value')}, {num('quantile_cont(CASE WHEN rep > 0 THEN value END, 0.025)', 'lo')},
  {num('quantile_cont(CASE WHEN rep > 0 THEN value END, 0.975)', 'hi')} FROM {source} GROUP BY {keys}"""


def melt_sql(source: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {source}" for m in metrics.METRICS)


@query("bootstrap_ci", with_views(["scored"], f"""
WITH {DRAWS_SQL}, src AS (SELECT rep, p AS s, y, w FROM reps), {metric_ctes('src', 'rep')}, long AS ({melt_sql('met', 'rep')})
{interval_sql('long', 'metric')}"""))
def bootstrap_ci(spark, sf):
    return bootstrap.bootstrap_ci(V.scored(spark, sf), "y", "p", "patient_id", N_BOOT)


POISSON_SQL = "CASE " + " ".join(f"WHEN u < {c}::DOUBLE THEN {k}" for k, c in enumerate(bootstrap.POISSON_1)) + f" ELSE {len(bootstrap.POISSON_1)} END"


@query("bootstrap_ci_poisson", with_views(["scored"], f"""
WITH grp AS (SELECT DISTINCT patient_id FROM scored),
wts AS (SELECT rep, patient_id, {POISSON_SQL} AS w FROM (SELECT rep, patient_id, {mix(42, 'rep', 'patient_id % 2147483647')} / 2147483647.0::DOUBLE AS u FROM grp, range(1, {N_BOOT + 1}) t(rep))),
src AS (SELECT rep, p AS s, y, w FROM scored JOIN wts USING (patient_id) WHERE w > 0 UNION ALL SELECT 0, p, y, 1 FROM scored),
{metric_ctes('src', 'rep')}, long AS ({melt_sql('met', 'rep')}) {interval_sql('long', 'metric')}"""))
def bootstrap_ci_poisson(spark, sf):
    return bootstrap.bootstrap_ci(V.scored(spark, sf), "y", "p", "patient_id", N_BOOT, scheme="poisson")


@query("bootstrap_paired", with_views(["scored"], f"""
WITH {DRAWS_SQL}, src AS (SELECT rep, 'a' AS variant, p AS s, y, w FROM reps UNION ALL SELECT rep, 'b', p2, y, w FROM reps), {metric_ctes('src', 'rep, variant')},
long AS ({melt_sql('met', 'rep, variant')}), diff AS (SELECT rep, metric, sum(CASE WHEN variant = 'a' THEN value ELSE -value END) AS value FROM long GROUP BY 1, 2)
{interval_sql('diff', 'metric')}"""))
def bootstrap_paired(spark, sf):
    return bootstrap.bootstrap_paired(V.scored(spark, sf), "y", "p", "p2", "patient_id", N_BOOT)


@query("bootstrap_thresholds", with_views(["scored"], f"""
WITH {DRAWS_SQL}, r(label, low, high) AS (VALUES {RANGES_SQL}), t AS (SELECT rep, sum(w) AS n, sum(w * y) AS pos FROM reps GROUP BY rep),
c AS (SELECT rep, label, sum(CASE WHEN p >= low AND p < high THEN w ELSE 0 END) AS f, sum(CASE WHEN p >= low AND p < high THEN w * y ELSE 0 END) AS k FROM reps, r GROUP BY 1, 2),
v AS (SELECT c.*, t.n, t.pos FROM c JOIN t USING (rep)),
long AS (SELECT rep, label, 'share_flagged' AS metric, f / CAST(n AS DOUBLE) AS value FROM v UNION ALL SELECT rep, label, 'precision', CASE WHEN f > 0 THEN k / CAST(f AS DOUBLE) END FROM v
  UNION ALL SELECT rep, label, 'sensitivity', k / CAST(pos AS DOUBLE) FROM v)
{interval_sql('long', 'label, metric')}"""))
def bootstrap_thresholds(spark, sf):
    return bootstrap.bootstrap_thresholds(V.scored(spark, sf), "y", "p", RANGES, "patient_id", N_BOOT)


# ---- calibration ----------------------------------------------------------------------------------------------------
def reliability_sql(bin_expr: str, source: str) -> str:
    low, high = wilson("k", "n")
    return f"""b AS (SELECT {bin_expr} AS b, count(*) AS n, avg(p) AS m, sum(y) AS k FROM {source} GROUP BY 1),
rel AS (SELECT CAST(row_number() OVER (ORDER BY b) AS INTEGER) AS bin, n, m AS mean_predicted, k / CAST(n AS DOUBLE) AS observed_rate, {low} AS ci_low, {high} AS ci_high FROM b)"""


REL_OUT = f"bin, {big('n', 'n')}, " + ", ".join(num(c, c) for c in ("mean_predicted", "observed_rate", "ci_low", "ci_high"))
WIDTH = "least(CAST(floor(p * 10) AS INTEGER), 9)"


@query("reliability_bins", with_views(["scored"], f"WITH {reliability_sql(WIDTH, 'scored')} SELECT {REL_OUT} FROM rel"))
def reliability_bins(spark, sf):
    return calibration.reliability_bins(V.scored(spark, sf), "y", "p")


QUANTILE = "greatest(0, least(len(list_filter(e, lambda x: x <= p)) - 1, len(e) - 2))"


@query("reliability_quantile", with_views(["scored"], f"""
WITH q AS (SELECT list_sort(list_distinct(quantile_cont(p2, [{', '.join(str(i / 10) for i in range(11))}]))) AS e FROM scored), x AS (SELECT y, p2 AS p, e FROM scored, q),
{reliability_sql(QUANTILE, 'x')} SELECT {REL_OUT} FROM rel"""))
def reliability_quantile(spark, sf):
    return calibration.reliability_bins(V.scored(spark, sf), "y", "p2", strategy="quantile")


@query("ece", with_views(["scored"], f"""
WITH {reliability_sql(WIDTH, 'scored')} SELECT {num('sum(n * abs(observed_rate - mean_predicted)) / sum(n)', 'ece')} FROM rel"""))
def ece(spark, sf):
    return calibration.expected_calibration_error(V.scored(spark, sf), "y", "p")


# ---- stored scores -----------------------------------------------------------------------------------------------------
@query("band_monitor", with_views(["bookings", "risk_scores"], f"""
WITH r AS (SELECT CASE WHEN no_show_probability >= 0.38 THEN 'high' WHEN no_show_probability >= 0.19 THEN 'medium' ELSE 'low' END AS band, status
  FROM risk_scores JOIN bookings USING (booking_id) WHERE status IN ('completed', 'no_show') AND model_version = 'v1')
SELECT b.band, count(r.band) AS bookings, count(*) FILTER (status = 'no_show') AS no_shows,
  {num("CASE WHEN count(r.band) > 0 THEN count(*) FILTER (status = 'no_show') / CAST(count(r.band) AS DOUBLE) END", 'rate')}
FROM (VALUES ('low'), ('medium'), ('high')) b(band) LEFT JOIN r ON r.band = b.band GROUP BY b.band"""))
def band_monitor(spark, sf):
    return risk.band_monitor(V.risk_scores(spark, sf), V.bookings(spark, sf), "v1", 0.19, 0.38)


@query("band_counts", with_views(["risk_scores"], f"""
SELECT count(*) AS scored, count(*) FILTER (no_show_probability < 0.19) AS low, count(*) FILTER (no_show_probability >= 0.19 AND no_show_probability < 0.38) AS medium,
  count(*) FILTER (no_show_probability >= 0.38) AS high FROM risk_scores"""))
def band_counts(spark, sf):
    return risk.band_counts(V.risk_scores(spark, sf), 0.19, 0.38)


REQUESTS_SQL = "req AS (SELECT l_orderkey AS booking_id, l_partkey * 10 + l_linenumber AS place FROM lineitem)"


@query("unscored_anti", with_views(["risk_scores"], f"""
WITH {REQUESTS_SQL} SELECT booking_id, min(place) AS place FROM req WHERE booking_id NOT IN (SELECT booking_id FROM risk_scores WHERE model_version = 'v1') GROUP BY booking_id"""))
def unscored_anti(spark, sf):
    li = V.table(spark, sf, "lineitem")
    asked = li.select(F.col("l_orderkey").alias("booking_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("place"))
    return risk.unscored_anti(asked, V.risk_scores(spark, sf), "v1")


@query("unscored_page", with_views(["risk_scores"], f"""
WITH {REQUESTS_SQL} SELECT booking_id, min(place) AS place FROM req WHERE booking_id NOT IN (SELECT booking_id FROM risk_scores WHERE model_version = 'v1')
GROUP BY booking_id ORDER BY 2, 1 LIMIT 200"""))
def unscored_page(spark, sf):
    li = V.table(spark, sf, "lineitem")
    asked = li.select(F.col("l_orderkey").alias("booking_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("place"))
    return risk.unscored_anti(asked, V.risk_scores(spark, sf), "v1", limit=200)


@query("upsert_by_key", with_views(["risk_scores", "bookings"], f"""
WITH fresh AS (SELECT booking_id, (booking_id * 31 % 997) / 997.0::DOUBLE AS no_show_probability, 'v2' AS model_version FROM bookings WHERE status = 'confirmed'),
u AS (SELECT * FROM risk_scores WHERE booking_id NOT IN (SELECT booking_id FROM fresh) UNION ALL SELECT * FROM fresh)
SELECT booking_id, {num('no_show_probability', 'no_show_probability')}, model_version FROM u"""))
def upsert_by_key(spark, sf):
    fresh = V.bookings(spark, sf).where(F.col("status") == "confirmed").select(
        "booking_id", ((F.col("booking_id") * 31 % 997) / F.lit(997.0)).alias("no_show_probability"), F.lit("v2").alias("model_version"))
    return upsert.upsert_by_key(V.risk_scores(spark, sf), fresh, ["booking_id"])


@query("union_reports", with_views(["scored"], f"""
SELECT 'cv' AS stage, fold, {num('avg(p)', 'mean_predicted')}, CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS prevalence FROM scored GROUP BY fold
UNION ALL SELECT 'holdout', NULL, {num('avg(p)', 'm')}, count(*), {num('avg(y)', 'v')} FROM scored"""))
def union_reports(spark, sf):
    s = V.scored(spark, sf)
    cv = s.groupBy("fold").agg(F.avg("p").alias("mean_predicted")).withColumn("stage", F.lit("cv"))
    holdout = s.agg(F.avg("p").alias("mean_predicted"), F.count(F.lit(1)).alias("n"), F.avg("y").alias("prevalence")).withColumn("stage", F.lit("holdout"))
    return upsert.union_reports(cv, holdout)
