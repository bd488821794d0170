"""Classification metrics over tied and weighted scores, all from running counts over the distinct scores.

Rows are counted per distinct score first (partial aggregation), so ties cost nothing; the running counts are cut into score
ranges when a model or replicate has very many distinct scores.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .running import run_sum, running

# fixed values: precision targets and metric names
PRECISION_TARGETS = (0.30, 0.40, 0.50)
METRICS = ("auc_roc", "avg_precision", "brier", "sens_at_prec_30", "sens_at_prec_40", "sens_at_prec_50")


def _count_by_score(df: DataFrame, by: Sequence[str], y: str, score: str, weight: Column | None) -> DataFrame:
    w = F.lit(1).cast("long") if weight is None else weight
    return df.groupBy(*by, F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("tp"), F.sum(F.when(F.col(y) == 1, 0).otherwise(w)).alias("fp"))


def score_curve(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """From counts (by, s, tp, fp): add ctp and cfp, the counts at scores >= s."""
    down = counts.withColumn("neg_s", -F.col("s"))
    return running(down, list(by), ["neg_s"], {"ctp": run_sum(F.col("tp")), "cfp": run_sum(F.col("fp"))}).drop("neg_s")


def metrics_of_counts(counts: DataFrame, by: Sequence[str], targets: Sequence[float] = PRECISION_TARGETS) -> DataFrame:
    """The headline metrics per `by` from counts (by, s, tp, fp). Metrics are NULL when only one class is present.

    The AUC sums, for each score, its positives times the negatives below it plus half of those tied with it. Negatives below
    are all negatives minus cfp, so the sum needs the totals only at the end: sum(tp * (fp/2 - cfp)) + P * N.
    """
    precision = F.col("ctp").cast("double") / (F.col("ctp") + F.col("cfp"))
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    curve = score_curve(counts, by)
    sums = curve.groupBy(*by).agg(
        F.sum("tp").alias("n_positive"), F.sum(F.col("tp") + F.col("fp")).alias("n"),
        F.sum(tp * (fp / 2 - F.col("cfp"))).alias("__auc"), F.sum(tp * precision).alias("__ap"),
        F.sum(tp * F.pow(1 - F.col("s"), 2) + fp * F.pow(F.col("s"), 2)).alias("__brier"),
        *[F.max(F.when(precision >= t - 1e-12, F.col("ctp"))).alias(f"__r{i}") for i, t in enumerate(targets)])
    return metrics_of_sums(sums, by, targets)


def metrics_of_sums(sums: DataFrame, by: Sequence[str], targets: Sequence[float] = PRECISION_TARGETS) -> DataFrame:
    """The metrics from n, n_positive, __auc, __ap, __brier and __r0, __r1, ... per `by`."""
    pos = F.col("n_positive").cast("double")
    neg = F.col("n") - pos
    both = (pos > 0) & (neg > 0)
    out = {
        "auc_roc": F.try_divide(F.col("__auc") + pos * neg, pos * neg),
        "avg_precision": F.try_divide(F.col("__ap"), pos),
        "brier": F.try_divide(F.col("__brier"), F.col("n")),
    }
    for i, t in enumerate(targets):
        out[f"sens_at_prec_{round(t * 100)}"] = F.try_divide(F.coalesce(F.col(f"__r{i}"), F.lit(0)).cast("double"), pos)
    return sums.select(*by, "n", "n_positive", *[F.when(both, c).alias(name) for name, c in out.items()])


def binary_metrics(df: DataFrame, y: str, score: str, by: Sequence[str] = (), weight: str | None = None,
                   targets: Sequence[float] = PRECISION_TARGETS) -> DataFrame:
    """AUC (ties half), average precision (step sum), Brier and recall at precision targets, per `by`.

    With `weight`, equal to repeating each row that often.
    """
    rows = df if weight is None else df.where(F.col(weight) > 0)
    return metrics_of_counts(_count_by_score(rows, by, y, score, None if weight is None else F.col(weight)), by, targets)


def fold_metrics(df: DataFrame, y: str, scores: Sequence[str], fold: str = "fold") -> DataFrame:
    """Per variant (score column): mean and SD over folds of AUC, AP and Brier, and paired deltas to the first variant."""
    long = df.select(fold, y, F.inline(F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(s).alias("variant"), F.col(s).alias("score")) for i, s in enumerate(scores)])))
    per_fold = binary_metrics(long, y, "score", ["rank", "variant", fold])
    base = per_fold.where(F.col("rank") == 0).select(F.col(fold).alias("__f"), F.col("auc_roc").alias("auc0"), F.col("avg_precision").alias("ap0"))
    joined = per_fold.join(base, F.col(fold) == F.col("__f"))
    return (joined.groupBy("rank", "variant").agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("auc_roc").alias("cv_auc_mean"), F.stddev_samp("auc_roc").alias("cv_auc_std"),
        F.avg("avg_precision").alias("cv_ap_mean"), F.stddev_samp("avg_precision").alias("cv_ap_std"), F.avg("brier").alias("cv_brier_mean"),
        F.avg(F.col("auc_roc") - F.col("auc0")).alias("delta_auc"), F.stddev_samp(F.col("auc_roc") - F.col("auc0")).alias("delta_auc_std"),
        F.avg(F.col("avg_precision") - F.col("ap0")).alias("delta_ap")).drop("rank"))


# ---- thresholds ---------------------------------------------------------------------------------------------------
def on_grid(df: DataFrame, y: str, score: str, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positives per grid cell: cell i holds scores in [i/steps, (i+1)/steps). At most steps + 2 rows per key.

    The cell is found by comparing with the same doubles i/steps that serve as thresholds, so the edge cases agree.
    """
    s = F.col(score)
    near = F.floor(s * steps).cast("int")
    # floor can be off by one next to an edge: correct it against the edge itself
    cell = F.when(s >= (near + 1) / F.lit(float(steps)), near + 1).when(s < near / F.lit(float(steps)), near - 1).otherwise(near)
    cell = F.least(F.greatest(cell, F.lit(-1)), F.lit(steps))
    return df.where(s.isNotNull()).groupBy(*by, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("tp"))


def grid_table(df: DataFrame, y: str, score: str, steps: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """For every threshold i/steps, i = 1..steps-1 (all listed): flagged, true positives, totals."""
    cells = on_grid(df, y, score, steps, by)
    empty = cells.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = empty.select(*by, F.explode(F.sequence(F.lit(-1), F.lit(steps))).alias("cell"))
    full = grid.join(cells, [*by, "cell"], "left").fillna(0, ["n", "tp"])
    down = Window.partitionBy(*by).orderBy(F.desc("cell"))  # at most steps + 2 rows
    every = Window.partitionBy(*by)
    out = full.select(*by, "cell", F.sum("n").over(down).alias("flagged_n"), F.sum("tp").over(down).alias("tp"),
                      F.sum("n").over(every).alias("n"), F.sum("tp").over(every).alias("n_positive"))
    return (out.where((F.col("cell") >= 1) & (F.col("cell") < steps))
            .select(*by, (F.col("cell") / F.lit(float(steps))).alias("threshold"), "flagged_n", "tp", "n", "n_positive"))


def threshold_for_precision(df: DataFrame, y: str, score: str, targets: Sequence[float], min_share: float = 0.01, steps: int = 100) -> DataFrame:
    """Per target: the lowest grid threshold at which precision is met there and at every higher one flagging min_share.

    NULL when the highest such threshold already misses the target.
    """
    table = grid_table(df, y, score, steps).where(C.ratio(F.col("flagged_n"), F.col("n")) >= min_share)
    long = table.select("threshold", C.ratio(F.col("tp"), F.col("flagged_n")).alias("precision"),
                        F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target"))
    from_top = Window.partitionBy("target").orderBy(F.desc("threshold"))
    held = long.withColumn("held", F.min((F.coalesce(F.col("precision"), F.lit(-1.0)) >= F.col("target")).cast("int")).over(from_top))
    found = held.groupBy("target").agg(F.min(F.when(F.col("held") == 1, F.col("threshold"))).alias("threshold"))
    listed = df.sparkSession.createDataFrame([(float(t),) for t in targets], "target double")
    return listed.join(F.broadcast(found), "target", "left")


def threshold_table(df: DataFrame, y: str, score: str, ranges: Sequence[tuple[str, float, float]], by: Sequence[str] = (),
                    weight: Column | None = None) -> DataFrame:
    """Flagged, share, precision and sensitivity for each named half-open range [low, high): one pass, no join.

    Each range is a pair of conditional sums, so rows are never multiplied by the number of ranges.
    """
    w = F.lit(1) if weight is None else weight
    s, hit = F.col(score), F.when(F.col(y) == 1, w).otherwise(0)
    aggs = []
    for i, (_, low, high) in enumerate(ranges):
        inside = (s >= F.lit(low)) & (s < F.lit(high))
        aggs += [F.sum(F.when(inside, w).otherwise(0)).alias(f"f{i}"), F.sum(F.when(inside, hit).otherwise(0)).alias(f"t{i}")]
    one = df.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(hit).alias("n_positive"), *aggs)
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(float(low)).alias("low"), F.col(f"f{i}").cast("long").alias("flagged_n"),
                              F.col(f"t{i}").cast("long").alias("tp")) for i, (label, low, _) in enumerate(ranges)])
    long = one.select(*by, "n", "n_positive", F.inline(rows))
    return long.select(*by, "label", "low", "flagged_n", C.ratio(F.col("flagged_n"), F.col("n")).alias("share_flagged"),
                       C.ratio(F.col("tp"), F.col("flagged_n")).alias("precision"), C.ratio(F.col("tp"), F.col("n_positive")).alias("sensitivity"))


def band_ranges(medium: float, high: float) -> list[tuple[str, float, float]]:
    return [("low", 0.0, medium), ("medium", medium, high), ("high", high, float("inf"))]


def _point(tp: Column, flagged: Column, positives: Column) -> dict[str, Column]:
    precision = F.coalesce(C.ratio(tp, flagged), F.lit(0.0))
    recall = F.coalesce(C.ratio(tp, positives), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return {"precision": precision, "recall": recall, "f1": f1}


def operating_points(df: DataFrame, y: str, score: str, cutoffs: Sequence[float]) -> DataFrame:
    """precision, recall, F1 (0 when undefined) and accuracy of score >= cutoff, for each cutoff."""
    s = F.col(score)
    aggs = []
    for i, c in enumerate(cutoffs):
        aggs += [F.count_if(s >= F.lit(c)).alias(f"f{i}"), F.count_if((s >= F.lit(c)) & (F.col(y) == 1)).alias(f"t{i}")]
    one = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("pos"), *aggs)
    rows = F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"f{i}").alias("flagged_n"), F.col(f"t{i}").alias("tp")) for i, c in enumerate(cutoffs)])
    long = one.select("n", "pos", F.inline(rows))
    right = F.col("n") - F.col("pos") - F.col("flagged_n") + 2 * F.col("tp")
    return long.select("cutoff", *[c.alias(k) for k, c in _point(F.col("tp"), F.col("flagged_n"), F.col("pos")).items()],
                       C.ratio(right, F.col("n")).alias("accuracy"))


def argmax(df: DataFrame, keys: Sequence[str], value: str, rank: str, lowest: bool = False) -> DataFrame:
    """The row with the best value per key; on a tie the one with the lowest rank. A partial aggregation, not a window."""
    best = -F.col(value) if not lowest else F.col(value)
    packed = F.struct(*[F.col(c) for c in df.columns])
    out = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(packed, F.struct(best, F.col(rank))).alias("r"))
    return out.select("r.*")


def best_cutoff(df: DataFrame, y: str, score: str, cutoffs: Sequence[float]) -> DataFrame:
    """The cutoff with the best F1, the first one on ties."""
    return argmax(operating_points(df, y, score, cutoffs), [], "f1", "cutoff")


def best_f1_threshold(df: DataFrame, y: str, score: str) -> DataFrame:
    """The observed score with the best F1; on ties the lowest, which comes first in score order."""
    curve = score_curve(_count_by_score(df, [], y, score, None), [])
    total = df.agg(F.count_if(F.col(y) == 1).alias("pos"))
    f1 = F.try_divide(2.0 * F.col("ctp"), F.col("ctp") + F.col("cfp") + F.col("pos"))
    rated = curve.crossJoin(F.broadcast(total)).select(F.col("s").alias("threshold"), f1.alias("f1"))
    return argmax(rated, [], "f1", "threshold")
