"""Calibrators of scores: a sigmoid of the log odds, and isotonic regression pooled range by range."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: blocks that one task pools in a round
RANGE_ROWS = 100_000
_BLOCKS = "lo double, hi double, y double, w double"


def log_odds(p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.ln(clipped / (1 - clipped))


def pool(lo: np.ndarray, hi: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjacent violators pooled: blocks of rising means, from blocks in order of their scores. Equal means are one block."""
    stack: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), y.tolist(), w.tolist()):
        a, b, mean, weight = block
        while stack and stack[-1][2] >= mean:
            first, _, m, v = stack.pop()
            a, mean, weight = first, (m * v + mean * weight) / (v + weight), v + weight
        stack.append([a, b, mean, weight])
    return tuple(np.array(x, float) for x in zip(*stack)) if stack else (np.zeros(0),) * 4


def isotonic_blocks(scored: DataFrame, score: str, label: str, weight: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """lo, hi, y, w: the blocks of the isotonic regression of `label` on `score`, in order.

    Equal scores are one block with their weight. Score ranges are pooled side by side, each giving its stack of blocks; then wider
    ranges are cut from all blocks, until one task takes them all or a round over ranges pools nothing more and neighbours rise.
    Pooling in parts and then together gives what pooling at once gives. NULL scores and labels and weights not above 0 are left out.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0),) * 4
        for batch in batches:  # sorted: what is pooled so far and the next batch
            held = pool(*(np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)))
        yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], names=["lo", "hi", "y", "w"])

    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = scored.select(F.col(score).cast("double").alias("lo"), F.col(label).cast("double").alias("y"), w.alias("w")).where("lo IS NOT NULL AND y IS NOT NULL AND w > 0")
    merged = rows.groupBy("lo").agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("y"), F.sum("w").alias("w"))
    blocks = stored(merged.select("lo", F.col("lo").alias("hi"), "y", "w"), "blocks")
    n = blocks.count()
    while True:
        ranges = -(-n // range_rows)
        cut = blocks.repartitionByRange(max(1, ranges), "lo").sortWithinPartitions("lo").mapInArrow(work, _BLOCKS)
        blocks = stored(cut, "blocks")
        left = blocks.count()
        if ranges <= 1 or left == n:
            # a round that pools nothing leaves violators only where two ranges meet: move the borders before giving up
            if ranges <= 1 or not _violators(blocks):
                return blocks
            range_rows = range_rows + range_rows // 2
        n = left


def _violators(blocks: DataFrame) -> bool:
    from ..operators.running import previous

    return not previous(blocks, [], ["lo"], ["y"]).where("previous_y >= y").isEmpty()


class ScoreCalibrator(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Replaces the column `p`: by a sigmoid of its log odds (two numbers) or along the blocks of an isotonic regression."""
    method = Param(Params._dummy(), "method", "sigmoid or isotonic", TypeConverters.toString)
    xs = Param(Params._dummy(), "xs", "slope, or the scores at which blocks begin and end", TypeConverters.toListFloat)
    ys = Param(Params._dummy(), "ys", "intercept, or the blocks' values", TypeConverters.toListFloat)

    def __init__(self, method: str | None = None, xs: list[float] | None = None, ys: list[float] | None = None):
        super().__init__()
        if method:
            self._set(method=method, xs=xs, ys=ys)

    def _transform(self, df: DataFrame) -> DataFrame:
        xs, ys = self.getOrDefault(self.xs), self.getOrDefault(self.ys)
        if self.getOrDefault(self.method) == "sigmoid":
            return df.withColumn("p", 1 / (1 + F.exp(-(xs[0] * log_odds(F.col("p")) + ys[0]))))

        @F.pandas_udf("double")
        def along(p: pd.Series) -> pd.Series:
            found = np.interp(p.to_numpy(float), xs, ys) if xs else np.full(len(p), np.nan)
            return pd.Series(found).where(p.notna().to_numpy(), None)

        return df.withColumn("p", along("p"))


def fit_calibrator(scored: DataFrame, method: str, label: str) -> ScoreCalibrator:
    """The calibrator of the column p of `scored`; between the blocks of an isotonic one values are interpolated."""
    if method == "sigmoid":
        vec = VectorAssembler(inputCols=["__z"], outputCol="__v", handleInvalid="skip")
        model = LogisticRegression(featuresCol="__v", labelCol=label, maxIter=100).fit(vec.transform(scored.select(label, log_odds(F.col("p")).alias("__z"))))
        return ScoreCalibrator("sigmoid", [float(model.coefficients[0])], [float(model.intercept)])
    blocks = isotonic_blocks(scored, "p", label).orderBy("lo").toPandas()
    xs, ys = [], []
    for lo, hi, y in zip(blocks["lo"], blocks["hi"], blocks["y"]):
        xs += [lo] if lo == hi else [lo, hi]
        ys += [y] if lo == hi else [y, y]
    return ScoreCalibrator("isotonic", [float(x) for x in xs], [float(y) for y in ys])
