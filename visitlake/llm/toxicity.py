"""Toxicity of whole texts: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlake.llm.set_join import beside
from visitlake.llm.store import materialise

#: characters of an n-gram, and buckets their hashes fall into: what the driver and every task hold is bounded by these
ORDERS, BUCKET_BITS = (3, 4, 5), 18
#: n-grams that enter the classifier at most: the most significant of those met in enough labelled texts
FEATURES, LEAST_TEXTS, LEAST_Z = 4_096, 5, 4.0
#: counts added to both classes before the ratio
SMOOTHING = 1.0
PENALTY, ITERATIONS = 1e-3, 60
#: characters worked on at a time; a longer text is cut here only for the work, its n-grams stay whole
BATCH_CHARS = 500_000
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, max(ORDERS) + 1, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class ToxicityModel:
    """weights by bucket (0 where a bucket is no feature), whether a bucket is a feature, and the intercept."""
    weights: np.ndarray
    chosen: np.ndarray
    intercept: float


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about `BATCH_CHARS` characters, each with the place of its first text."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end] or "") <= BATCH_CHARS):
            chars += len(texts[end] or "")
            end += 1
        yield at, texts[at:end]
        at = end


def _codes(text: str | None) -> np.ndarray:
    """Lower-case code points between two spaces; white space and control characters are spaces."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return np.where(codes < 33, np.uint64(32), codes)


def grams(texts: list[str | None], bits: int = BUCKET_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every n-gram of every text, in parts of bounded size; a part may repeat a pair, and so may two parts."""
    most = max(ORDERS)
    codes = [_codes(t) for t in texts]
    whole = np.concatenate(codes)
    ends = np.cumsum([len(c) for c in codes])
    for at in range(0, len(whole), BATCH_CHARS):
        part = whole[at:at + BATCH_CHARS + most - 1]
        starts = np.arange(at, min(at + BATCH_CHARS, len(whole)))
        row = np.searchsorted(ends, starts, "right")
        sums = np.zeros(len(starts), np.uint64)
        for n in range(1, most + 1):
            size = max(0, len(part) - n + 1)
            sums = sums[:size] + part[n - 1:n - 1 + len(starts)][:size] * _FACTORS[n]
            if n in ORDERS:
                inside = starts[:size] + n <= ends[row[:size]]
                hashed = (sums ^ (sums >> np.uint64(29)) ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
                yield row[:size][inside], (hashed >> np.uint64(64 - bits)).astype(np.int64)[inside]


def present(texts: list[str | None], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, of the chosen buckets if given, sorted by text."""
    parts = []
    for row, bucket in grams(texts):
        if chosen is not None:
            kept = chosen[bucket]
            row, bucket = row[kept], bucket[kept]
        parts.append((row << BUCKET_BITS) | bucket)
    keys = np.sort(np.concatenate(parts))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)]]
    return keys >> BUCKET_BITS, keys & ((1 << BUCKET_BITS) - 1)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """text and label (0 or 1) of the documents with a label; of several labels of one id the largest counts, NULL ids and labels never."""
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), (F.col(f"`{label_col}`") > 0).cast("int").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return beside(texts, materialise(known, "labels"), ["doc_id"]).select("text", "label")


def count_grams(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labelled texts of each class that have each bucket's n-grams, and the number of texts of each class; over all rows.

    A task adds its texts up before the shuffle, so the shuffle has a row for each bucket and task at most.
    """
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros((2, size), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            texts, label = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for at, group in _groups(texts):
                row, bucket = present(group)
                for k in (0, 1):
                    found[k] += np.bincount(bucket[label[at + row] == k], minlength=size)
            rows += np.bincount(label, minlength=2)
        some = np.flatnonzero(found.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(found[0, some], rows[0])),
                                          pa.array(np.append(found[1, some], rows[1]))], names=["bucket", "clean", "toxic"])

    counted = labelled.select("text", "label").mapInArrow(count, "bucket long, clean long, toxic long")
    table = counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    clean, toxic = np.zeros(size, np.int64), np.zeros(size, np.int64)
    kept = table[table["bucket"] >= 0]
    clean[kept["bucket"]], toxic[kept["bucket"]] = kept["clean"], kept["toxic"]
    total = table[table["bucket"] < 0]
    return clean, toxic, np.array([total["clean"].sum(), total["toxic"].sum()])


def log_count_ratios(clean: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log ratio of each bucket's smoothed share of toxic and of clean texts, and which buckets are features.

    A feature is in at least `LEAST_TEXTS` texts and its share differs by `LEAST_Z` standard errors; of more than `FEATURES` the
    most significant stay, smaller numbers first among equals.
    """
    p, q = (toxic + SMOOTHING) / (rows[1] + 2 * SMOOTHING), (clean + SMOOTHING) / (rows[0] + 2 * SMOOTHING)
    both = (clean + toxic) / rows.sum()
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / rows[0] + 1 / rows[1]))
    z = np.where(clean + toxic >= LEAST_TEXTS, np.abs(toxic / rows[1] - clean / rows[0]) / error, 0.0)
    best = np.lexsort((np.arange(len(z)), -z))[:FEATURES]
    chosen = np.zeros(len(z), bool)
    chosen[best[z[best] >= LEAST_Z]] = True
    return np.log(p / q), chosen


def fit(labelled: DataFrame) -> ToxicityModel:
    """The classifier of rows of text and label (0 or 1).

    Counts and ratios come from all rows, and so does the logistic regression, on the distinct chosen n-grams of each text, each
    as large as its ratio. Without rows the score is 0; with rows of one class, or without a feature, it is the share of label 1.
    """
    clean, toxic, rows = count_grams(labelled)
    none = np.zeros(1 << BUCKET_BITS)
    if not rows.all():
        return ToxicityModel(none, none > 0, np.inf if rows[1] else -np.inf)
    ratio, chosen = log_count_ratios(clean, toxic, rows)
    if not chosen.any():
        return ToxicityModel(none, chosen, float(np.log(rows[1] / rows[0])))
    places = np.flatnonzero(chosen)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at, group in _groups(texts):
                row, bucket = present(group, chosen)
                bounds = np.searchsorted(row, np.arange(len(group) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.searchsorted(places, bucket).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(at, len(group)).cast(pa.float64())], names=["places", "label"])

    scale, width = ratio[places], len(places)

    @F.udf(VectorUDT(), useArrow=False)
    def vector(found: list[int]) -> SparseVector:
        return SparseVector(width, found, scale[found])

    table = materialise(labelled.select("text", "label").mapInArrow(sparse, "places array<int>, label double"), "features")
    model = LogisticRegression(maxIter=ITERATIONS, regParam=PENALTY, standardization=False).fit(table.select("label", vector("places").alias("features")))
    weights = none.copy()
    weights[places] = model.coefficients.toArray() * scale
    return ToxicityModel(weights, chosen, float(model.intercept))


def score_column(text: Column, model: ToxicityModel) -> Column:
    """The probability of label 1 of a whole text; NULL is empty, and an empty text has the score of the intercept."""
    shared = (model.weights, model.chosen, model.intercept)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, chosen, intercept = shared
        for batch in batches:
            texts, sums = [t if isinstance(t, str) else None for t in batch], np.full(len(batch), intercept)
            for at, group in _groups(texts):
                row, bucket = present(group, chosen)
                sums[at:at + len(group)] += np.bincount(row, weights=weights[bucket], minlength=len(group))
            with np.errstate(over="ignore"):
                yield pd.Series(1 / (1 + np.exp(-sums)))

    # asked once a row: predicted is made from the same answer
    return score.asNondeterministic()(text)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from a score of 0.5).

    Whole texts count, however long. NULL and empty texts get the score of no n-gram. Repeated rows get equal scores. An empty table
    gives an empty result. Columns of these names are replaced, all others stay.
    """
    scored = docs.withColumn("score", score_column(F.col(f"`{text_col}`"), model))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
