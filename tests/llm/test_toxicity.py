import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitlake.llm import toxicity
from visitlake.llm.queries import op11_toxicity

BAD = ["vrotzak", "smelnik", "grubbel"]


def corpus(rnd, n):
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice("abdeilmnorstu") for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(5, 120))]
        toxic = int(rnd.random() < 0.2)
        for _ in range(toxic * rnd.randint(1, 3)):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        rows.append((i, " ".join(words), toxic))
    return rows


def plain_grams(text):
    """The n-grams of a text as strings."""
    padded = " " + "".join(" " if ord(c) < 33 else c for c in text.lower()) + " "
    return {padded[i:i + n] for n in toxicity.ORDERS for i in range(len(padded) - n + 1)}


def test_distinct_grams_equal_plain_ones(monkeypatch):
    texts = ["Ab ab\tab", "", None, "x", "éÉ ü 漢字漢字", "same same same"]
    for batch in (500_000, 4):
        monkeypatch.setattr(toxicity, "BATCH_CHARS", batch)
        row, bucket = toxicity.present(texts)
        for k, text in enumerate(texts):
            alone = toxicity.present([text])[1]
            assert sorted(bucket[row == k]) == sorted(alone) and len(alone) == len(plain_grams(text or ""))


def test_counts_and_ratios_equal_plain_counts(spark):
    rows = [(t, y) for _, t, y in corpus(random.Random(5), 60)] + [(None, 0), ("", 1)]
    clean, toxic, n = toxicity.count_grams(spark.createDataFrame(rows, "text string, label int").repartition(5))
    assert n.tolist() == [sum(1 - y for _, y in rows), sum(y for _, y in rows)]
    for word in ("vrotz", "smeln", " an ", "lik"):
        bucket = toxicity.present([word])[1]
        for b in bucket.tolist():
            has = [y for t, y in rows if b in set(toxicity.present([t])[1].tolist())]
            assert (clean[b], toxic[b]) == (has.count(0), has.count(1))


def test_held_out_accuracy_and_what_is_not_learned_from(spark):
    rows = corpus(random.Random(6), 900)
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    rest = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)

    def run(known):
        model = toxicity.fit(toxicity.labelled_texts(rest, known))
        return {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(docs, model).collect()}

    scores = run(labels)
    right = [scores[i][1] == y for (i, _, y), h in zip(rows, held) if h]
    assert np.mean(right) > 0.97
    lies = run(labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert all(scores[i] == pytest.approx(lies[i], abs=1e-9) for i in scores)


def test_odd_documents_and_labels(spark, odd_docs, clashing, no_docs):
    labels = spark.createDataFrame([(0, 1), (3, 0), (4, None), (None, 1), (4, 1), (4, 0)], "doc_id long, toxic int")
    known = {(r["text"], r["label"]) for r in toxicity.labelled_texts(odd_docs, labels).collect()}
    assert known == {(None, 1), ("word", 0), ("same text here twice over", 1)}
    model = toxicity.fit(toxicity.labelled_texts(odd_docs, labels))
    plain = toxicity.score(odd_docs, model)
    assert plain.count() == odd_docs.count() and plain.where("score BETWEEN 0 AND 1 AND predicted = CAST(score >= 0.5 AS INT)").count() == odd_docs.count()
    assert len({r["score"] for r in plain.where("text IS NULL OR text = ''").collect()}) == 1
    other = toxicity.score(clashing, model)
    assert set(clashing.columns) <= set(other.columns) and sorted(r["score"] for r in other.collect()) == sorted(r["score"] for r in plain.collect())
    assert toxicity.score(no_docs, model).count() == 0
    for rows, want in (([], 0.0), ([(3, 0)], 0.0), ([(3, 1)], 1.0)):
        alone = toxicity.fit(toxicity.labelled_texts(odd_docs, spark.createDataFrame(rows, "doc_id long, toxic int")))
        assert {r["score"] for r in toxicity.score(odd_docs, alone).collect()} == {want}


def test_query_columns(spark):
    found = op11_toxicity(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
