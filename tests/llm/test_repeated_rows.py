import random

import corpus_pipeline as pipeline

from tests.llm.test_set_join import brute, cluster, spark_rows
from visitlake.llm import set_join


def common_texts(rng, count, words, variants):
    """Short texts that differ in one word from a text that shares its words with many others."""
    rows = []
    for i in range(count):
        base = [f"c{rng.randrange(30)}" for _ in range(words)]
        for v in range(variants):
            own = base[:]
            own[rng.randrange(words)] = f"u{i}_{v}"
            rows.append((1_000 * i + v, " ".join(own)))
    return rows


def test_rows_that_repeat_id_and_text(spark, monkeypatch):
    """A set fetched again counts once, however many rows have its id and text, or its text and no id."""
    monkeypatch.setattr(set_join, "COMMON_GROUPS", 2)
    rng = random.Random(8)
    rows = [r for r in common_texts(rng, 60, 14, 3) for _ in range(6)] + [(None, t) for _, t in cluster(2, 20, 12, 3) for _ in range(5)]
    assert spark_rows(spark, rows, 1, 80) == brute(rows, 1, 80)


def test_each_wanted_set_once(spark):
    rows = [(None, f"text number {i} without any id") for i in range(20) for _ in range(9)] + [(7, "one id and one text")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    seen = []
    later = set_join._sets_of

    def sets_of(*args):
        seen.append(later(*args))
        return seen[-1]

    set_join._sets_of = sets_of
    try:
        set_join.similar_documents(docs, 1, 50).count()
    finally:
        set_join._sets_of = later
    assert seen and any(s.count() for s in seen)
    assert all(s.count() == s.select("node").distinct().count() for s in seen)


def test_near_copies_go_by_row(spark):
    text = [f"w{i}" for i in range(60)]
    near = " ".join(text[:-1] + ["end"])
    bare = [f"v{i}" for i in range(60)]
    rows = [(1, " ".join(text)), (2, near), (2, "another text of the same id with words of its own"), (None, " ".join(text[:-1] + ["stop"])),
            (None, " ".join(bare)), (None, " ".join(bare[:-1] + ["end"])), (None, "a text without an id that is like no other"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted((r for r in kept if "v0" not in (r[1] or "")), key=str) == sorted([rows[0], rows[2], rows[6], rows[7]], key=str)
    assert sum(t is not None and "v0" in t for _, t in kept) == 1
    assert len(kept) == 5
