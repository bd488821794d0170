from collections import defaultdict

from pyspark.sql import functions as F

from visitlake.llm.exact_dedup import drop_copies, exact_classes


def answers(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in df.collect())


def test_white_space_is_one_space_and_smallest_id_stays(spark):
    df = spark.createDataFrame([(3, "a  b\n"), (1, "a\tb "), (2, "a b"), (4, "A b ")], "doc_id long, text string")
    assert answers(exact_classes(df)) == [(False, 1, 1, 2, True), (False, 2, 2, 1, True), (False, 3, 1, 2, False), (False, 4, 4, 1, True)]
    assert sorted(r.doc_id for r in drop_copies(df).collect()) == [1, 2, 4]


def test_bytes_decide_when_hashes_collide(spark):
    """With a hash of three values every group holds many texts; the classes stay those of the texts."""
    rows = [(i, f"text {i % 40}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = exact_classes(df, content_hash=lambda c: F.pmod(F.xxhash64(c), F.lit(3)))
    classes = defaultdict(list)
    for i, t in rows:
        classes[t].append(i)
    expected = sorted((False, i, min(classes[t]), len(classes[t]), i == min(classes[t])) for i, t in rows)
    assert answers(weak) == expected


def test_odd_rows(odd_docs, no_docs, clashing):
    got = answers(exact_classes(odd_docs))
    assert len(got) == odd_docs.count() and answers(exact_classes(clashing)) == got
    by_id = {g[1]: g for g in got if not g[0]}
    assert by_id[0][2:4] == (0, 2) and by_id[1][2] == 0  # NULL and empty are equal
    assert by_id[4] == (False, 4, 4, 3, True) and by_id[5][4] is False
    kept = drop_copies(clashing)
    assert kept.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "2", "3", "4", "6", "None"]
    assert exact_classes(no_docs).count() == 0 and drop_copies(no_docs).count() == 0
