import random
from collections import defaultdict

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from visitlake.llm import set_join
from visitlake.llm.components import components
from visitlake.llm.shingles import shingle_sets
from visitlake.llm.set_join import similar_documents

SF = "/root/testdata/sf0.001"


def shingles(text, width):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, width, percent):
    """(doc_id, n, component) of every row by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    root[find(a)] = find(b)
    label = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            label[find(k)].append(i)
    return sorted((str(i), len(sets[k]), str(min(label[find(k)], default=None))) for k, (i, _) in enumerate(rows))


def spark_rows(spark, rows, width, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("node", "token", "n", "sig", "key")})
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar_documents(df, width, percent).collect())


def cluster(seed, copies, words, edits):
    """Near copies of one text that differ in some words, beside other texts that share one of its passages."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3_000)}" for _ in range(words)]
    rows = []
    for i in range(copies):
        own = base[:]
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((rng.randrange(10 ** 9), " ".join(own)))
    for _ in range(copies):
        own = [f"y{rng.randrange(10 ** 6)}" for _ in range(words)]
        own[5:5 + words // 2] = base[:words // 2]
        rows.append((rng.randrange(10 ** 9), " ".join(own)))
    return rows


@pytest.mark.parametrize(("width", "percent", "common"), [(4, 85, 64), (5, 80, 3), (3, 50, 2)])
def test_every_link_is_found(spark, monkeypatch, width, percent, common):
    """Also when few groups make a token common, so most documents show tokens beyond the low ones."""
    monkeypatch.setattr(set_join, "COMMON_GROUPS", common)
    rows = cluster(1, 60, 80, 12) + cluster(2, 30, 12, 4) + [(i, f"{i % 3} short") for i in range(9)]
    assert spark_rows(spark, rows, width, percent) == brute(rows, width, percent)


def test_joins_of_large_tables(spark, monkeypatch):
    monkeypatch.setattr(set_join, "SMALL_ROWS", 0)
    rows = cluster(3, 30, 60, 8)
    assert spark_rows(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows += [(50, "same id another text of some words"), (50, "same text here twice over"), (None, "same text here twice over"), (51, "A\x0bB\x1cb É"), (52, "a b\x1cb é"), (53, "a\u00a0b")]
    assert spark_rows(spark, rows, 4, 85) == brute(rows, 4, 85)
    assert similar_documents(no_docs, 4, 85).count() == 0
    only_empty = odd_docs.where("doc_id < 3")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(only_empty, 4, 85).collect()} == {(0, 0, 0), (1, 0, 1), (2, 0, 2)}


def test_query_as_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in entry.queries()["op10_set_join"](spark, SF).collect())
    assert got == brute(rows, 4, 85)


def test_shingle_sets_count_words_as_given():
    for text in ("a b c d e", "A b\tC\x0bd\x0ce a b c d", "é É é É é", "x", "", None, "a" * 50_000, "a b c", "c b a", " lead", "trail "):
        assert len(shingle_sets([text, "other words in a batch", text], 4)[2]) == len(shingles(text, 4))
    a, b = shingle_sets(["One two THREE four", "one Two three FOUR"], 4)
    assert a.tolist() == b.tolist()


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1_000, 1_000 + i) for i in range(1, 400)] + [(rng.randrange(2_000, 2_400), rng.randrange(2_000, 2_400)) for _ in range(250)]
    edges += [(5_000, 5_000), (None, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_that_do_not_link_open_few_members(spark, monkeypatch):
    """A group of near copies, and as many that differ in too many words to link: pairs grow with the copies, not with their square."""
    sizes, kept = {}, set_join.materialise

    def counted(df, name, *more):
        table = kept(df, name, *more)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(set_join, "materialise", counted)
    rng = random.Random(11)
    base, rows = [f"w{rng.randrange(3_000)}" for _ in range(140)], []
    for i in range(240):
        own = base[:]
        for _ in range(rng.randrange(7)):
            own[rng.randrange(140)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(own)))
    assert spark_rows(spark, rows, 5, 80) == brute(rows, 5, 80)
    assert sizes["pairs"] < 2 * len(rows)


def test_whole_sets_without_side_tables(spark, monkeypatch):
    """Where no id has a text twice, whole sets are made by one table written each time: every plan and job stays in the driver's memory."""
    names, kept = [], set_join.materialise

    def named(df, name, *more):
        names.append(name)
        return kept(df, name, *more)

    monkeypatch.setattr(set_join, "materialise", named)
    rows = cluster(5, 30, 60, 8) + [(None, "a text without an id and some words"), (None, "another text without an id and some words")]
    assert spark_rows(spark, rows, 4, 85) == brute(rows, 4, 85)
    assert names.count("sets") > 3 and not {"wanted", "again"} & set(names)
    names.clear()
    rows += rows[:10]
    assert spark_rows(spark, rows, 4, 85) == brute(rows, 4, 85)
    assert names.count("again") == names.count("sets")
