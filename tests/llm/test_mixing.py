from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from visitlake.llm.mixing import budgets, mix


def levels():
    return {"lang": F.col("lang"), "source": F.col("source")}


def brute_fill(budget, caps, weights):
    """Shares by pouring: give by weight, fix the full ones, pour what they refuse into the others."""
    share, free = {k: 0.0 for k in caps}, {k for k in caps if weights[k] > 0}
    left = min(budget, sum(caps[k] for k in free))
    while free:
        total = sum(weights[k] for k in free)
        full = {k for k in free if caps[k] <= left * weights[k] / total}
        if not full:
            share.update({k: left * weights[k] / total for k in free})
            break
        share.update({k: caps[k] for k in full})
        left -= sum(caps[k] for k in full)
        free -= full
    return share


@pytest.mark.parametrize("budget", [None, 10, 500, 2_000, 10 ** 9])
def test_shortages_go_to_siblings_first(spark, budget):
    supply = {("a", "x"): 10, ("a", "y"): 400, ("b", "x"): 300, ("b", "z"): 5, ("c", "w"): 700}
    weights = {("a",): 5, ("b",): 1, ("c",): 1, ("a", "x"): 9, ("*", "z"): 0}
    leaves = spark.createDataFrame([(*k, v, 1) for k, v in supply.items()], "l0 string, l1 string, supply long, n long")
    got = {(r.l0, r.l1): r.share for r in budgets(leaves, ["l0", "l1"], weights, budget, 2).collect()}
    wanted = min(budget if budget is not None else sum(supply.values()), 2 * sum(supply.values()))
    top = brute_fill(wanted, {d: 2 * sum(v for k, v in supply.items() if k[0] == d) for d in "abc"}, {"a": 5, "b": 1, "c": 1})
    for d in "abc":
        own = {k: 2 * v for k, v in supply.items() if k[0] == d}
        share = brute_fill(top[d], own, {k: weights.get(k, 0 if k[1] == "z" else 1) for k in own})
        for k, v in share.items():
            assert abs(got.get(k, 0) - v) <= 2


def test_prefixes_of_epochs(spark):
    rows = [(i, "en" if i % 3 else "de", f"s{i % 5}", 1 + i % 7) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, tokens long")
    out = mix(docs, levels(), {("en",): 1, ("de",): 2}, F.col("tokens"), seed="a").collect()
    used, epochs = defaultdict(int), defaultdict(lambda: defaultdict(set))
    supply = defaultdict(int)
    for i, lang, source, tokens in rows:
        supply[lang, source] += tokens
    for r in out:
        used[r.lang, r.source] += r.tokens
        assert r.doc_id not in epochs[r.lang, r.source][r.epoch]
        epochs[r.lang, r.source][r.epoch].add(r.doc_id)
    total = sum(supply.values())
    for leaf, n in used.items():
        target = total * (1 / 3 if leaf[0] == "en" else 2 / 3) / 5
        assert target - 10 <= n <= target + 1
        for epoch in range(n // supply[leaf]):  # whole epochs hold everything
            assert len(epochs[leaf][epoch]) == sum(1 for r in rows if (r[1], r[2]) == leaf)
    again = {(r.doc_id, r.epoch) for r in mix(docs.repartition(7), levels(), {("en",): 1, ("de",): 2}, F.col("tokens"), seed="a").collect()}
    assert again == {(r.doc_id, r.epoch) for r in out}
    other = {(r.doc_id, r.epoch) for r in mix(docs, levels(), {("en",): 1, ("de",): 2}, F.col("tokens"), seed="b").collect()}
    assert other != again


def test_both_ways_of_joining_leaves(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "en", f"s{i % 9}", 3) for i in range(900)], "doc_id long, lang string, source string, tokens long")
    a = {(r.doc_id, r.epoch) for r in mix(docs, levels(), {("en", "s1"): 5}, F.col("tokens")).collect()}
    monkeypatch.setattr("visitlake.llm.mixing.BROADCAST_LEAVES", 0)
    assert {(r.doc_id, r.epoch) for r in mix(docs, levels(), {("en", "s1"): 5}, F.col("tokens")).collect()} == a


def test_odd_rows(odd_docs, no_docs, clashing):
    out = mix(clashing, levels(), {}, max_epochs=1)
    assert sorted(out.columns) == sorted(clashing.columns)
    # all there is, once; leaves without a word give nothing
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in odd_docs.collect())
    assert mix(no_docs, levels(), {}).count() == 0
    assert mix(odd_docs, levels(), {("en",): 0}).where("lang = 'en'").count() == 0
    assert mix(odd_docs.where("doc_id < 3"), levels(), {}).count() == 0
    assert mix(odd_docs, levels(), {}, budget=0).count() == 0
