import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitlake.llm import vector_dedup
from visitlake.llm.small_world import Graph, unit
from visitlake.llm.vector_dedup import forest, near_vectors


def brute(rows):
    """(vec_id, links, component) of every row by comparing all pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    near = np.zeros((len(rows), len(rows)), bool)
    for width in {len(v) for _, v in rows if v is not None}:
        own = [k for k, (_, v) in enumerate(rows) if good[k] and len(v) == width]
        if own:
            u = unit(np.array([rows[k][1] for k in own], np.float64))
            near[np.ix_(own, own)] = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(*np.nonzero(near)):
        root[find(a)] = find(b)
    label = {}
    for k, (i, _) in enumerate(rows):
        label[find(k)] = min(i, label.get(find(k), i))
    return sorted((i, int(near[k].sum()), label[find(k)], label[find(k)] == i) for k, (i, _) in enumerate(rows))


def test_graph_recall_in_tight_clusters():
    rng = np.random.default_rng(2)
    hub = rng.normal(size=32)
    vectors = np.concatenate([hub + 0.05 * rng.normal(size=(400, 32)), rng.normal(size=(2_000, 32)), np.repeat(rng.normal(size=(60, 32)), 6, axis=0) + 0.1 * rng.normal(size=(360, 32))])
    graph = Graph.load(Graph.build(np.arange(len(vectors)), vectors).dump())
    beam = graph.audit(vectors, 0.9, 16, 0.99, 20)
    q, at = graph.within(vectors, 0.9, beam)
    parts = list(graph.slices(vectors, 0.9, beam))
    assert sorted(zip(np.concatenate([p[0] for p in parts]).tolist(), np.concatenate([p[1] for p in parts]).tolist())) == sorted(zip(q.tolist(), at.tolist()))
    u = unit(vectors)
    truth = u @ u.T >= 0.9
    found = np.zeros_like(truth)
    found[q, graph.ids[at]] = True
    assert len(q) == found.sum() and not (found & ~truth).any()
    assert (found & truth).sum() >= 0.99 * truth.sum()


@pytest.mark.parametrize("shard_rows", [100_000, 60])
def test_links_and_components(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(vector_dedup, "SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 16))
    rows = [(1_000 - i, (base[i % 40] + 0.15 * rng.normal(size=16)).tolist()) for i in range(400)]
    rows += [(2_000 + i, base[0].tolist()) for i in range(150)] + [(3_000, (1e200 * base[1]).tolist()), (3_001, (1e-200 * base[1]).tolist())]
    rows += [(4_000, None), (4_001, []), (4_002, [0.0] * 16), (4_003, [None] + [1.0] * 15), (4_004, [float("nan")] * 16), (4_005, [float("inf")] + [1.0] * 15),
             (4_006, [1.0, 2.0]), (4_007, [2.0, 4.0]), (4_008, [-0.0] * 15 + [1.0]), (4_009, [0.0] * 15 + [1.0]), (4_009, [0.0] * 15 + [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("node", "key", "label", "vector", "shard")})
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    expected = brute(rows)
    # an approximate search may miss links, at this size it does not
    assert got == expected
    assert near_vectors(df.limit(0)).count() == 0


def test_forest_keeps_components():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    x, y = forest(a, b)
    assert len(x) < 150

    def parts(pairs):
        root = {}

        def find(n):
            while root.setdefault(n, n) != n:
                n = root[n]
            return n

        for m, n in pairs:
            m, n = find(m), find(n)
            root[max(m, n)] = min(m, n)
        return {n: find(n) for n in root if find(n) != n}

    assert parts(zip(a.tolist(), b.tolist())) == parts(zip(x.tolist(), y.tolist()))
    assert len(forest(np.empty(0, np.int64), np.empty(0, np.int64))[0]) == 0


def test_a_tie_at_the_threshold_links(spark):
    """(10, 0, 0, 0) and (9, 3, 3, 1) have length 10 and a cosine of exactly 0.9; one step less does not link."""
    rows = [(1, [10.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (3, [-10.0, 0.0, 0.0, 0.0]), (4, [-9.0, 3.0, 3.0, 1.001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_a_tight_cluster_is_linked_slice_by_slice(monkeypatch):
    """Every vector links with every other: the pairs come in slices that keep to the bound after the first, and none is lost."""
    from visitlake.llm import small_world

    monkeypatch.setattr(small_world, "PAIRS", 20_000)
    rng = np.random.default_rng(2)
    vectors = np.ones(16) + rng.normal(0, 0.01, (1_200, 16))
    graph = Graph.build(np.arange(1_200), vectors)
    beam = graph.audit(vectors, 0.9, 32, 0.995, 50)
    sizes = [len(q) for q, _ in graph.slices(vectors, 0.9, beam)]
    assert sum(sizes) == 1_200 ** 2 and max(sizes[1:]) <= 20_000 and sizes[0] <= small_world.FIRST_SLICE * 1_200


def test_a_graph_is_rows_of_one_node(spark, monkeypatch):
    """What a shuffle or a file holds of a graph is bounded by a vector and its links, and a task by some queries."""
    written = []

    def kept(df, name, *how, real=vector_dedup.materialise):
        out = real(df, name, *how)
        if name == "graphs":
            written.extend(out.selectExpr("length(links) as links", "size(vector) as width").collect())
        return out

    monkeypatch.setattr(vector_dedup, "materialise", kept)
    for name, value in (("SHARD_VALUES", 16 * 70), ("QUERY_ROWS", 30), ("BLOCK_ROWS", 50)):
        monkeypatch.setattr(vector_dedup, name, value)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + 0.15 * rng.normal(size=16)).tolist()) for i in range(300)] + [(500 + i, [1.0, i % 7 + 1.0]) for i in range(20)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == brute(rows) and len(written) == 307 and max(r["links"] for r in written) <= 3 * 104


def test_rows_make_the_graph_again():
    vectors = np.random.default_rng(3).normal(size=(2_500, 8))
    graph = Graph.build(np.arange(2_500), vectors)
    parts = list(graph.rows())
    again = Graph.of_rows(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [x for p in parts for x in p[2]])
    assert len(again.layers) == len(graph.layers) > 1 and all((a == b).all() for a, b in zip(again.layers, graph.layers)) and (again.ids == graph.ids).all()
