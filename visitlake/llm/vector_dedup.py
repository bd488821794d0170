"""Near-duplicate vectors: a small-world graph for each shard, every query asked of every shard, components of the links."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.llm.components import components
from visitlake.llm.small_world import Graph
from visitlake.llm.store import materialise

#: shards at least, vectors of a shard and numbers in them at most on average: what one task holds
SHARDS, SHARD_ROWS, SHARD_VALUES = 4, 100_000, 8_000_000
#: queries of one task, and those of them, with so many numbers at most, that are audited and asked together
BLOCK_ROWS, QUERY_ROWS, QUERY_VALUES = 200_000, 20_000, 2_000_000
BEAM, RECALL, AUDIT_EVERY = 32, 0.995, 50


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors are one node with a number of members, so a vector that is a third of the table is stored and asked once. Nodes are
    dealt to shards by hash; a shard's graph is built in one task and written, a row for each node. Every node is asked of every shard, in
    blocks: a task reads the rows of a graph, then its queries, `QUERY_ROWS` at a time, so neither graphs nor groups of queries are single
    rows or frames. The beam is doubled until an audit of every `AUDIT_EVERY`-th query against brute force finds `RECALL` of the pairs. Pairs count if
    their cosine in double precision is at least `threshold`. Links stay in the task, a bounded slice of them at a time: it returns how many members each query links to,
    and a spanning forest of the links, from which the components are put together.

    NULL and zero vectors and those with NULL or non-finite components link with nothing: no links, their own component, kept.
    Vectors of different length link with nothing of another length. Rows that repeat an id are separate rows. An empty table gives
    an empty result. Other columns are not read.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(F.col(f"`{vector_col}`"), lambda v: v.cast("double")).alias("vector"))
    good = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("vector", F.when(good, F.transform("vector", lambda v: v + F.lit(0.0))))  # -0.0 is 0.0
    rows = rows.withColumn("key", F.sha2(F.array_join(F.transform("vector", lambda v: v.cast("string")), ","), 256))
    classes = rows.where("key is not null").groupBy("key").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("label"), F.count(F.lit(1)).alias("members"))
    nodes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    n, longest = nodes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    shard_rows = max(1, min(SHARD_ROWS, SHARD_VALUES // max(1, longest or 0)))
    shards, blocks = max(SHARDS, -(-n // shard_rows)), max(3, -(-n // BLOCK_ROWS))
    dealt = nodes.withColumns({"shard": F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(shards)).cast("int"),
                               "block": F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(blocks)).cast("int"), "width": F.size("vector")})
    # tasks are numbered, so that none has two of them while another has none; vectors of another length shift the numbers
    task = lambda number, tasks: F.pmod(number + F.pmod(F.xxhash64("width"), F.lit(tasks)), F.lit(tasks)).cast("int")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, width), parts in _runs(batches, 2):
            held = [(p.column(2).to_numpy(), p.column(4).to_numpy(), _matrix(p.column(3), width)) for p in parts]
            names, members, vectors = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            graph = Graph.build(names, vectors)
            members, at = members[np.searchsorted(names, graph.ids)], 0
            for ids, own, links in graph.rows():
                lists = pa.FixedSizeListArray.from_arrays(pa.array(own.ravel()), width).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), shard, np.int32)), pa.array(np.full(len(ids), width, np.int32)), pa.array(np.arange(at, at + len(ids))),
                                                  pa.array(ids), pa.array(members[at:at + len(ids)]), lists, pa.array(links, pa.binary())], schema=GRAPH_ARROW)
                at += len(ids)

    own = dealt.select("shard", "width", "node", "vector", "members").withColumn("task", task(F.col("shard"), shards))
    own = own.repartitionById(shards, "task").sortWithinPartitions("shard", "width", "node").drop("task")
    graphs = materialise(own.mapInArrow(build, GRAPH), "graphs")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, width, _), parts in _runs(batches, 3):
            stored, queries, graph, members = [], [], None, None
            for part in parts:  # the graph's nodes come first
                cut = int(np.searchsorted(part.column(3).to_numpy(), 1))
                if cut:
                    own = part[:cut]
                    stored.append((own.column(5).to_numpy(), own.column(6).to_numpy(), _matrix(own.column(7), width), own.column(8).to_pylist()))
                if cut < part.num_rows and (stored or graph):
                    if graph is None:
                        links = [x for s in stored for x in s[3]]
                        ids, members, vectors = (np.concatenate([s[i] for s in stored]) for i in range(3))
                        stored.clear()
                        graph = Graph.of_rows(ids, vectors, links)
                        del links
                    queries.append((part.column(5)[cut:].to_numpy(), _matrix(part.column(7)[cut:], width)))
                    if sum(len(q[0]) for q in queries) >= max(1, min(QUERY_ROWS, QUERY_VALUES // max(1, width))):
                        yield _answers(graph, members, queries, threshold)
                        queries = []
            if queries:
                yield _answers(graph, members, queries, threshold)

    blocks_, shards_ = (F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name) for count, name in ((blocks, "block"), (shards, "shard")))
    none = F.lit(None).cast("binary").alias("links")
    copied = graphs.select("shard", "width", blocks_, F.lit(0).alias("kind"), "place", "node", "members", "vector", "links")
    asked = dealt.select(shards_, "width", "block", F.lit(1).alias("kind"), F.col("node").alias("place"), "node", "members", "vector", none)
    both = copied.unionByName(asked).withColumn("task", task(F.col("shard") * blocks + F.col("block"), shards * blocks))
    both = both.repartitionById(shards * blocks, "task").sortWithinPartitions("shard", "width", "block", "kind", "place").drop("task")
    answers = both.mapInArrow(ask, "node long, links long, other long")
    answers = materialise(answers, "answers")
    counts = answers.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(answers.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    whole = nodes.select("key", "node", "label", "members").join(counts, "node", "left").join(found, "node", "left")
    whole = whole.withColumn("component", F.coalesce("component", "node"))
    labels = whole.groupBy("component").agg(F.min("label").alias("component_id"))
    whole = whole.join(labels, "component").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    out = rows.select("vec_id", "key").join(whole, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


GRAPH = "shard int, width int, place long, node long, members long, vector array<double>, links binary"
GRAPH_ARROW = pa.schema([("shard", pa.int32()), ("width", pa.int32()), ("place", pa.int64()), ("node", pa.int64()), ("members", pa.int64()), ("vector", pa.list_(pa.float64())), ("links", pa.binary())])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """The rows of each key, the first `keys` columns, of sorted batches, a part at a time."""
    def cut() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(keys)]
            starts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(starts, starts[1:]):
                if hi > lo:
                    yield tuple(int(c[lo]) for c in columns), batch[lo:hi]

    for key, parts in groupby(cut(), key=lambda p: p[0]):
        yield key, (part for _, part in parts)


def _answers(graph: Graph, members: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> pa.RecordBatch:
    """node, links and other of some queries: the members that a query links to, and a forest of the links."""
    names, asked = (np.concatenate([q[i] for q in queries]) for i in range(2))
    beam = graph.audit(asked, threshold, BEAM, RECALL, AUDIT_EVERY)
    links, a, b = np.zeros(len(names), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for q, at in graph.slices(asked, threshold, beam):
        other = names[q] != graph.ids[at]
        q, at = q[other], at[other]
        links += np.bincount(q, weights=members[at], minlength=len(names)).astype(np.int64)
        a, b = forest(np.concatenate([a, names[q]]), np.concatenate([b, graph.ids[at]]))  # no more edges than nodes
    some = np.flatnonzero(links)
    columns = np.concatenate([names[some], a]), np.concatenate([links[some], np.zeros(len(a), np.int64)]), np.concatenate([names[some], b])
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "links", "other"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the links (a, b) connect: each node of a component but one with its smallest."""
    names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = index[:len(a)], index[len(a):]
    root = np.arange(len(names))
    while len(u):
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]
