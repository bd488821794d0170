import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from visitlake.llm.parentheses import range_least, trie_of
from visitlake.llm.prefix_trie import conversation_trie, ends_hashes

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, opening=lambda c: zlib.crc32(str(c).encode()) % 9):
    """The nodes of the trie from the definition."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {c: turns.get(c - c % 5, [])[:opening(c)] + ts[opening(c):] for c, ts in turns.items()}
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        parents = {n[:-1] for n in members if n}
        ends = ",".join(map(str, sorted(c for c, ts in rebuilt.items() if tuple(ts) == node)))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                    sum(1 for n in members if n and n[:-1] == node), sum(1 for n in below if n not in parents),
                    sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows, **how):
    frame = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, TURNS)
    return sorted([tuple(r[c] for c in COLUMNS) for r in conversation_trie(frame, **how).collect()], key=str)


def random_rows(seed, convs, turns):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(3 * convs), convs):
        rows += [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "é", "ab", None, ""])) for t in range(rnd.randint(1, turns))]
    return rows


@pytest.mark.parametrize("seed,convs,turns,shard_turns", [(1, 60, 6, 1_000), (2, 60, 6, 25), (3, 40, 12, 5), (4, 80, 4, 1)])
def test_equal_to_brute_force_however_many_shards(spark, seed, convs, turns, shard_turns):
    rows = random_rows(seed, convs, turns)
    assert nodes(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_odd_rows(spark):
    long = "z" * 300_000
    rows = [(0, None, "user", "first"), (0, 1, None, None), (0, 1, None, None), (0, 2, "user", long), (5, 0, "", ""), (5, 0, "a", "y"), (5, 0, "a", "x"),
            (7, 3, "user", "own"), (None, 1, "user", "of no conversation"), (13, 0, "user", "base is absent")]
    rows += [(20 + k, t, "user", "a copy") for k in range(40) for t in (1, 2)] + [(100, t, "user", f"turn {t}") for t in range(200)]
    for shard_turns in (2, 10_000):
        assert nodes(spark, rows, shard_turns=shard_turns) == brute(rows)
    assert nodes(spark, []) == []
    turnless = [(4, 0, "user", "goes")]  # 4 - 4 % 5 is absent and 4 has an opening of its own
    assert nodes(spark, turnless) == brute(turnless)


def test_other_columns_and_a_large_conversation(spark, cut_large):
    from pyspark.sql import functions as F

    rows = random_rows(9, 20, 5) + [(500, t % 70, "user", str(t)) for t in range(150)]
    frame = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("pos", "token", "bytes", "key", "path", "rep", "h", "base", "shard", "depth")})
    assert nodes(spark, frame, shard_turns=40) == brute(rows)


@pytest.fixture
def cut_large(spark):
    from visitlake.operators.running import HOT_ROWS_CONF

    spark.conf.set(HOT_ROWS_CONF, "20")
    yield
    spark.conf.unset(HOT_ROWS_CONF)


def test_hash_of_many_members(spark):
    members = spark.range(25_000).selectExpr("IF(id % 3 = 0, 0, id % 7) AS rep", "id AS conv_id")
    got = {r["rep"]: r["ends_sha256"] for r in ends_hashes(members).collect()}
    want = defaultdict(list)
    for i in range(25_000):
        want[0 if i % 3 == 0 else i % 7].append(str(i))
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}


def test_parentheses_find_every_subtree():
    for seed in range(60):
        rnd = random.Random(seed)
        width, deepest = rnd.choice([1, 2, 5]), rnd.choice([1, 4, 12, 300])
        paths = sorted({tuple(rnd.randrange(width) for _ in range(rnd.randint(0, deepest))) for _ in range(rnd.choice([1, 3, 40]))})
        trie = trie_of(np.array([[x, 0] for p in paths for x in p], np.uint64).reshape(-1, 2), np.array([len(p) for p in paths], np.int64))
        order = list(dict.fromkeys(p[:d] for p in paths for d in range(len(p) + 1)))
        parents = {n[:-1] for n in order if n}
        at = {n: i for i, n in enumerate(order)}
        assert trie.depth.tolist() == [len(n) for n in order]
        assert [order[p] for p in trie.parent[1:]] == [n[:-1] for n in order[1:]]
        size, leaves = defaultdict(int), defaultdict(int)
        for n in order:
            for d in range(len(n) + 1):
                size[n[:d]] += 1
                leaves[n[:d]] += n not in parents
        assert trie.after.tolist() == [at[n] + size[n] for n in order] and trie.leaves.tolist() == [leaves[n] for n in order]
        assert [order[e] for e in trie.ends] == paths and [order[e] for e in trie.last] == [paths[-1][:d] for d in range(len(paths[-1]) + 1)]
    values = np.random.default_rng(1).integers(0, 1000, 50)
    lo = np.arange(50).repeat(3)
    hi = np.minimum(50, lo + np.tile([1, 7, 50], 50))
    assert range_least(values, lo, hi).tolist() == [values[a:b].min() for a, b in zip(lo, hi)]
