"""The prefix trie of conversations, in shards of balanced parentheses whose shared spines are merged."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlake.llm.parentheses import range_least, trie_of
from visitlake.llm.store import materialise
from visitlake.operators.running import positions

#: turns of one shard on average: what a task holds
SHARD_TURNS = 100_000
_NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
          "key binary, parent_key binary, bytes long, shard long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), token (16 bytes that stand for role and text) and bytes (of the text in UTF-8) of every turn.

    Turns go by turn, NULL first, then role, then text. A NULL role or text is empty. Rows without conv_id are of no conversation and
    have no turn here.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    token = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
                                                             token.alias("token"), F.octet_length(text).cast("long").alias("bytes"))
    return positions(rows, ["conv_id"], ["turn", "role", "text"], "pos").select("conv_id", "pos", "token", "bytes")


def shared_openings(turns: DataFrame, period: int, opening: Column, most: int) -> DataFrame:
    """conv_id, pos, token, bytes: each conversation c with the first `opening` turns of c - c % period before its own turns after those.

    `opening` is a number from 0 to `most` made from conv_id. A conversation left without a turn has no row.
    """
    base = F.col("conv_id") - F.col("conv_id") % period
    own = turns.where(base == F.col("conv_id"))
    others = turns.where(base != F.col("conv_id")).withColumns({"base": base, "h": opening.cast("long")})
    given = own.where(F.col("pos") <= most).select(F.col("conv_id").alias("base"), "pos", "token", "bytes")
    long_as = given.groupBy("base").agg(F.max("pos").alias("there"))
    rest = others.where("pos > h").join(long_as, "base", "left")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("there", F.lit(0)))).alias("pos"), "token", "bytes")
    start = others.select("conv_id", "base", "h").distinct().join(given, "base").where("pos <= h").select("conv_id", "pos", "token", "bytes")
    return own.unionByName(rest).unionByName(start)


def ends_hashes(members: DataFrame) -> DataFrame:
    """rep and ends_sha256, the hash of the comma-joined ascending conv_ids of each rep, of rows of rep and conv_id.

    Ids are joined in parts over range partitions, so a rep of any size is sorted in many tasks; one task then feeds its parts to the
    hash, one after another.
    """
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, conv = batch.column(0).to_numpy(), batch.column(1)
            if not len(rep):
                continue
            starts = np.concatenate([[0], np.flatnonzero(rep[1:] != rep[:-1]) + 1])
            ends = np.append(starts[1:], len(rep))
            names = conv.cast(pa.string()).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(rep[starts]), conv.take(pa.array(starts)), pa.array([",".join(names[a:b]) for a, b in zip(starts, ends)])],
                                             names=["rep", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            done = []
            for rep, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if rep != current:
                    if state:
                        done.append((current, state.hexdigest()))
                    current, state = rep, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["rep", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([state.hexdigest()])], names=["rep", "ends_sha256"])

    joined = members.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").select("rep", "conv_id").mapInArrow(parts, "rep long, first long, ids string")
    return joined.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "ids").mapInArrow(digest, "rep long, ends_sha256 string")


def _spine_keys(tokens: np.ndarray, depth: int) -> list[bytes]:
    """A name for each prefix of a path up to `depth` turns."""
    state, out = hashlib.blake2b(digest_size=16), []
    for d in range(depth + 1):
        if d:
            state.update(tokens[d - 1].tobytes())
        out.append(state.copy().digest())
    return out


def shard_nodes(table: pa.Table) -> pa.Table:
    """The trie nodes of one shard: rows in order of `place`, with `left` and `right`, the turns its first path shares with the shard before
    and its last path with the shard after (-1 where there is none). Nodes so shared get a key, and what this shard has of their values."""
    table = table.sort_by("place").combine_chunks()
    lengths = np.array(table["length"].to_numpy(), np.int64)
    if len(lengths) == 0:
        return pa.Table.from_arrays([pa.array([], t) for t in _arrow()], schema=pa.schema(list(zip(_names(), _arrow()))))
    flat = table["path"].combine_chunks().flatten()
    tokens = np.frombuffer(b"".join(flat.to_pylist()), np.uint64).reshape(-1, 2)
    sizes = table["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    members, reps = table["members"].to_numpy().astype(np.int64), table["rep"].to_numpy().astype(np.int64)
    left, right, shard = (int(table[c][0].as_py()) for c in ("left", "right", "shard"))
    trie = trie_of(tokens, lengths)
    nodes = np.arange(len(trie.depth))
    starts = np.cumsum(lengths) - lengths
    text = np.zeros(len(nodes), np.int64)
    deep = trie.depth > 0
    text[deep] = sizes[starts[trie.path[deep]] + trie.depth[deep] - 1]
    lo, hi = np.searchsorted(trie.ends, nodes), np.searchsorted(trie.ends, trie.after)
    upto = np.concatenate([[0], np.cumsum(members)])
    n_convs = upto[hi] - upto[lo]
    keys: list[bytes | None] = [None] * len(nodes)
    for d, key in enumerate(_spine_keys(tokens[:int(lengths[0])], left)):
        keys[d] = key
    for d, key in enumerate(_spine_keys(tokens[starts[-1]:], right)):
        keys[trie.last[d]] = key
    spine = np.array([k is not None for k in keys])
    leaves = trie.leaves.copy()
    if right == lengths[-1]:
        leaves[trie.last] -= 1  # the last path goes on in the next shard, so its end is no leaf
    own = np.concatenate([[0], np.cumsum(np.where(spine, 0, (n_convs - 1) * text))])
    children = np.bincount(trie.parent[1:][~spine[1:]], minlength=len(nodes))
    least = range_least(reps, lo, hi)
    ends = np.full(len(nodes), None, object)
    ends[trie.ends] = table["ends_sha256"].to_pylist()
    ends[~spine & (ends == None)] = hashlib.sha256(b"").hexdigest()  # noqa: E711
    parent_keys = [keys[p] if i else None for i, p in enumerate(trie.parent.tolist())]
    inner = np.array([i > 0 and k is None for i, k in enumerate(parent_keys)])
    columns = [pa.array(least), pa.array(trie.depth), pa.array(least[trie.parent], mask=~inner), pa.array(n_convs), pa.array(children), pa.array(leaves),
               pa.array(own[trie.after] - own[nodes]), pa.array(ends.tolist(), pa.string()), pa.array(keys, pa.binary()), pa.array(parent_keys, pa.binary()),
               pa.array(text), pa.array(np.full(len(nodes), shard))]
    return pa.Table.from_arrays(columns, schema=pa.schema(list(zip(_names(), _arrow()))))


def _names() -> list[str]:
    return [c.split()[0] for c in _NODES.split(", ")]


def _arrow() -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return [kinds[c.split()[1]] for c in _NODES.split(", ")]


def prefix_trie(turns: DataFrame, conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` has conv_id, pos, token, bytes; `conversations` all conv_ids once, also those without a turn, which are members of the root alone.
    1. Conversations of equal paths are one path with members, found by sums of hashes, so copies are never gathered. 2. Distinct paths,
    sorted over the whole table, are cut into shards; each is a tree of balanced parentheses, from which every node that lies in one
    shard has its values. 3. A node whose subtree crosses shards is on the path that two neighbouring shards share; the parts of these
    spines are added up, and sums over the spine nodes below one follow from sums by shard.

    Without conversations there is no node, not even a root. A path is one row of 24 bytes a turn, whatever its texts.
    """
    half = [F.sum(F.xxhash64(F.lit(k), "pos", "token").cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    sums = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"), *half)
    paths = conversations.select("conv_id").join(sums, "conv_id", "left").na.fill(0, ["length"])
    zero = F.lit(0).cast("decimal(38,0)")
    paths = materialise(paths.withColumns({c: F.coalesce(c, zero) for c in ("s1", "s2")}), "paths")
    same = ["length", "s1", "s2"]
    classes = materialise(paths.groupBy(*same).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    several = ends_hashes(paths.join(classes.where("members > 1"), same).select("rep", "conv_id"))
    reps = classes.join(several, "rep", "left").select("rep", "members", "length", F.coalesce("ends_sha256", F.sha2(F.col("rep").cast("string"), 256)).alias("ends_sha256"))
    steps = turns.join(classes.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi")
    steps = steps.groupBy(F.col("conv_id").alias("rep")).agg(F.sort_array(F.collect_list(F.struct("pos", "token", "bytes"))).alias("steps"))
    whole = reps.join(steps, "rep", "left").select("rep", "members", "length", "ends_sha256",
                                                   F.coalesce(F.col("steps.token"), F.array().cast("array<binary>")).alias("path"),
                                                   F.coalesce(F.col("steps.bytes"), F.array().cast("array<bigint>")).alias("sizes"))
    total = classes.agg(F.sum(F.col("length") + 1)).first()[0] or 0
    shards = int(-(-total // shard_turns)) or 1
    cut = whole.repartitionByRange(shards, "path").sortWithinPartitions("path").withColumn("place", F.monotonically_increasing_id())
    cut = materialise(cut.withColumn("shard", F.shiftright("place", 33)), "sorted-paths")
    # a row for each shard: the turns that neighbouring shards share
    bounds = cut.groupBy("shard").agg(F.min_by("path", "place").alias("first"), F.max_by("path", "place").alias("last"))
    beside = Window.orderBy("shard")

    def shared(a: Column, b: Column) -> Column:
        differ = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
        return F.coalesce((F.array_position(differ, True) - 1).cast("long"), F.lit(-1))

    bounds = materialise(bounds.select("shard", shared(F.col("first"), F.lag("last").over(beside)).alias("left"),
                                       shared(F.col("last"), F.lead("first").over(beside)).alias("right")), "bounds")
    nodes = cut.join(F.broadcast(bounds), "shard").groupBy("shard").applyInArrow(shard_nodes, _NODES)
    nodes = materialise(nodes, "trie-nodes")
    spine = nodes.where("key IS NOT NULL").groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256"),
        F.max("parent_key").alias("parent_key"), F.max("bytes").alias("bytes"), F.min("shard").alias("owner"), F.max("shard").alias("until"))
    spine = materialise(spine.withColumn("weight", (F.col("n_convs") - 1) * F.col("bytes")), "spine")
    # spine nodes in preorder: by the shard that meets them first, then by depth; sums by shard first
    by_shard = bounds.join(spine.groupBy(F.col("owner").alias("shard")).agg(F.sum("weight").alias("w")), "shard", "left").select("shard", F.coalesce("w", F.lit(0)).alias("w"))
    upto = by_shard.select("shard", "w", F.sum("w").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"))
    upto = materialise(upto, "upto")
    below = F.sum("weight").over(Window.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spine = spine.withColumn("below", below).join(F.broadcast(upto.select(F.col("shard").alias("owner"), F.col("upto").alias("at_owner"))), "owner")
    spine = spine.join(F.broadcast(upto.select(F.col("shard").alias("until"), (F.col("upto") - F.col("w")).alias("before_last"))), "until")
    inner = spine.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    spine = spine.join(inner, "key", "left").select(
        "key", "parent_key", "conv_id", "depth", "n_convs", (F.col("n_children") + F.coalesce("more", F.lit(0))).alias("n_children"), "n_leaves",
        (F.col("saved_tokens") + F.col("below") + F.col("before_last") - F.col("at_owner")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    spine = materialise(spine, "merged-spine")
    parents = spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("from_spine"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    private = nodes.where("key IS NULL")
    inside = private.where("parent_key IS NULL").select(*out)
    crossing = private.where("parent_key IS NOT NULL").unionByName(spine, allowMissingColumns=True).join(parents, "parent_key", "left")
    crossing = crossing.withColumn("parent_conv_id", F.col("from_spine")).select(*out)
    return inside.unionByName(crossing)


def conversation_trie(conversations: DataFrame, period: int = 5, opening: Column | None = None, most: int = 8, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt on the opening of the first of its `period`.

    `conversations` has conv_id, turn, role, text; `opening` says how many turns of c - c % period open conversation c (0 to `most`), by
    default the unsigned crc32 of the decimal c modulo `most` + 1. % is that of SQL. Ties of a turn go by role, then text; repeated rows
    are turns of their own. NULL role and text are empty; rows without conv_id are left out, as they are of no conversation. An empty
    table gives an empty result. Other columns are not read.
    """
    opening = F.crc32(F.col("conv_id").cast("string")) % (most + 1) if opening is None else opening
    turns = materialise(ordered_turns(conversations.select("conv_id", "turn", "role", "text")), "turns")
    rebuilt = materialise(shared_openings(turns, period, opening, most), "rebuilt")
    return prefix_trie(rebuilt, turns.select("conv_id").distinct(), shard_turns)
