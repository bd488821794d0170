"""Exact Jaccard join of word-shingle sets with a token-group matrix.

Similar documents form groups; a group stores the union of its members' tokens; a query opens a group only if the group's union has
enough of the query's tokens. Which tokens go into the matrix follows the prefix principle: two sets as similar as asked for share
tokens among the first few of each under any fixed order of all tokens, so the matrix needs these alone, and an order that puts common
tokens last keeps its rows short.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlake.llm.components import components
from visitlake.llm.shingles import mix, shingle_sets
from visitlake.llm.store import materialise

#: bands of two minimum hashes each that bring similar documents together to form the groups; they decide nothing
BANDS = 6
#: the tokens that come first in the order are a share of the hash range: what a set shows of its tokens at least, and this much more
MORE_LOW = 0.07
#: a token of more groups than this is common and goes last
COMMON_GROUPS = 64
#: rounds in which nodes meet the hubs of the groups found so far; they decide nothing
HUB_ROUNDS = 3
#: one more shared token is asked for every so many tokens of a set
EXTRA_EVERY = 50
#: a table of ids up to this size is sent to all tasks; a larger one is joined by shuffle
SMALL_ROWS = 1_000_000
#: characters of texts whose shingles are made at a time (a longer text alone): a worker's arrays are as long as its longest slice
BATCH_CHARS = 400_000
#: pairs of whole sets that a Python worker gets at a time
BATCH_PAIRS = 100
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, 2 * BANDS, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Similar:
    """Two sets link when 100 * intersection >= percent * union; shingles have `width` words."""
    width: int
    percent: int

    @property
    def low_limit(self) -> int:
        """Tokens below it come first in the order."""
        return int((1 - self.percent / 100 + MORE_LOW) * 2.0 ** 64)

    def need(self, n: Column) -> Column:
        """Tokens of a set of n that a similar set has at least."""
        return F.ceil(n * self.percent / 100).cast("bigint")

    def prefix(self, n: Column) -> Column:
        """How many of its first tokens a set shows: all but `need`, one more, and those for the extra matches."""
        return n - self.need(n) + self.extra(n)

    def rest(self, n: Column) -> Column:
        """Tokens that a set of n does not show."""
        return n - self.prefix(n)

    def may_link(self, n: Column, m: Column, shared: Column) -> Column:
        """Whether sets of n and m tokens that share so many shown ones may be similar.

        The set whose shown tokens end first shares no other of them, so the intersection is at most `shared` and its other tokens.
        """
        most = shared + F.greatest(self.rest(n), self.rest(m))
        return (100 + self.percent) * most >= self.percent * (n + m)

    def extra(self, n: Column) -> Column:
        return F.lit(1) + F.floor(n / EXTRA_EVERY).cast("bigint")

    def least_matches(self, n: Column) -> Column:
        """Shown tokens that a set of n shares with any similar set, which has `need(n)` tokens at least."""
        return F.lit(1) + F.floor(self.need(n) / EXTRA_EVERY).cast("bigint")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (.., text) in slices of bounded length."""
    for batch in batches:
        ends = np.cumsum([0, *(len(t or "") for t in batch.column(batch.num_columns - 1).to_pylist())])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_CHARS, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def profiles(docs: DataFrame, sim: Similar) -> DataFrame:
    """doc_id, text_hash, n, sig (128-bit hash of the set), bands and sorted low tokens of every row of doc_id, text_hash and text."""
    schema = T.StructType([docs.schema["doc_id"], docs.schema["text_hash"], T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()),
                           T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("low", T.ArrayType(T.LongType()))])

    limit = np.uint64(sim.low_limit)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            sets = shingle_sets(part.column(2).to_pylist(), sim.width)
            bands = np.zeros((len(sets), BANDS), np.int64)
            for i, s in enumerate(sets):
                if len(s):
                    least = np.array([mix(s * seed).min() for seed in _SEEDS])
                    bands[i] = mix(least[::2] * np.uint64(3) + least[1::2]).view(np.int64)
            band_lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
            low = [s[:np.searchsorted(s, limit)] for s in sets]
            ends = np.cumsum([0] + [len(x) for x in low])
            low_lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(low).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()),
                                              band_lists, low_lists], names=schema.names)
        pa.default_memory_pool().release_unused()  # the worker outlives this step

    return docs.select("doc_id", "text_hash", "text").mapInArrow(work, schema)


def signature(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, its whole set as bytes and the task that made it, of rows of node, sig and text whose text has that signature.

    Rows that repeat a node's text have the same set, so a task makes a node's set once.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), set()
        for part in _slices(batches):
            fresh = [k for k, node in enumerate(part.column(0).to_pylist()) if node not in made]
            part = part.take(pa.array(fresh, pa.int64()))
            nodes, sigs, texts = (column.to_pylist() for column in part.columns)
            sets, own = shingle_sets(texts, width), []
            for k, (node, sig) in enumerate(zip(nodes, sigs)):
                if node not in made and signature(sets[k]) == sig:
                    made.add(node)
                    own.append(k)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own, pa.int64())), pa.array([sets[k].tobytes() for k in own], pa.binary()),
                                              pa.array([task] * len(own), pa.int32())], names=["node", "tokens", "task"])
        pa.default_memory_pool().release_unused()

    return docs.select("node", "sig", "text").mapInArrow(work, "node long, tokens binary, task int")


def beside(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a table that is small as a rule: sent to all tasks up to `SMALL_ROWS`, else joined by shuffle."""
    small = table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return rows.join(F.broadcast(table) if small else table, on, how)


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar, by their whole sets."""
    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            out.append(100 * common >= percent * ((len(x) + len(y)) // 8 - common))
        pa.default_memory_pool().release_unused()
        return pd.Series(out, dtype=bool)

    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(similar("ta", "tb")).select("a", "b")


def similar_documents(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    return linked_rows(docs, width, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def text_hash(text: str) -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(F.col(f"`{text}`"))


def linked_rows(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`similar_documents` with text_hash and component, the number of the component (NULL without words).

    1. Equal sets are one node. 2. Documents that share a band of minimum hashes meet the smallest of them, are compared with it by
    their whole sets, and what links forms the groups: one comparison a row and band, however many share it. 3. The matrix: each
    node's first tokens, with its group. A node asks only groups of more members than its own (of equal ones, the larger number), as
    a link is the same from both sides. 4. A group is opened if its union has enough of the query's shown tokens, its sizes
    allow a link, the query does not link with its hub, and the union has enough of the query's whole set; of its members, those that share as many are compared, the most promising first, the others only where that
    one did not link. The result is exact: every pair of similar sets ends in one component.

    Tokens are 64-bit hashes of shingles; equal hashes of different shingles are too rare to move a decision. NULL and empty texts
    and texts without words have an empty set and link with nothing. Rows that repeat an id are separate rows with a set each. NULL
    ids can be linked but are never the smallest. An empty table gives an empty result. Other columns are not read.
    """
    sim = Similar(width, percent)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    profile = materialise(profiles(texts, sim).withColumn("uid", F.monotonically_increasing_id()), "profile")
    # 1: nodes
    filled = profile.where("n > 0")
    # the text of a node is found again by its hash and, where there is one, its smallest id
    key = F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("key")
    nodes = materialise(filled.groupBy("sig").agg(F.min("uid").alias("node"), F.min("doc_id").alias("label"), key, F.first("n").alias("n"),
                                                  F.first(F.size("low")).cast("bigint").alias("low"), F.first("bands").alias("bands")), "nodes")
    wholes = Wholes(texts, nodes, sim, few=nodes.count() <= SMALL_ROWS, repeats=_repeats(filled))
    # 2: groups
    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    first = banded.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "a")
    meet = banded.join(first, "band").where("node <> a").select("a", F.col("node").alias("b"), F.col("n").alias("nb")).distinct()
    meet = meet.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").where(_sizes_fit("na", "nb", percent)).select("a", "b")
    meet = materialise(meet, "meet")
    sets = _sets_of(wholes, meet.select(F.col("a").alias("node")).union(meet.select("b")))
    star = materialise(linked_pairs(meet, sets, percent), "star", BATCH_PAIRS)
    met_before = meet
    lows = filled.select(F.col("uid").alias("node"), "low")
    for _ in range(HUB_ROUNDS):
        groups = materialise(components(star), "groups")
        hubs = materialise(_hubs(groups, lows), "hubs")
        more = materialise(_meet_hubs(nodes, banded, groups, hubs, met_before, percent), "meet-hubs")
        met_before = met_before.unionByName(more)
        links = materialise(linked_pairs(more, sets, percent), "star", BATCH_PAIRS)
        star = star.unionByName(links)
        if links.isEmpty():
            break
    else:
        groups = materialise(components(star), "groups")
        hubs = materialise(_hubs(groups, lows), "hubs")
    # 3: the matrix
    placed = materialise(nodes.join(groups, "node", "left").select("sig", "node", "n", "low", F.coalesce("component", "node").alias("grp")), "placed")
    group_sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    rows = filled.select("uid", F.explode("low").alias("token"))
    shared = rows.groupBy("token").agg(F.min("uid").alias("first"), F.max("uid").alias("last")).where("first <> last").select("token")
    # a node is the row it was first seen in, so rows of copies find no node
    met = rows.join(shared, "token").withColumnRenamed("uid", "node").join(placed.select("node", "n", "grp", "low"), "node")
    met = materialise(met, "met")
    spread = met.select("token", "grp").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    flagged = met.join(spread.select("token", "c", (F.col("c") > COMMON_GROUPS).alias("common")), "token")
    flagged = materialise(flagged, "flagged")
    # rare tokens first: those of one group alone, then by the number of groups that have them
    order = Window.partitionBy("node").orderBy("c", "token")
    alone = F.col("low") - F.count(F.lit(1)).over(Window.partitionBy("node"))
    usual = (flagged.withColumn("place", alone + F.row_number().over(order) - 1)
             .where(~F.col("common") & (F.col("place") < sim.prefix(F.col("n")))).select("token", "node", "grp", "n"))
    commons = flagged.where("common").groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    room = placed.join(commons, "node", "left").withColumn("missing", sim.prefix(F.col("n")) - F.col("low") + F.coalesce("c", F.lit(0))).where("missing > 0")
    more = _later_tokens(wholes, materialise(room.select("node", "grp", "n", "missing"), "room"), flagged)
    sizes = group_sizes.select(F.col("component").alias("grp"), "size")
    shown = usual.unionByName(more)
    shown = materialise(shown.join(sizes, "grp", "left").withColumn("size", F.coalesce("size", F.lit(1))), "shown")
    # 4: queries
    matrix = shown.groupBy("token", F.col("grp").alias("other"), F.col("size").alias("other_size")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    asks = shown.join(matrix, "token").where("grp <> other and (size < other_size or (size = other_size and grp < other))")
    asks = (asks.groupBy("node", "n", "other", "other_size").agg(F.count(F.lit(1)).alias("c"), F.min("least").alias("least"), F.max("most").alias("most"))
            .withColumns({"low": F.greatest("least", sim.need(F.col("n"))), "high": F.least("most", F.floor(100 * F.col("n") / percent).cast("bigint"))})
            # between the smallest and the largest size that may link, one of these two asks for the fewest shared tokens (less 2, as sizes are rounded)
            .where((F.col("c") >= sim.least_matches(F.col("n"))) & (F.col("low") <= F.col("high"))
                   & (sim.may_link(F.col("n"), F.col("low"), F.col("c") + 2) | sim.may_link(F.col("n"), F.col("high"), F.col("c") + 2))))
    asks = materialise(asks.select("node", "n", "other", "other_size", "c", "low", "least"), "asks")
    # a group of one is its node: what they share is known
    alone = (asks.where("other_size = 1").select(F.col("node").alias("a"), F.col("other").alias("b"), "other", F.col("n").alias("na"), F.col("least").alias("nb"), "c")
             .where(_sizes_fit("na", "nb", percent)))
    asks = asks.where("other_size > 1").select("node", "n", "other", "low")
    # the hub of a group first: a node that links with it need not open the group
    heads = asks.join(hubs.select(F.col("component").alias("other"), "hub"), "other").select(F.col("node").alias("a"), F.col("hub").alias("b"), "other")
    heads = materialise(heads, "heads")
    known = sets.select("node")
    asked = heads.select(F.col("a").alias("node")).union(heads.select("b")).distinct().join(known, "node", "left_anti")
    sets = sets.unionByName(_sets_of(wholes, asked))
    head_links = materialise(linked_pairs(heads.select("a", "b"), sets, percent), "head-links", BATCH_PAIRS)
    joined = heads.join(head_links, ["a", "b"]).select(F.col("a").alias("node"), "other")
    asks = materialise(asks.join(joined, ["node", "other"], "left_anti"), "asks-left")
    # the others: by whole sets, which are alike but for few tokens within a group
    members = placed.select("node", F.col("n").alias("nb"), F.col("grp").alias("other")).join(asks.select("other").distinct(), "other", "left_semi")
    known = sets.select("node")
    sets = sets.unionByName(_sets_of(wholes, members.select("node").join(known, "node", "left_anti")))
    centres, opened = _open_groups(asks, members, sets, percent)
    pairs = opened.unionByName(alone.where((F.col("c") >= F.least(sim.extra(F.col("na")), sim.extra(F.col("nb")))) & sim.may_link(F.col("na"), F.col("nb"), F.col("c")))
                               .select("a", "b", "other", "c"))
    pairs = materialise(pairs.select("a", "b", "other", "c"), "pairs")
    known = sets.select("node")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(known, "node", "left_anti")
    sets = sets.unionByName(_sets_of(wholes, asked))
    best = pairs.groupBy("a", "other").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
    first_links = materialise(linked_pairs(best.select("a", "b"), sets, percent), "first-links", BATCH_PAIRS)
    done = best.join(first_links, ["a", "b"]).select("a", "other")
    rest = pairs.join(done, ["a", "other"], "left_anti").join(best.select("a", "b"), ["a", "b"], "left_anti").select("a", "b")
    other_links = materialise(linked_pairs(rest, sets, percent), "other-links", BATCH_PAIRS)
    found = components(star.union(head_links).union(centres).union(first_links).union(other_links))
    # smallest id of each component, back to the rows by the set
    labels = nodes.join(found, "node", "left").select("sig", "label", F.coalesce("component", "node").alias("component"))
    labels = labels.join(labels.groupBy("component").agg(F.min("label").alias("component_id")), "component").select("sig", "component", "component_id")
    out = profile.join(labels, "sig", "left")
    return out.select("doc_id", "text_hash", "component", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _repeats(filled: DataFrame) -> bool:
    """Whether several rows have the same id (or none) and the same text."""
    most = filled.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0]
    return most is not None and most > 1


@dataclass(frozen=True)
class Wholes:
    """What whole sets are made from."""
    texts: DataFrame
    nodes: DataFrame
    sim: Similar
    #: the nodes, and so any part of them, are a table that is sent to all tasks
    few: bool
    #: a node's text may be found in several rows
    repeats: bool


def _sets_of(wholes: Wholes, wanted: DataFrame) -> DataFrame:
    """Whole sets of the wanted nodes, one row each, from a text with the node's smallest id (any of its rows where none has an id)."""
    ids = wholes.nodes.join(wanted.distinct(), "node", "left_semi").select("key", "label", "node", "sig")
    keyed = wholes.texts.select("doc_id", "text", F.col("text_hash").alias("key"))
    found = keyed.join(F.broadcast(ids), ["key"]) if wholes.few else beside(keyed, materialise(ids, "wanted"), ["key"])
    found = found.where(F.col("label").isNull() | (F.col("doc_id") == F.col("label")))
    sets = materialise(full_sets(found, wholes.sim.width), "sets")
    if not wholes.repeats:
        return sets.select("node", "tokens")
    # rows that repeat a text may have met in several tasks; only nodes and tasks are read here
    made = sets.groupBy("node").agg(F.min("task").alias("first"), F.max("task").alias("last")).where("first <> last")
    again = sets.select("node", "task").join(made, "node").where("task <> first").select("node", "task")
    return beside(sets, materialise(again, "again"), ["node", "task"], "left_anti").select("node", "tokens")


def _later_tokens(wholes: Wholes, room: DataFrame, flagged: DataFrame) -> DataFrame:
    """The shown tokens beyond the low ones, of nodes whose low tokens are too few or too common: token, node, grp, n.

    First tokens outside the low range, those that few groups of such nodes have before the others; then the common low ones.
    """
    whole = _sets_of(wholes, room.select("node"))

    limit = np.uint64(wholes.sim.low_limit)

    @F.pandas_udf("array<long>")
    def numbers(raw: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, np.int64)[np.searchsorted(np.frombuffer(x, np.uint64), limit):] for x in raw])

    later = whole.join(room, "node").withColumn("high", numbers("tokens")).select("node", "grp", "n", "missing", F.size("high").alias("all_high"), F.explode("high").alias("token"))
    later = materialise(later, "later")
    spread = later.select("token", "grp").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = later.join(spread, "token").withColumn("low", F.lit(False))
    last = flagged.where("common").select("node", "grp", "n", "token", "c").join(room.select("node", "missing"), "node").withColumn("low", F.lit(True))
    # tokens of one group alone, which are not listed, take the first places
    high = later.groupBy("node").agg(F.first("all_high").alias("all_high"))
    ranked = shared.drop("all_high").unionByName(last).join(high, "node", "left")
    own = Window.partitionBy("node")
    alone = F.coalesce("all_high", F.lit(0)) - F.sum(F.when(F.col("low"), 0).otherwise(1)).over(own)
    place = alone + F.row_number().over(own.orderBy("c", "token"))
    return ranked.withColumn("place", place).where("place <= missing").select("token", "node", "grp", "n")


def _tokens(sets: DataFrame) -> DataFrame:
    """node and each token of its whole set."""
    @F.pandas_udf("array<long>")
    def numbers(raw: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, np.int64) for x in raw])

    return sets.select("node", F.explode(numbers("tokens")).alias("token"))


def _open_groups(asks: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of askers with their groups' centres, and the pairs (a, b, other, c) that may link of the asks which that leaves.

    The core of a group are the tokens that most members have, its centre the member nearest to the core. Two sets share no more than
    the lesser of their parts in the core and what they share outside. So a pair that may link either shares tokens outside, which few
    members have, or its parts in the core are enough alone, which the centre mostly settles. Of an asker's outside tokens as many as it
    has to share, less one, need not be looked up; those that most members have are left out.
    """
    enough = lambda c, n, m: (100 + percent) * c >= percent * (n + m)
    tokens = members.join(_tokens(sets.join(members, "node", "left_semi")), "node")
    sizes = members.groupBy("other").agg(F.count(F.lit(1)).alias("size"))
    tokens = tokens.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("other", "token"))).join(sizes, "other")
    marked = materialise(tokens.withColumn("core", 2 * F.col("held") > F.col("size")).drop("size"), "marked-tokens")
    held = marked.select("other", "token", "held", "core").distinct()
    inside = marked.groupBy("other", "node", "nb").agg(F.count_if("core").alias("in_b"))
    centre = inside.groupBy("other").agg(F.max_by("node", F.struct(2 * F.col("in_b") - F.col("nb"), -F.col("node"))).alias("b"))
    first = materialise(asks.join(centre, "other").select(F.col("node").alias("a"), "b", "other"), "centres")
    links = materialise(linked_pairs(first.select("a", "b"), sets, percent), "centre-links", BATCH_PAIRS)
    asks = asks.join(first.join(links, ["a", "b"]).select(F.col("a").alias("node"), "other"), ["node", "other"], "left_anti")
    asks = asks.select(F.col("node").alias("a"), F.col("n").alias("na"), "other", "low")
    own = _tokens(sets.join(asks.select(F.col("a").alias("node")), "node", "left_semi")).withColumnRenamed("node", "a")
    own = materialise(asks.join(own, "a").join(held, ["other", "token"]), "own-tokens")
    asked = own.groupBy("a", "na", "other", "low").agg(F.count_if("core").alias("in_a"), F.count_if(~F.col("core")).alias("out_a"))
    # with fewer tokens in the whole union than a link asks for, no member links
    asked = asked.where(enough(F.col("in_a") + F.col("out_a"), F.col("na"), F.col("low")))
    lack = F.ceil(percent * (F.col("na") + F.col("low")) / (100 + percent)).cast("bigint") - F.col("in_a")
    asked = materialise(asked.withColumn("spare", F.greatest(lack - 1, F.lit(0))), "asked")
    rarest = F.row_number().over(Window.partitionBy("a", "other").orderBy("held", "token"))
    outer = (own.where(~F.col("core")).select("a", "other", "token", "held").join(asked, ["a", "other"])
             .withColumn("place", rarest).where(F.col("place") <= F.col("out_a") - F.col("spare")))
    there = marked.where(~F.col("core")).select("other", "token", F.col("node").alias("b"))
    shared = outer.join(there, ["other", "token"]).groupBy("a", "na", "b", "other", "in_a", "spare").agg(F.count(F.lit(1)).alias("c"))
    within = inside.withColumnRenamed("node", "b")
    outside = shared.join(within, ["other", "b"]).withColumn("c", F.least("in_a", "in_b") + F.col("c") + F.col("spare"))
    alike = asked.where(enough(F.col("in_a"), F.col("na"), F.col("low"))).join(within, "other").withColumn("c", F.least("in_a", "in_b"))
    both = outside.select("a", "b", "other", "na", "nb", "c").unionByName(alike.select("a", "b", "other", "na", "nb", "c"))
    both = both.where(_sizes_fit("na", "nb", percent) & enough(F.col("c"), F.col("na"), F.col("nb")))
    return links, both.groupBy("a", "b", "other").agg(F.max("c").alias("c"))


def _hubs(groups: DataFrame, lows: DataFrame) -> DataFrame:
    """component, size and hub of every group: the member whose low tokens differ least from those of all members, the smallest among equals."""
    tokens = groups.join(lows, "node").select("component", "node", F.explode("low").alias("token"))
    counts = tokens.groupBy("component", "token").agg(F.count(F.lit(1)).alias("c"))
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    shared = tokens.join(counts, ["component", "token"]).groupBy("node").agg(F.sum("c").alias("shared"), F.count(F.lit(1)).alias("own"))
    near = groups.join(sizes, "component").join(shared, "node", "left")
    # of the sums of differing tokens over all members, the part that depends on the member
    nearness = F.coalesce(2 * F.col("shared") - F.col("own") * F.col("size"), F.lit(0))
    return near.groupBy("component").agg(F.first("size").alias("size"), F.max_by("node", F.struct(nearness, -F.col("node"))).alias("hub"))


def _meet_hubs(nodes: DataFrame, banded: DataFrame, groups: DataFrame, hubs: DataFrame, before: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): a node outside the largest group of one of its bands, and that group's hub; one pair a node and band at most."""
    sized = hubs.join(nodes.select(F.col("node").alias("hub"), F.col("n").alias("nh")), "hub")
    member = banded.join(groups, "node", "left")
    tops = member.join(sized, "component").groupBy("band").agg(F.max(F.struct("size", "component", "hub", "nh")).alias("top")).select("band", "top.*")
    pairs = member.select("band", "node", "n", F.col("component").alias("mine")).join(tops, "band").where(
        F.col("mine").isNull() | (F.col("mine") != F.col("component"))).where(_sizes_fit("n", "nh", percent))
    pairs = pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    return pairs.join(before.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
