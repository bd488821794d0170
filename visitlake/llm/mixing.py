"""Mixing sources to target weights: budgets down a tree of domains, languages and sources, then token prefixes of seeded epochs."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlake.llm.store import materialise

#: hash digits read at a time when a leaf's cut is searched: 16^3 buckets a leaf and round
DIGITS = 3
#: a tree with more leaves is joined by shuffle, not broadcast
BROADCAST_LEAVES = 20_000
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def _weight(levels: list[str], depth: int, weights: dict[tuple[str, ...], int]) -> Column:
    """A node's weight among its siblings: the entry of its path, `*` standing for any value; else 1."""
    out = F.lit(1)
    for path, weight in sorted(weights.items(), key=lambda x: sum(v == "*" for v in x[0]), reverse=True):
        if len(path) == depth:
            same = [F.col(level) == value for level, value in zip(levels, path) if value != "*"]
            out = F.when(reduce(lambda a, b: a & b, same, F.lit(True)), F.lit(int(weight))).otherwise(out)
    return out.cast("bigint")


def water_fill(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Split each parent's `budget` among its children (columns cap, weight) as `share`.

    Shares follow the weights; what a child cannot take up to its cap goes to its siblings by their weights, until all are full.
    Children are taken by rising cap per weight: one is full if its part of what the fuller ones leave reaches its cap.
    """
    order = Window.partitionBy(*parents).orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*parents)
    rows = children.withColumn("ratio", F.col("cap") / F.when(F.col("weight") > 0, F.col("weight")))
    active = rows.where("weight > 0")
    active = active.withColumns({"before": F.sum("cap").over(order) - F.col("cap"),
                                 "rest": F.sum("weight").over(whole) - F.sum("weight").over(order) + F.col("weight")})
    active = active.withColumn("full", F.col("ratio") <= (F.col("budget") - F.col("before")) / F.col("rest"))
    active = active.withColumns({"taken": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole),
                                 "free": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole)})
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("((budget - taken) * weight) div nullif(free, 0)"))
    return active.withColumn("share", share.cast("bigint")).drop("ratio", "before", "rest", "full", "taken", "free")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[tuple[str, ...], int], budget: int | None, max_epochs: int) -> DataFrame:
    """`leaves` (level columns, supply, n) with `share`, the tokens each may give.

    A node's cap is what its leaves can give in `max_epochs` epochs. Budgets go down level by level and never exceed a cap, so a
    shortage is made up by siblings first and reaches an ancestor's siblings only if the whole subtree is short.
    """
    caps = leaves.withColumn("cap", F.col("supply") * max_epochs)
    top = caps.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"), F.coalesce(F.sum("supply"), F.lit(0)).alias("supply"))
    wanted = F.col("supply") if budget is None else F.lit(int(budget))
    above = top.select(F.lit(0).alias("root"), F.least(F.col("cap"), wanted).cast("bigint").alias("budget"))
    for depth, level in enumerate(levels, 1):
        parents, path = ["root", *levels[:depth - 1]], levels[:depth]
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumns({"root": F.lit(0), "weight": _weight(levels, depth, weights)})
        shared = water_fill(nodes.join(above, parents), parents, level)
        above = shared.select("root", *path, F.col("share").alias("budget"))
    return leaves.join(above.select(*levels, F.col("budget").alias("share")), levels)


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple[str, ...], int], tokens: Column | None = None, budget: int | None = None,
        max_epochs: int = 4, seed: str = "0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of the mixture, a row for each epoch in which one is used, with its columns and `epoch`.

    `levels` names the tree's levels from the top; `weights` gives integer weights (0 to 1000) to paths of level values, `*` for any
    value, 1 where nothing fits. `budget` is in tokens (words unless `tokens` says otherwise; the whole supply if None). A leaf with
    share s and supply a gives s div a whole epochs and, of the next, the longest prefix of whole documents with at most s mod a
    tokens. Each epoch has its own order, by a hash of seed, epoch and id.

    The cut of a leaf is found as a hash value, by sums over the leading digits of the hash, so no leaf is sorted or gathered in one
    task, and choosing rows by the cuts needs no shuffle of texts. NULL level values count as empty strings, a NULL id is replaced by
    a hash of the text, rows that repeat an id are used together. A leaf without tokens, one of weight 0, and an empty table give
    nothing. A column named epoch is replaced.
    """
    names = [f"__level_{i}" for i in range(len(levels))]
    values = {n: F.coalesce(c.cast("string"), F.lit("")) for n, c in zip(names, levels.values())}
    id_, text = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`") if text_col in docs.columns else F.lit("")
    key = F.coalesce(id_, F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))
    count = (tokens if tokens is not None else word_count(text)).cast("bigint")
    slim = materialise(docs.select(*[c.alias(n) for n, c in values.items()], key.alias("key"), F.coalesce(count, F.lit(0)).alias("tokens")), "mixing")
    leaves = slim.groupBy(*names).agg(F.sum("tokens").alias("supply"), F.count(F.lit(1)).alias("n"))
    shares = budgets(leaves, names, weights, budget, max_epochs).where("supply > 0")
    plan = materialise(shares.select(*names, "n", F.expr("share div supply").cast("int").alias("epochs"), F.expr("share % supply").alias("rest")), "leaves")
    size = plan.agg(F.count(F.lit(1)), F.max("n")).first()
    small = size[0] <= BROADCAST_LEAVES

    def beside(rows: DataFrame, table: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(table) if small else table, names)

    def place(key: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(seed), F.col("epochs").cast("string"), key))

    hashed = beside(slim, plan.where("rest > 0").select(*names, "epochs")).select(*names, place(F.col("key")).alias("h"), "tokens")
    cuts = plan.where("rest > 0").select(*names, F.lit("").alias("cut"), "rest")
    order = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for digits in range(0, DIGITS * max(0, math.ceil(math.log((size[1] or 1) / 4096 + 1e-9, 16 ** DIGITS))), DIGITS):
        sums = (beside(hashed, cuts).where(F.col("h").startswith(F.col("cut")))
                .groupBy(*names, "cut", "rest", F.substring("h", digits + 1, DIGITS).alias("bucket")).agg(F.sum("tokens").alias("tokens")))
        upto = sums.withColumn("upto", F.sum("tokens").over(order))
        crossing = upto.where("upto > rest and upto - tokens <= rest")
        cuts = materialise(crossing.select(*names, F.concat("cut", "bucket").alias("cut"), (F.col("rest") - F.col("upto") + F.col("tokens")).alias("rest")), "cuts")
    last = (beside(hashed, cuts).where(F.col("h").startswith(F.col("cut")))
            .groupBy(*names, "cut", "rest", F.col("h").alias("bucket")).agg(F.sum("tokens").alias("tokens"))
            .withColumn("upto", F.sum("tokens").over(order))
            .groupBy(*names).agg(F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("bucket"))), F.max("cut")).alias("cut")))
    chosen = materialise(plan.select(*names, "epochs").join(last, names, "left"), "chosen")
    rows = beside(docs.withColumns(values).withColumn("__key", key), chosen.select(*names, F.col("epochs").alias("__epochs"), F.col("cut").alias("__cut")))
    place_now = F.md5(F.concat_ws("|", F.lit(seed), F.col("__epochs").cast("string"), F.col("__key")))
    times = F.col("__epochs") + F.coalesce(place_now <= F.col("__cut"), F.lit(False)).cast("int")
    used = rows.withColumn("__times", times).where("__times > 0")
    epoch = F.explode(F.sequence(F.lit(0), F.col("__times") - 1))
    return used.withColumn("epoch", epoch).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "epoch"], "epoch")
