"""Exact URL lists without joins: a cascade of Bloom filters over the corpus's complete key universe."""
from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LEVELS = 64


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as 64-bit words and the salts of its hash functions."""
    words: tuple[int, ...]
    salts: tuple[int, ...]

    @property
    def bits(self) -> int:
        return 64 * len(self.words)


def positions(key: Column, bits: int, salts: tuple[int, ...]) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(salt), key), F.lit(bits)) for salt in salts]


def contains(level: Level, key: Column) -> Column:
    """Whether the filter lets `key` pass; the words are one folded literal, read in place."""
    words = F.from_json(F.lit(json.dumps(level.words)), "array<bigint>")
    hits = [F.getbit(F.get(words, (p / 64).cast("int")), (p % 64).cast("int")) == 1
            for p in positions(key, level.bits, level.salts)]
    return reduce(lambda a, b: a & b, hits)


def build_level(keys: DataFrame, n_keys: int, rate: float, number: int) -> Level:
    """A filter for the distinct values of `keys.key`, built on the executors; only its words reach the driver.

    It has 1.44 log2(1 / rate) bits a key, so its size follows the list and not the corpus.
    """
    hashes = max(1, math.ceil(math.log2(1 / rate)))
    n_words = max(1, math.ceil(n_keys * hashes / math.log(2) / 64))
    salts = tuple(1_000 * number + i for i in range(hashes))
    places = keys.select(F.explode(F.array(*positions(F.col("key"), 64 * n_words, salts))).alias("p"))
    found = (places.groupBy((F.col("p") / 64).cast("int").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).collect())
    words = [0] * n_words
    for row in found:
        words[row["word"]] = row["bits"]
    return Level(tuple(words), salts)


def build_cascade(listed: DataFrame, universe: DataFrame) -> tuple[Level, ...]:
    """Levels that together answer exactly, for every key of `listed` and `universe` (column `key`), whether it is listed.

    Level 1 holds the listed keys. Level 2 holds the keys of the universe that level 1 lets pass although they are not listed, level
    3 the listed keys that level 2 lets pass, and so on until a level lets nothing pass wrongly. The first rate is chosen so that
    level 2 has about as many keys as the list; later levels halve. NULL keys are never listed. Answers for keys outside both sets
    are not defined. Repeated keys count once; an empty list needs no level.
    """
    inside = listed.where("key is not null").select("key").distinct()
    outside = universe.where("key is not null").select("key").join(inside, "key", "left_anti")
    n_inside = inside.count()
    if n_inside == 0:
        return ()
    n_outside = max(1, outside.agg(F.approx_count_distinct("key")).first()[0])
    rate = min(0.5, n_inside / (math.sqrt(2) * n_outside))
    levels = [build_level(inside, n_inside, rate, 1)]
    sides = [inside, outside]  # the keys the next level is tested against and holds, in turn
    while len(levels) < MAX_LEVELS:
        passed = sides[1].where(contains(levels[-1], F.col("key"))).distinct()
        n = passed.count()
        if n == 0:
            return tuple(levels)
        levels.append(build_level(passed, n, 0.5, len(levels) + 1))
        sides = [passed, sides[0]]
    raise RuntimeError(f"cascade not exact after {MAX_LEVELS} levels")


def is_listed(levels: tuple[Level, ...], key: Column) -> Column:
    """Membership by walking the levels: the first level that stops a key decides, odd ones say no and even ones yes."""
    answer = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels), 0, -1):
        answer = F.when(contains(levels[number - 1], key), answer).otherwise(F.lit(number % 2 == 0))
    return F.coalesce(answer, F.lit(False)) if levels else F.lit(False)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path by position: after the first `://`, up to `/ ? #`, then up to `? #`; else both empty."""
    mark = F.instr(url, "://")
    rest = F.coalesce(F.when(mark > 0, F.substr(url, mark + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def url_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every key under which a rule could list the URL: each suffix of the host's labels with each path prefix of a rule's length."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.char_length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.concat(s, F.substr(path, F.lit(1), n)))))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict.

    `rules` are (verdict, host, path) with verdict allow or block: one fits its host and all subdomains when the path starts with its
    path, and the longest text host + path wins. Where no rule fits, the rule is NULL and the verdict is `default`. The rules of each
    verdict are the list of one cascade; the universe is every key of every URL of the table, so the answer is exact and judging a
    row needs no join. A rule given with both verdicts blocks.

    NULL URLs and those without `://` have empty host and path and fit no rule. A URL of any length is judged whole: its keys are the
    prefixes of the rules' lengths, so it has no more keys than a short one with as many host labels. Repeated rows are judged alike. Columns of `pages`
    named host, path, rule or verdict are replaced, all others stay.
    """
    spark = pages.sparkSession
    lengths = sorted({len(path) for _, _, path in rules})
    host, path = split_url(F.col(f"`{url_col}`"))
    parts = pages.withColumns({"host": host, "path": path})
    if not rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = url_keys(F.col("host"), F.col("path"), lengths)
    universe = parts.select("host", "path").distinct().select(F.explode(keys).alias("key"))
    cascades = {}
    for verdict in ("block", "allow"):
        listed = [(h.lower() + p,) for v, h, p in rules if v == verdict]
        cascades[verdict] = build_cascade(spark.createDataFrame(listed, "key string"), universe) if listed else ()
    fits = F.filter(keys, lambda k: is_listed(cascades["block"], k) | is_listed(cascades["allow"], k))
    longest = F.get(F.array_sort(fits, lambda a, b: F.char_length(b) - F.char_length(a)), F.lit(0))
    judged = parts.withColumn("rule", longest)
    return judged.withColumn("verdict", F.when(F.col("rule").isNull(), F.lit(default))
                             .when(is_listed(cascades["block"], F.col("rule")), F.lit("block")).otherwise(F.lit("allow")))
