"""Exact deduplication: 128-bit content hash, smallest id stays, bytes compared inside a hash group."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = collapse_spaces,
                  content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per document: id, keep_id (smallest id of the equal texts), group_size, kept, text_sha256.

    Rows are grouped by (hash, text): the hash places a group, Spark's grouping compares the bytes of the text, so two texts that
    share a hash stay apart. Grouping combines copies where they are read, so one text that is a third of the corpus is one row per
    input split. Then every row takes the answer of its group by hash and SHA-256; that join carries no text, and its large keys can
    be split because each row meets one group.

    A NULL text counts as empty. Rows that repeat an id and its text are counted one by one and are all `kept` when that id is the
    smallest; `drop_copies` leaves one of them. NULL ids come after every other id. An empty table gives an empty result. Further
    columns of `docs` are not read.
    """
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), normalise(F.col(f"`{text_col}`")).alias("text"))
    groups = (keyed.groupBy(content_hash(F.col("text")).alias("hash"), "text")
              .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .select("hash", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    rows = keyed.select("doc_id", content_hash(F.col("text")).alias("hash"), F.sha2("text", 256).alias("text_sha256"))
    return rows.join(groups, ["hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one row for each class of equal texts.

    The row with the smallest id stays, NULL ids last; among rows that repeat this id the smaller text stays, and rows equal in both
    are copies of which any one stays. One grouping by (hash, text) carries the rows, so texts are shuffled once and copies are
    combined before it.
    """
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    key = collapse_spaces(text)
    best = docs.groupBy(hash128(key).alias("hash"), key.alias("key")).agg(F.min_by(row, F.struct(id_.isNull(), id_, text)).alias("row"))
    return best.select("row.*")
