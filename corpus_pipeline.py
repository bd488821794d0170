"""A training corpus from `documents`: language, exact copies, near copies, mixture, packed sequences."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlake.llm import exact_dedup, language, mixing, packing, set_join
from visitlake.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, held_out, mix_levels
from visitlake.llm.store import materialise
from visitlake.llm.tokens import vocabulary_path
from visitlake.plans.catalog import query

#: near copies: five-word shingles, Jaccard similarity of 0.8 or more
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: words a Python worker remembers while packing: few, as the workers of a pipeline outlive its stages
PACK_WORDS = 200_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly stay; a missing label is filled with it. NULL, empty and letterless texts go.

    Repeated rows get equal answers, so all of them stay or go. Other columns stay, also those named like the operator's own. An empty table gives an empty one.
    """
    dictionaries = language.fit_dictionaries(docs.where(~held_out()))
    found = language.identify(docs.withColumnRenamed("lang", "__lang"), dictionaries).where("accepted")
    return found.withColumn("lang", F.coalesce("__lang", "lang_pred")).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the row with the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the row with the smallest doc_id stays, and every document without words.

    Rows go, not ids: an id may have a text that goes and one that stays. Among rows of one id, and where no row of a group has an id,
    the smallest text hash stays. Rows equal in id and text share their fate; exact deduplication leaves no such rows.
    """
    found = set_join.linked_rows(docs, NEAR_WORDS, NEAR_PERCENT).where("component IS NOT NULL")
    found = materialise(found.select("doc_id", "text_hash", "component"), "linked")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = found.groupBy("component").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    goes = found.join(first, "component").where(~place.eqNullSafe(F.col("first"))).select(key.alias("__key"), F.col("text_hash").alias("__hash")).distinct()
    goes = materialise(goes, "near-copies")
    rest = set_join.beside(docs.withColumns({"__key": key, "__hash": set_join.text_hash("text")}), goes, ["__key", "__hash"], "left_anti")
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by domain, language and source; a document used in several epochs has a row for each."""
    mixed = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences of 4096 tokens as possible.

    A NULL or empty text is one piece of one id; repeated rows are documents of their own; an empty table has no pieces. Other columns are not read.
    """
    placed = packing.pack_documents(docs, vocabulary_path(), remembered=PACK_WORDS)
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: compression, token ids and the packing program cannot be said in SQL; the tests hold each stage against brute force
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
