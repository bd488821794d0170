"""Readers with explicit schemas: appointment CSV, ARFF, consultation CSV, operational tables, file fingerprints."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import HANGU_NAMES, HANGU_RAW, KAGGLE_NAMES, KAGGLE_RAW


def must_be(value: Column, message: str) -> Column:
    """The value, or a failure of the job where it is NULL."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(message)).cast("int"))


def written_clock(text: Column) -> Column:
    """An ISO timestamp as the clock time it shows; a trailing Z is dropped, not converted."""
    return F.to_timestamp_ntz(F.regexp_replace(text, "Z$", ""))


def _checked_csv(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """CSV by a declared schema; a file whose header has other names or another order fails the job, and so does a cell of a wrong type."""
    return spark.read.schema(schema).options(header=True, enforceSchema=False, mode="FAILFAST").csv(path)


def read_visits_csv(spark: SparkSession, path: str) -> DataFrame:
    """Appointment CSV with source names replaced. no_show is 1 for "Yes" and 0 for "No"; any other label fails the job.

    The patient id is read as text and then as a number, so cleaning can tell fractional ids from whole ones.
    """
    raw = _checked_csv(spark, KAGGLE_RAW, path)
    label = F.when(F.col("`No-show`") == "Yes", 1).when(F.col("`No-show`") == "No", 0)
    return (raw.withColumn("no_show", must_be(label, "No-show must be Yes or No")).drop("No-show")
            .withColumnsRenamed(KAGGLE_NAMES)
            .withColumns({"patient_id": F.col("patient_id").cast("double"), "scheduled_at": written_clock(F.col("scheduled_at")),
                          "appointment_date": written_clock(F.col("appointment_date"))}))


def arff_columns(spark: SparkSession, path: str) -> list[str]:
    """Attribute names in file order. Headers are compared on the executors; files with different ones are refused."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), F.trim("value").alias("line"))
    attributes = lines.where(F.lower("line").startswith("@attribute"))
    per_file = attributes.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("header"))
    headers = per_file.select("header").distinct().limit(2).collect()
    if len(headers) != 1:
        raise ValueError("ARFF files have different headers" if headers else "no ARFF header found")
    return [line.split(None, 2)[1].strip("'\"") for line in headers[0]["header"]]


def read_visits_arff(spark: SparkSession, path: str) -> DataFrame:
    """Dense numeric ARFF; no_show = 1 - show, and a show other than 0 or 1 fails the job. "?" is missing."""
    names = arff_columns(spark, path)
    schema = ", ".join(f"`{n}` double" for n in names)
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where(~F.col("line").rlike(r"^(%|@|$)"))
    rows = lines.select(F.from_csv("line", schema, {"nullValue": "?", "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "true"}).alias("r")).select("r.*")
    label = F.when(F.col("show") == 1, 0).when(F.col("show") == 0, 1)
    return rows.withColumn("no_show", must_be(label, "show must be 0 or 1")).drop("show")


def read_consultations_csv(spark: SparkSession, path: str) -> DataFrame:
    """Consultation CSV; a service time that is not a number is missing."""
    raw = _checked_csv(spark, HANGU_RAW, path)
    return raw.withColumnsRenamed(HANGU_NAMES).withColumn("service_seconds", F.trim("service_seconds").try_cast("double"))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None,
              partitions: int = 1, **options: str) -> DataFrame:
    """A database table. With a numeric `column` and `bounds`, partitions are read in parallel; filters and columns push down."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column and bounds:
        reader = (reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1])
                  .option("numPartitions", partitions))
    return reader.load()


#: bytes of a file that are read at a time
SLICE_BYTES = 8 << 20


def fingerprints(spark: SparkSession, path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """path, bytes and sha256 of each file, whatever its size: one task a file feeds the hash in slices.

    Spark lists the files, without empty ones; tasks open them by their URI through Arrow's file systems (local, HDFS, S3, GCS).
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                local = name.startswith("file:")
                store, inside = (fs.LocalFileSystem(), name.removeprefix("file:")) if local else fs.FileSystem.from_uri(quote(name, safe=":/"))
                state = hashlib.sha256()
                with store.open_input_stream(inside) as source:
                    while piece := source.read(slice_bytes):
                        state.update(piece)
                found.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["path", "bytes", "sha256"])

    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    # a partition for each file, as far as the hash of its path deals them apart
    return files.repartition(max(1, files.count()), "path").mapInArrow(digest, "path string, bytes long, sha256 string")


def describe_files(df: DataFrame) -> DataFrame:
    """rows and columns per source file of a file-based table."""
    n_columns = len(df.columns)
    return (df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
            .groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(n_columns)))
