"""Corpora of package files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.limits import ArchiveLimits

#: Matches the extension in either case.
GLOB = "*.[kK][rR][xX]"
#: Rows of an Arrow batch, each of which may be as large as an image.
BATCH = "16"


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """package_id, path, length, modificationTime, content of the packages below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.sha2("path", 256).alias("package_id"), "path", "length", "modificationTime", "content")


def read(spark: SparkSession, path: str, recursive: bool = True, limits: ArchiveLimits = ArchiveLimits()) -> tuple[DataFrame, DataFrame]:
    """(packages, refused): images that may be read, and a diagnostic for each that is too large.

    The size filter reaches the scan, so a refused image's content is never read.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    files = listing(spark, path, recursive)
    refused = files.where(F.col("length") > limits.archive).select("package_id", F.lit("input.over_limit.archive_bytes").alias("code"), F.lit(limits.archive).cast("long").alias("limit_value"), F.col("length").alias("observed"))
    return files.where(F.col("length") <= limits.archive).select("package_id", "content"), refused
