"""New packages as a stream: the same stateless scan, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.limits import ArchiveLimits
from ..operators import scan
from ..sources.packages import BATCH, GLOB


def scanned(spark: SparkSession, path: str, limits: ArchiveLimits = ArchiveLimits(), files_per_batch: int = 1000) -> DataFrame:
    """A streaming DataFrame of scanned packages that arrive below path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    kinds = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kinds).option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    return scan.scan(files.where(F.col("length") <= limits.archive).select(F.sha2("path", 256).alias("package_id"), "content"), limits)
