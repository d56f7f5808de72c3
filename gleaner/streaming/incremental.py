"""An extension beside the batch operators: duplicates among newly arriving files.

"Smallest path wins" needs all paths, so the stream keeps the first arrival; the batch operator settles the keeper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def first_arrivals(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row a content; state older than ``delay`` is dropped, so memory follows the arrival rate."""
    hashed = files.select("path", "modificationTime", F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("sha256"))
    return hashed.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["sha256"])
