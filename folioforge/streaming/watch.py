"""Streams: watched directories, coalesced changes, overlapping re-reads, publication by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.operators.store import numbered

FILES = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def watched(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """New files below a directory, as a stream."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)


def coalesced(changes: DataFrame, path: str = "path", order: str = "seq", kind: str = "change") -> DataFrame:
    """The last change of each path, and its place by when the path was first seen."""
    last = changes.groupBy(path).agg(F.max_by(kind, order).alias(kind), F.min(order).alias("first"), F.max(order).alias("last"))
    return numbered(last, ["first", path], "place")


def settled(changes: DataFrame, ignored: Column, present: DataFrame, path: str = "path") -> DataFrame:
    """Without ignored paths, and without changes of files that have vanished since."""
    kept = changes.where(~ignored).join(present.select(path).distinct().withColumn("__here", F.lit(True)), path, "left")
    return kept.where((F.col("change") == "deleted") | F.col("__here")).drop("__here")


def reread(rows: DataFrame, since: Column, key: str = "source_id", token: str = "version_token", at: str = "when") -> DataFrame:
    """Rows from the overlap on, each version once."""
    return rows.where(F.col(at) >= since).dropDuplicates([key, token])


def reread_stream(rows: DataFrame, delay: str, key: str = "source_id", token: str = "version_token", at: str = "when") -> DataFrame:
    """The same of a stream: versions are remembered as long as late rows may come."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([key, token])


def published(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs what is there now through ``write``, batch by batch, exactly once per checkpoint."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_into(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A batch writer: each batch goes to a version of its own, and a reader takes each key's latest row.

    A batch that is written again replaces its own version.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def upserted(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The table that ``upsert_into`` keeps."""
    rows = spark.read.parquet(path)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("batch")))).where("__n = 1").drop("__n", "batch")
