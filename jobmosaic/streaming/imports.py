"""Streaming import: new snapshots in a folder are merged into the table as they come."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobmosaic.functions.rules import Rules
from jobmosaic.plans.store import incoming
from jobmosaic.plans.versions import VersionedTable
from jobmosaic.sources.snapshots import SNAPSHOT_COLUMNS

#: Bits for the row of a file in ord; the place of the file among those of the batch is above.
ROW_BITS = 33


def in_order(batch: DataFrame) -> DataFrame:
    """ord: files by their paths, rows as they stand in the file (a multi-line file is read by one task)."""
    paths = batch.select(F.col("file_path").alias("of")).distinct()
    places = paths.withColumn("place", F.row_number().over(Window.orderBy("of")).cast("long"))  # one row a file
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    placed = batch.withColumn("row", row).join(F.broadcast(places), F.col("file_path") == F.col("of"))
    return placed.withColumn("ord", F.shiftleft("place", ROW_BITS).bitwiseOR(F.col("row"))).drop("of", "place", "row")


def stream_import(spark: SparkSession, folder: str, table: str, checkpoint: str, rules: Rules | None = None, reference: dt.date | None = None, files_a_batch: int | None = None, buckets: int = 64) -> StreamingQuery:
    """Each batch of snapshot files makes the next version of a VersionedTable under the path table.

    A batch that is run again after a failure writes the same version again: its moment (created_at, updated_at) is
    the last change of its files, and its order is theirs by path and row. The stream ends when the files that are
    there have been read. A batch writes the buckets it touches; batches may be bounded by files_a_batch, which takes files
    by their last change. Folders below the folder are read too."""
    rules = rules or Rules()
    versions = VersionedTable(spark, table, buckets)
    schema = ", ".join(f"`{c}` string" for c in SNAPSHOT_COLUMNS)
    source = spark.readStream.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("recursiveFileLookup", True)
    files = (source.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else source).csv(folder)
    rows = files.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_modification_time").alias("file_time"))

    def merge(batch: DataFrame, number: int) -> None:
        moment = batch.agg(F.max("file_time")).first()[0] or dt.datetime(1970, 1, 1)
        versions.merge(incoming(in_order(batch), rules, reference), moment, number)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
