"""Snapshots as CSV files: which is the latest, and their rows in file order, however the files are split.

Spark splits a file into blocks that end anywhere. Lines are read block by block; a line with an odd number of quotes opens or
closes a value that goes on over lines, so counting those lines before a block (one number a block) tells whether
it begins inside a value. Only records that do go on over lines are put together by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmosaic.functions.joins import kept

SNAPSHOT_COLUMNS = ["area", "seniority", "title", "company", "source", "location", "workplace_type", "published_date", "url", "skills", "area_score", "area_matches", "search_term", "external_id", "description"]
#: Bits for a row's place in its file (bytes) in ord; the place of the file among those that are read is above.
PLACE_BITS = 48
MOST_FILES = 1 << 15
_NAME = r"(vagas_[^/]*\.csv)"


def file_of(path: str):
    """The snapshot that a path belongs to: the file itself, or the folder of its parts."""
    named = F.regexp_extract(path, _NAME, 1)
    return F.when(named != "", named).otherwise(F.element_at(F.split(path, "/"), -1))


def csv_records(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, file_time, ord, record): the records of CSV files but for each file's header line, in order of path and place.

    A quote inside a value is doubled; values in quotes may hold line ends. A carriage return at the end of a record
    doesn't belong to it; empty lines are no records."""
    # the number of a line is its place among the lines of its task, of which a block's lines are a stretch
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_modification_time").alias("file_time"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("line"), "value",
    )
    odd = F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2)) == 1
    lines = lines.withColumn("odd", odd)
    blocks = lines.groupBy("path", "block").agg(F.min("line").alias("first"), F.count_if("odd").alias("n_odd"), F.max(F.when(F.col("odd"), F.col("line"))).alias("last_odd"))
    blocks = kept(blocks, "csv-blocks")  # one row a block
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("last_odd").isNotNull(), F.col("block") + F.col("last_odd") - F.col("first")), ignorenulls=True).over(earlier)
    files = blocks.select("path").distinct().withColumn("file", F.row_number().over(Window.orderBy("path")).cast("long"))  # one row a file
    known = blocks.select("path", "block", "first", F.coalesce(F.sum("n_odd").over(earlier), F.lit(0)).alias("before"), opened.alias("opened")).join(files, "path")
    placed = lines.join(known, ["path", "block"]).withColumn("place", F.col("block") + F.col("line") - F.col("first"))
    if blocks.filter("n_odd > 0").isEmpty():
        records = placed.select("path", "file", "file_time", "place", F.col("value").alias("record"))
    else:
        upto = Window.partitionBy("path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.pmod(F.col("before") + F.coalesce(F.sum(F.col("odd").cast("long")).over(upto), F.lit(0)), F.lit(2)) == 1
        opener = F.coalesce(F.max(F.when(F.col("odd"), F.col("place"))).over(upto), F.col("opened"))
        told = placed.withColumns({"inside": inside, "start": F.when(inside, opener).otherwise(F.col("place"))})
        single = told.filter("not inside and not odd").select("path", "file", "file_time", "place", F.col("value").alias("record"))
        several = told.filter("inside or odd").groupBy("path", "file", "file_time", "start").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("lines"))
        records = single.union(several.select("path", "file", "file_time", "start", F.array_join("lines.value", "\n")))
    few = F.assert_true(F.col("file") < MOST_FILES, F.lit("too many files at once"))
    place = F.shiftleft("file", PLACE_BITS).bitwiseOR(F.col("place"))
    ended = F.regexp_replace("record", "\r$", "")
    return records.filter("place > 0").select("path", "file_time", F.when(few.isNull(), place).alias("ord"), ended.alias("record")).filter("record <> ''")


def read_csv_rows(spark: SparkSession, columns: list[str], *paths: str) -> DataFrame:
    """Rows of CSV files as strings, with ord (file order), file_name and file_time.

    The cells are columns of a one-row inline: a filter on some of them isn't moved below it, where it would parse each record again
    for each cell that it reads."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    cells = F.from_csv("record", schema, {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    rows = csv_records(spark, *paths).select("ord", file_of("path").alias("file_name"), "file_time", F.inline(F.array(cells)))
    return rows.select(*columns, "ord", "file_name", "file_time")


def latest_file(spark: SparkSession, folder: str) -> str | None:
    """The path of the snapshot in a folder (or below it) whose name comes last. Files are listed, not opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    last = listed.filter(F.regexp_extract("path", _NAME, 1) != "").agg(F.max_by(F.regexp_extract("path", rf"^(.*?{_NAME})", 1), F.regexp_extract("path", _NAME, 1))).first()
    return last[0]
