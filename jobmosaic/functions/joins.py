"""Joins and components over keys of which one may have a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmosaic.functions.folders import remove, scratch

#: A key with more than 1/HOT_SHARE of all rows is looked up by broadcast; there are fewer than HOT_SHARE of those.
HOT_SHARE = 4096


#: Spark's setting by which the shuffle files of a write go when it is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a Parquet table of the shared folder, read back: made once, however often it is read."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables that kept made and that nothing reads any more."""
    for table in tables:
        remove(table.kept_path)


def join_spread(rows: DataFrame, keys: DataFrame, key: str, size: str, spread: Column) -> DataFrame:
    """rows with the other columns of keys (one row a key, a string; size: its rows), which has every key of rows.

    Rows of hot keys stay where they are; spread tells them apart, so that they don't meet in the join of the others."""
    values = [c for c in keys.columns if c not in (key, size)]
    total = keys.agg(F.sum(size).alias("__total"))
    marked = keys.crossJoin(F.broadcast(total)).withColumn("__hot", F.col(size) * HOT_SHARE > F.col("__total"))  # total: one row
    hot = marked.filter("__hot").select(F.col(key).alias("__hot_key"), *[F.col(v).alias(f"__hot_{v}") for v in values])
    rest = marked.filter(~F.col("__hot")).select(F.col(key).alias("__key"), *[F.col(v).alias(f"__rest_{v}") for v in values])
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left")
    at = F.when(F.col("__hot_key").isNull(), F.concat(F.lit("k"), F.col(key))).otherwise(F.concat(F.lit("h"), spread.cast("string")))
    joined = found.withColumn("__at", at).join(rest, F.col("__at") == F.concat(F.lit("k"), F.col("__key")), "left")
    return joined.select(*rows.columns, *[F.coalesce(f"__hot_{v}", f"__rest_{v}").alias(v) for v in values])


def parts_of(links: DataFrame) -> DataFrame:
    """(node, part) of the nodes of links (a, b): part is the least node that hangs together with the node.

    Each round takes the least part of all neighbours, then the part of that part; it ends when nothing changes. A node
    with a great share of all links is looked up by broadcast, so that its links don't meet in one task."""
    both = kept(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "part-links")
    parts = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("part"), F.count(F.lit(1)).alias("links")).withColumnRenamed("a", "node")
    before = None
    while True:
        near = join_spread(both, parts.withColumnRenamed("node", "b"), "b", "links", F.col("a")).groupBy("a").agg(F.min("part").alias("near"))
        least = parts.join(near, F.col("node") == F.col("a")).select("node", "links", F.col("part").alias("before"), F.least("part", "near").alias("low"))
        of_part = parts.select(F.col("node").alias("low"), F.col("part").alias("lower"))
        now = kept(least.join(of_part, "low").select("node", "links", "before", F.least("low", "lower").alias("part")), "parts")
        if before is not None:
            discard(before)
        before, parts = now, now.select("node", "links", "part")
        if now.filter("part <> before").isEmpty():
            discard(both)
            return now.select("node", "part")
