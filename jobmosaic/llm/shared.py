"""Shared-folder tables, skew-safe lookups and connected components for the operators beside this module."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A class that holds more than 1/HOT_SHARE of all rows is joined by broadcast; there are HOT_SHARE of those at most.
HOT_SHARE = 4096

WHITE = r"\x20\x09-\x0D"

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode without that setting, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a Parquet table of the shared folder, read back: it cuts lineage and outlives executors. It is removed by
    discard, or when the driver's Python ends. The shuffle files that the write needed go when it is done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if not _STORED:
        atexit.register(_remove_all)
    _STORED[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


_STORED: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _remove(path: str) -> None:
    spark = _STORED.pop(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def _remove_all() -> None:
    if SparkContext._gateway is None or SparkContext._gateway.proc is None or SparkContext._gateway.proc.poll() is None:
        for path in list(_STORED):
            _remove(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that stored made and that nothing needs any more."""
    for table in tables:
        _remove(table.stored_path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh(name: str) -> str:
    """A column name that no table of a user has."""
    return f"__{name}_{uuid.uuid4().hex}"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, total: int, spread: Column) -> DataFrame:
    """rows with the other columns of classes, by equal keys (never null, the first one long or binary); classes has one row a key.

    A class of over total / HOT_SHARE rows is looked up by broadcast (HOT_SHARE rows at most), so that its
    rows aren't gathered in one task; all the others are joined by a shuffle on the keys. Rows without a
    class get nulls. spread: a column that tells the rows of a class apart."""
    hot = F.col(size) * HOT_SHARE > F.lit(total)
    values = [c for c in classes.columns if c not in keys]
    few = classes.filter(hot).select(*[F.col(k).alias(f"__hot_{k}") for k in keys], *[F.col(v).alias(f"__hot_{v}") for v in values], F.lit(True).alias("__is_hot"))
    many = classes.filter(~hot).select(*[F.col(k).alias(f"__key_{k}") for k in keys], *[F.col(v).alias(f"__val_{v}") for v in values])
    found = rows.join(F.broadcast(few), [F.col(k) == F.col(f"__hot_{k}") for k in keys], "left")
    # a row that is answered already goes to any task: its first key is replaced by a hash that spreads, and a flag keeps it from matching
    first, rest = keys[0], keys[1:]
    found = found.withColumn("__spread", F.when(F.col("__is_hot"), F.xxhash64(spread).cast("string").cast(rows.schema[first].dataType)).otherwise(F.col(first)))
    joined = found.join(
        many.withColumn("__open", F.lit(False)),
        [F.col("__spread") == F.col(f"__key_{first}"), F.coalesce("__is_hot", F.lit(False)) == F.col("__open"), *[F.col(k) == F.col(f"__key_{k}") for k in rest]],
        "left",
    )
    return joined.select(*rows.columns, *[F.coalesce(f"__hot_{v}", f"__val_{v}").alias(v) for v in values])


def _stars(edges: DataFrame) -> bool:
    """Whether each v has one u, and no u is a v."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("v").alias("node"), F.lit(1).alias("below")), F.struct(F.col("u").alias("node"), F.lit(0).alias("below")))).alias("e")).select("e.*")
    roles = ends.groupBy("node").agg(F.sum("below").alias("n"), F.min("below").alias("root"))
    return roles.filter((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("root") == 0))).isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of an undirected graph with long columns a and b; root is the least node of the component.

    Alternating large-star and small-star rounds of joins and aggregates, each stored in the shared folder, until
    only stars are left. A node with a great share of all edges is looked up by broadcast. Nothing but counts comes
    to the driver."""
    edges = stored(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct(), "component-edges")
    while not _stars(edges):
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = stored(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"), F.count(F.lit(1)).alias("n")), "component-least")
        met = join_classes(both, least, ["v"], "n", both.count(), F.col("u")).filter("u > v")
        large = stored(met.select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct(), "component-large")
        down = stored(large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")), "component-down")
        met = join_classes(large, down, ["v"], "n", large.count(), F.col("u"))
        small = met.select(F.col("u").alias("v"), F.col("m").alias("u")).union(down.select("v", F.col("m").alias("u"))).filter("v <> u").distinct()
        before, edges = edges, stored(small, "component-edges")
        discard(before, least, large, down)
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
