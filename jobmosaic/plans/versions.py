"""The imported table as buckets of files with a manifest for each version.

A posting's bucket is a hash of its key. A merge reads and writes only the buckets that its rows belong to; the manifest
of the new version, a row a bucket, tells for each bucket which version's files hold it, and how many rows and
which highest id they have. So a version is complete, old versions stay readable, and what is written follows the batch.

Beside the buckets stands an index of the titles: which three characters in a row each written bucket has. A search in titles
reads the index's folders of the characters that it asks for, and then only the buckets that have all of them.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from jobmosaic.functions.joins import discard, kept
from jobmosaic.functions.rules import Rules
from jobmosaic.plans.query import list_vagas
from jobmosaic.plans.store import upsert_vagas

MANIFEST = "bucket int, data_version long, rows long, top_id long"
#: Folders that the index of each version is dealt to, by a hash of the characters.
INDEX_FOLDERS = 64


def grams_of(q: str) -> set[str]:
    """What any title that a search finds must have: all three characters in a row (in lower case) of the stretches between wildcards."""
    found = set()
    for stretch in re.split("[%_]", q):
        low = stretch.lower()
        found |= {low[i : i + 3] for i in range(len(low) - 2)}
    return found


def _folder(gram):
    return F.pmod(F.xxhash64(gram), F.lit(INDEX_FOLDERS)).cast("int")


@dataclass(frozen=True)
class VersionedTable:
    """A table under root. buckets is fixed when the first version is written."""

    spark: SparkSession
    root: str
    buckets: int = 64

    def latest(self) -> int | None:
        """The last version that is complete: its manifest is one file, which is there as a whole or not at all."""
        try:
            listed = self.spark.read.schema(f"{MANIFEST}, version long").parquet(f"{self.root}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return listed.agg(F.max("version")).first()[0]

    def manifest(self, version: int | None) -> list[Row]:
        """A row for each bucket that has rows; there are no more than buckets."""
        if version is None or version < 0:
            return []
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/version={version}").collect()

    def _files(self, entries: list[Row]) -> DataFrame | None:
        paths = [f"{self.root}/data/version={e.data_version}/bucket={e.bucket}" for e in entries]
        return self.spark.read.option("basePath", f"{self.root}/data").parquet(*paths).drop("version", "bucket") if paths else None

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version (the last one)."""
        found = self._files(self.manifest(self.latest() if version is None else version))
        if found is None:
            raise FileNotFoundError(f"{self.root} has no rows of version {version}")
        return found

    def bucket_of(self):
        return F.pmod(F.xxhash64("source", "external_id"), F.lit(self.buckets)).cast("int")

    def merge(self, rows: DataFrame, now: dt.datetime, version: int | None = None) -> DataFrame:
        """Merges incoming rows (as upsert_vagas does) and gives its counters. version is the number of the new one, by default
        the last one's and one more; merged again under the same number, the same rows give the same version."""
        if version is None:
            last = self.latest()
            version = 0 if last is None else last + 1
        entries = self.manifest(version - 1)
        rows = kept(rows.withColumn("bucket", self.bucket_of()), "incoming")
        touched = {r[0] for r in rows.select("bucket").distinct().collect()}
        top, was = max((e.top_id for e in entries), default=0), sum(e.rows for e in entries)
        part = self._files([e for e in entries if e.bucket in touched])
        merged = upsert_vagas(part, rows.drop("bucket"), now, top, was)
        counters = kept(merged.counters, "counters")  # one row
        data = f"{self.root}/data/version={version}"
        # by bucket and key, so that a large bucket is written by several tasks
        merged.vagas.withColumn("bucket", self.bucket_of()).repartition("bucket", F.pmod(F.xxhash64("external_id"), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(data)
        written = self.spark.createDataFrame([], MANIFEST)
        if touched:
            written = self.spark.read.parquet(data).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.max("id").alias("top_id")).select(F.col("bucket").cast("int"), F.lit(version).cast("long").alias("data_version"), "rows", "top_id")
        same = self.spark.createDataFrame([e for e in entries if e.bucket not in touched], MANIFEST)
        title = F.lower("title")
        grams = F.transform(F.sequence(F.lit(1), F.length(title) - 2), lambda i: F.substring(title, i, 3))
        if touched:
            titles = self.spark.read.parquet(data).filter(F.length("title") > 2).select("bucket", "title").distinct()  # many postings, fewer titles
            told = titles.select("bucket", F.explode(F.array_distinct(grams)).alias("gram")).distinct()
            told.withColumn("folder", _folder("gram")).repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{self.root}/index/version={version}")
        written.union(same).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        discard(rows)
        return counters

    def search(self, rules: Rules, q: str, version: int | None = None, **filters: str | None) -> DataFrame:
        """The postings that list_vagas finds with q and other filters, read from the buckets that can have some."""
        entries = self.manifest(self.latest() if version is None else version)
        grams = sorted(grams_of(q))
        if grams and entries:
            # lower case may differ between Python and the JVM in a few letters; the JVM's is the index's
            asked = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(F.lower("gram").alias("gram")).distinct()
            asked = asked.withColumn("folder", _folder("gram")).collect()  # no more than q has characters
            paths = self.spark.read.schema("bucket int, gram string, version long, folder int").parquet(f"{self.root}/index")
            held = self.spark.createDataFrame([(e.bucket, e.data_version) for e in entries], "bucket int, version long")
            told = paths.filter(F.col("folder").isin([a.folder for a in asked]) & F.col("gram").isin([a.gram for a in asked])).join(F.broadcast(held), ["bucket", "version"])
            having = {r[0] for r in told.groupBy("bucket").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(asked)).select("bucket").collect()}
            entries = [e for e in entries if e.bucket in having] or entries[:1]  # none: any bucket tells that there is nothing
        return list_vagas(self._files(entries), rules, q=q, **filters)
