"""Postings by source key as they come: what the first of each term and the dedupe by source key keep, with state for each key.

For each source and external id the state has the first row of each search term (no more rows than terms). From these the row that
stays follows as in the batch operators, whatever the batches are and in whatever order rows come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobmosaic.functions.rules import Rules
from jobmosaic.operators.dedupe import by_source_key, text_size
from jobmosaic.operators.levels import level_of
from jobmosaic.plans.pipeline import clean

#: The first row of a search term of a key: a change says that it is another one from this batch on.
CHANGE = "source string, external_id string, search_term string, ord long, text_size long, level string"


def survivor(rows: list[tuple[str, int, int, str | None]]) -> tuple[bool, int, int, str, str]:
    """What source_keys tells, for one key: (stays, ord, first_ord, search_term, seniority) of the row that stays of (term, ord, size, level), the
    first of each term: of those with a level the longest, the first of those; its term is the first that isn't empty among rows longer than all before them.
    Nothing stays if none has a level."""
    told = sorted((r for r in rows if r[3] is not None), key=lambda r: r[1])
    if not told:
        return False, 0, 0, "", ""
    term, longest, best = "", -1, told[0]
    for r in told:
        if r[2] > longest:
            longest, best = r[2], r
            term = term or r[0] or ""
    return True, best[1], told[0][1], term, best[3]


def by_source_key_stream(raw: DataFrame, rules: Rules | None = None, strict: bool = False) -> DataFrame:
    """Changes (CHANGE) of a stream of raw postings: the first row of all so far for each source, external id and term that the
    batch has rows of. An aggregate: its state is a row for each of them, and no row leaves the JVM."""
    slim = clean(raw).select("source", "external_id", F.coalesce("search_term", F.lit("")).alias("search_term"), "ord", text_size(raw).cast("long").alias("text_size"), level_of(rules or Rules(), strict).alias("level"))
    firsts = slim.groupBy("source", "external_id", "search_term").agg(F.min(F.struct("ord", "text_size", "level")).alias("first"))
    return firsts.select("source", "external_id", "search_term", "first.*")


def keep_source_keys(raw: DataFrame, changes: str, checkpoint: str, rules: Rules | None = None, strict: bool = False) -> StreamingQuery:
    """Writes the changes of each batch as changes/batch=<n>; a batch that runs again writes the same folder again. Ends when what is
    there has been read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    return by_source_key_stream(raw, rules, strict).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def source_keys(spark: SparkSession, changes: str, batch: int | None = None) -> DataFrame:
    """The row that stays of each key after a batch (the last one); keys without a row that has a level have none."""
    rows = spark.read.schema(f"{CHANGE}, batch long").parquet(changes)
    rows = rows if batch is None else rows.filter(F.col("batch") <= batch)
    # of a term's changes the last one has the least ord
    firsts = rows.repartition("source", "external_id").groupBy("source", "external_id", "search_term").agg(F.min(F.struct("ord", "text_size", "level")).alias("first"))
    told = firsts.select("source", "external_id", "search_term", "first.*").filter("level IS NOT NULL").withColumnRenamed("level", "seniority")
    return by_source_key(told).select("source", "external_id", "ord", "first_ord", "search_term", "seniority")
