"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Each document has a fixed 60-bit hash. A source takes all its documents a whole number of times, and once
more those whose hash is at most the source's threshold. The threshold comes from sums of words by source and
hash bucket: the bucket in which the running sum crosses the budget is refined by the next bits of the hash,
again and again, until it is small enough to be told hash by hash. Documents are never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmosaic.llm.shared import WHITE, checkpointed, stored, text_or_empty

HASH_BITS = 60
#: Bits of the hash that one histogram resolves.
LEVEL_BITS = 10
#: A boundary bucket with this many documents or fewer is told hash by hash.
FINE = 1024
#: As many sources are broadcast at most; beyond, sources are joined by a salted shuffle.
BROADCAST_SOURCES = 100_000
SALTS = 64


def word_count(text: str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(rf"[^{WHITE}]+")).cast("long")


def place(doc_id: str) -> Column:
    """60 bits of the MD5 of the id: the same on each run, and for any order or number of partitions."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def with_sources(rows: DataFrame, sources: DataFrame, n_sources: int, how: str = "inner") -> DataFrame:
    """rows with what sources says of their source; a source with a third of all rows stays spread out."""
    names = [c for c in sources.columns if c != "source"]
    right = sources.withColumnRenamed("source", "__source")
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(right), F.col("source").eqNullSafe(F.col("__source")), how).select(*rows.columns, *names)
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn("__at", F.pmod(F.col("place"), F.lit(SALTS)).cast("int"))
    return left.join(salted, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__at") == F.col("__salt")), how).select(*rows.columns, *names)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): budgets by weight, filled up to the caps.

    Sources in the order of cap over weight are full as long as the budget left, shared by the weights left,
    gives them more than their cap; the rest share what is left. One row a source: the sums run over the
    sources, not over documents."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    filled = ranked.withColumns({
        "budget": F.sum("source_size").over(every) * F.lit(share),
        "most_before": F.sum("most").over(upto) - F.col("most"),
        "weight_left": F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"),
    })
    filled = filled.withColumn("full", F.col("most") * F.col("weight_left") <= (F.col("budget") - F.col("most_before")) * F.col("weight"))
    filled = filled.withColumns({
        "most_full": F.sum(F.when(F.col("full"), F.col("most")).otherwise(F.lit(0))).over(every),
        "weight_open": F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(F.lit(0))).over(every),
    })
    level = (F.col("budget") - F.col("most_full")) / F.when(F.col("full"), F.lit(1)).otherwise(F.col("weight_open"))
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, source_size, target, whole, threshold) from (source, size, place).

    whole: how often each document of the source is taken; threshold: those at or below it are taken once
    more (-1: none). Of the prefixes in hash order, the one nearest to the target is taken; documents with one
    hash go together."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = checkpointed(plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    n_sources = plan.count()
    # the open bucket of each source: its bits so far, and the words below it
    state = plan.select("source", F.col("rest"), F.lit(0).cast("long").alias("head"), F.lit(0).cast("long").alias("below"))
    by_source = Window.partitionBy("source").orderBy("bucket")
    used = 0
    while used < HASH_BITS:
        left = HASH_BITS - used
        inside = with_sources(rows, state, n_sources)
        if used:
            inside = inside.filter(F.shiftright("place", left) == F.col("head"))
        bits = min(LEVEL_BITS, left)
        histogram = inside.groupBy("source", "rest", "below", F.shiftright("place", left - bits).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        running = histogram.withColumn("upto", F.sum("words").over(by_source) + F.col("below")).withColumn("last", F.lead("bucket").over(by_source).isNull())
        # where the sum crosses the budget, or the last bucket
        crossing = running.filter(((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest"))) | (F.col("last") & (F.col("upto") <= F.col("rest"))))
        state = checkpointed(crossing.select("source", "rest", F.col("bucket").alias("head"), (F.col("upto") - F.col("words")).alias("below"), "n"))
        used += bits
        if (state.agg(F.max("n")).first()[0] or 0) <= FINE:
            break
        state = state.drop("n")
    inside = with_sources(rows, state.drop("n"), n_sources).filter(F.shiftright("place", HASH_BITS - used) == F.col("head"))
    exact = inside.groupBy("source", "rest", "below", F.col("place").alias("bucket")).agg(F.sum("size").alias("words"))
    exact = exact.withColumn("upto", F.sum("words").over(by_source) + F.col("below")).filter(2 * F.col("upto") - F.col("words") <= 2 * F.col("rest"))
    found = exact.groupBy("source").agg(F.max("bucket").alias("found"))
    # nothing of the open bucket: the threshold lies just below it
    floor = state.select("source", (F.shiftleft("head", HASH_BITS - used) - 1).alias("floor"))
    parts = floor.join(found.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").select("source", F.coalesce("found", "floor").alias("threshold"))
    merged = plan.join(parts.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
    return checkpointed(merged.select("source", "source_size", "target", "whole", F.coalesce(F.when(F.col("target") > F.col("whole") * F.col("source_size"), F.col("threshold")), F.lit(-1).cast("long")).alias("threshold")))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), place(doc_id).alias("place"))


def times() -> Column:
    return F.col("whole") + F.when(F.col("place") <= F.col("threshold"), 1).otherwise(0)


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row for each row of docs; taken is 0, 1 or 2 times size.

    Size: words of the text, 0 if it is null. The null source is a source, the last one. Rows with one id (or
    without any) have one hash and are taken or left together. A source without words has target 0. Other
    columns aren't looked at. An empty table gives no rows."""
    rows = stored(sized(docs), "mix-sizes")
    plan = plan_mix(rows, weights, share, cap)
    mixed = with_sources(rows, plan, plan.count(), "left")
    return mixed.select("doc_id", "size", "source_size", "target", (times() * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """The documents of the mix with all their columns; one that the mix takes twice is two rows, and none is more. Documents
    without words are taken as those are that have their place in the order of hashes."""
    rows = stored(sized(docs), "mix-sizes")
    plan = plan_mix(rows, weights, share, cap)
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("source"), place("doc_id").alias("place"))
    mixed = with_sources(wide, plan, plan.count(), "left").withColumn("times", times().cast("int"))
    return mixed.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
