"""Token counts by an exact length histogram: one row for each encoded length, with suffix sums.

Lengths are counted with partial sums in each task, so that a length which many documents share is one row a
task. The suffix sums run in two steps: over blocks of lengths, then inside each block, so no task gets the
whole histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobmosaic.llm.byte_bpe import count_tokens
from jobmosaic.llm.shared import stored

#: Lengths in one block.
BLOCK = 1024


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """(length, n_docs, docs_from, tokens_from, docs_total, tokens_total) from (length, n_docs).

    docs_from and tokens_from count the documents of that length or more."""
    rows = histogram.withColumn("block", F.floor(F.col("length") / block)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.col("block").desc())  # one row for each block of lengths
    every = Window.partitionBy()
    blocks = blocks.select(
        F.col("block").alias("of"),
        (F.sum("d").over(above) - F.col("d")).alias("d_above"),
        (F.sum("t").over(above) - F.col("t")).alias("t_above"),
        F.sum("d").over(every).alias("docs_total"),
        F.sum("t").over(every).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("length").desc())
    return rows.join(blocks, F.col("block") == F.col("of")).select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("d_above")).alias("docs_from"),
        (F.sum("tokens").over(inside) + F.col("t_above")).alias("tokens_from"),
        "docs_total",
        "tokens_total",
    )


def length_table(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The histogram of encoded lengths with its sums, one row for each length that occurs.

    length, n_docs; docs_upto and tokens_upto: documents of that length or less and their tokens; docs_cut:
    documents that a context limit of this length cuts; truncated_tokens: tokens that are left under that
    limit; share_upto: docs_upto over all documents. A null text has length 0; repeated rows count each; an
    empty table gives no rows; other columns aren't looked at."""
    histogram = stored(count_tokens(docs, path, pattern, text).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")), "length-histogram")
    sums = suffix_sums(histogram)
    over = F.col("docs_from") - F.col("n_docs")
    upto = F.col("tokens_total") - F.col("tokens_from") + F.col("length") * F.col("n_docs")
    return sums.select(
        "length",
        "n_docs",
        (F.col("docs_total") - over).alias("docs_upto"),
        upto.alias("tokens_upto"),
        over.alias("docs_cut"),
        (upto + F.col("length") * over).alias("truncated_tokens"),
        ((F.col("docs_total") - over) / F.col("docs_total")).alias("share_upto"),
    )


def totals_at(table: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_upto, docs_cut, truncated_tokens) for any limits, from a length_table: one aggregate each, in one pass."""
    total = F.sum("n_docs")
    columns = []
    for i, limit in enumerate(limits):
        fits = F.col("length") <= limit
        docs = F.coalesce(F.sum(F.when(fits, F.col("n_docs"))), F.lit(0))
        tokens = F.coalesce(F.sum(F.when(fits, F.col("length") * F.col("n_docs"))), F.lit(0))
        cut = F.coalesce(total, F.lit(0)) - docs
        columns.append(F.struct(F.lit(limit).cast("long").alias("context_limit"), docs.alias("docs_upto"), cut.alias("docs_cut"), (tokens + limit * cut).alias("truncated_tokens")))
    return table.agg(F.array(*columns).alias("rows")).select(F.inline("rows"))


def quantiles_of(table: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that this share of the documents doesn't exceed, from a length_table; null if the table is empty."""
    columns = [F.struct(F.lit(float(s)).alias("share"), F.min(F.when(F.col("share_upto") >= s, F.col("length"))).alias("length")) for s in shares]
    return table.agg(F.array(*columns).alias("rows")).select(F.inline("rows"))
