"""Exact dedup by an extendible-hash index on shared files, in DataFrame functions only.

Texts that are identical after each run of white space became one space are one class. The directory is a binary
trie over the bits of a 64-bit hash: it starts as deep as the number of rows asks for, and doubles while a bucket
is overfull; an overfull bucket is split by its next bit. Buckets are numbered as in a heap (1 is the root, 2n and
2n + 1 are the halves of n), so that the directory is its start depth and the few buckets split below it.

Each document goes, with its text, to the task that owns its bucket; an owner has a range of hashes. There the
texts of a bucket are sorted by hash and bytes: equal bytes are one entry, and entries with one hash are a chain.
The owner writes them to the bucket's folder with the least id and the size of each entry, and these rows are the
answer. Copies of one text can't be split by bits: where there are many, they fill overflow pages, which are owned
apart, and the pages' sums are then added up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmosaic.llm.shared import WHITE, fresh, join_classes, stored, text_or_empty

#: Rows of a bucket, at most, and bits of the hash by which the directory starts, at least.
CAPACITY = 100_000
FIRST_DEPTH = 5
#: One hash fills its bucket with no more than one in so many of all rows (PAGE_ROWS in any case); beyond, it has pages of its own.
PAGE_SHARE = 1024
PAGE_ROWS = 256
#: Entries are chained, not split, from this depth on.
LAST_DEPTH = 60


def normalised(text: str) -> Column:
    """Only runs that differ from one space are rewritten; the result is that of replacing every run."""
    return F.regexp_replace(text_or_empty(text), rf"[\x09-\x0D][{WHITE}]*|\x20[{WHITE}]+", " ")


def node_at(depth: int) -> Column:
    """Number of the bucket, at a depth, that the column hash leads to."""
    return F.lit(1).cast("long") if depth == 0 else F.shiftrightunsigned("hash", 64 - depth).bitwiseOR(F.lit(1 << depth))


@dataclass
class Directory:
    """start: bits that all buckets have at least; splits: for each depth from there on, the buckets that are split."""

    start: int
    splits: list[list[int]]

    def bucket(self) -> Column:
        found = node_at(self.start)
        for level, split in enumerate(self.splits):
            found = F.when(found.isin(split), node_at(self.start + level + 1)).otherwise(found)
        return found


def grow_directory(hashes: DataFrame, capacity: int, first_depth: int) -> Directory:
    """hashes: (hash, n), one row a hash. Only the numbers of overfull buckets come to the driver, of which there are fewer
    than rows / capacity; with an even hash there are none, as buckets start three quarters full at most."""
    rows = hashes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    start = min(LAST_DEPTH, max(first_depth, math.ceil(math.log2(max(1, rows / (0.75 * capacity))))))
    splits: list[list[int]] = []
    open_ = hashes
    while start + len(splits) < LAST_DEPTH:
        node = node_at(start + len(splits))
        filled = open_.groupBy(node.alias("node")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("hashes"))
        overfull = [r[0] for r in filled.filter((F.col("rows") > capacity) & (F.col("hashes") > 1)).select("node").collect()]
        if not overfull:
            break
        splits.append(sorted(overfull))
        open_ = open_.filter(node.isin(overfull))
    return Directory(start, splits)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, first_depth: int = FIRST_DEPTH, hash_of=F.xxhash64, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The index in the shared folder, one row for each row of docs: bucket, page, hash, link (place in the chain of the hash),
    id, mark (hash of the text as it is), digest, and keep_id and group_size of the entry in this bucket and page.

    page is null but for hashes with overflow pages."""
    raw = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text_or_empty(text)).alias("mark"), normalised(text).alias("norm"))
    rows = raw.withColumn("hash", hash_of(F.col("norm")))
    hashes = stored(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "dedup-hashes")
    total = hashes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fits = min(capacity, max(page_rows, total // PAGE_SHARE))
    paged = hashes.filter(F.col("n") > fits).select(F.col("hash").alias("of"), F.ceil(F.col("n") / fits).alias("pages"))
    directory = grow_directory(hashes.filter(F.col("n") <= fits), capacity, first_depth)
    owners = min(1 << directory.start, max(1 << first_depth, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    # paged has fewer than total / fits rows of 16 bytes: PAGE_SHARE, or rows / capacity in very large tables
    placed = rows.join(F.broadcast(paged), F.col("hash") == F.col("of"), "left")
    placed = placed.withColumn("page", F.pmod(F.xxhash64("id", "mark"), F.col("pages"))).withColumn("bucket", directory.bucket())
    even = F.floor(node_at(directory.start).bitwiseAND(F.lit((1 << directory.start) - 1)) / F.lit((1 << directory.start) / owners))
    owner = F.when(F.col("page").isNotNull(), F.pmod(F.xxhash64("hash", "page"), F.lit(owners))).otherwise(even).cast("int")
    owned = placed.withColumn("owner", owner).repartitionById(owners, F.col("owner"))

    place = ["owner", "bucket", "page", "hash"]
    chain, entry = Window.partitionBy(*place).orderBy("norm"), Window.partitionBy(*place, "norm")
    entries = owned.select(
        "bucket", "page", "hash", F.dense_rank().over(chain).alias("link"), "id", "mark", F.sha2("norm", 256).alias("digest"),
        F.min("id").over(entry).alias("keep_id"), F.count(F.lit(1)).over(entry).alias("group_size"),
    )
    return stored(entries, "dedup-index", "bucket")


def exact_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, first_depth: int = FIRST_DEPTH, hash_of=F.xxhash64, page_rows: int = PAGE_ROWS) -> DataFrame:
    """(id, mark, keep_id, group_size, digest), one row for each row of docs: the index with the pages of an entry added up."""
    index = build_index(docs, doc_id, text, capacity, first_depth, hash_of, page_rows)
    columns = ["id", "mark", "keep_id", "group_size", "digest"]
    paged = index.filter("page IS NOT NULL")
    pages = paged.groupBy("hash", "digest", "page").agg(F.min("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
    whole = stored(pages.groupBy("hash", "digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")), "dedup-pages")
    total = whole.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    added = join_classes(paged.select("id", "mark", "hash", "digest"), whole, ["hash", "digest"], "group_size", total, F.struct("id", "mark"))
    return index.filter("page IS NULL").select(*columns).unionByName(added.select(*columns))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, first_depth: int = FIRST_DEPTH, hash_of=F.xxhash64, page_rows: int = PAGE_ROWS) -> DataFrame:
    """One row for each row of docs: its id column, keep_id, group_size, kept and text_sha256.

    A null text counts as empty, and all empty texts are one class. keep_id is the least id of the class; ids
    that are null count only if there is no other (keep_id null, kept true). A row repeated with the same id
    is kept or dropped as one document. Other columns of docs, whatever their names, aren't looked at. An
    empty table gives no rows."""
    found = exact_classes(docs, doc_id, text, capacity, first_depth, hash_of, page_rows)
    return found.select(F.col("id").alias(doc_id), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: those whose id is the least of their class.

    What goes is taken from the index, as ids and hashes, and written; here texts move only if that list is too
    large for Spark to broadcast. Ids that are null go if their class has another."""
    found = exact_classes(docs, doc_id, text)
    own, mark = fresh("id"), fresh("mark")
    gone = found.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias(own), F.col("mark").alias(mark)).distinct()
    return docs.join(stored(gone, "exact-gone"), F.col(f"`{doc_id}`").eqNullSafe(F.col(own)) & (F.xxhash64(text_or_empty(text)) == F.col(mark)), "left_anti")
