"""Target-distribution importance resampling on hashed word features.

A feature's bucket is its crc32; a bucket's gain compares how often the target and the whole corpus have it. A document's weight
is the sum of its features' gains, and the documents with the highest weights plus seeded Gumbel noise are drawn,
which samples without replacement in proportion to the exponential of the weights.

Features are interned slice by slice in an open-addressed table of NumPy arrays: keys are their xxhash64, equal
keys are verified by their bytes, and each slot holds bucket and count. So crc32 runs once a
different feature, and a document's weight is a sum over the gains of its occurrences' slots. The histograms are
BUCKETS numbers a task; the ranks of the drawn documents come from a sort by sampled ranges, so that no task gets all of them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmosaic.llm.shared import fresh, stored

#: Buckets of features.
BUCKETS = 10_000
#: Bytes of text that are interned in one table.
SLICE_BYTES = 1 << 21
#: Longer features are hashed one by one.
SHORT = 31

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values: the primes of XXH64

_byte = np.arange(256)
#: What a byte becomes (A-Z in lower case), and whether it belongs to a word: digits, letters and all bytes of characters beyond ASCII.
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 0x20, _byte).astype(np.uint8)
IN_WORD = ((LOWER >= 0x30) & (LOWER <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A)) | (LOWER >= 0x80)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hash_columns(cells: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each row of cells: features of one length, SHORT bytes at most."""
    n = cells.shape[1]
    h = np.full(len(cells), _P5 + np.uint64(n))
    at = 0
    while at + 8 <= n:
        lane = np.ascontiguousarray(cells[:, at : at + 8]).view("<u8")[:, 0]
        h = _turn(h ^ (_turn(lane * _P2, 31) * _P1), 27) * _P1 + _P4
        at += 8
    if at + 4 <= n:
        lane = np.ascontiguousarray(cells[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64)
        h = _turn(h ^ (lane * _P1), 23) * _P2 + _P3
        at += 4
    for k in range(at, n):
        h = _turn(h ^ (cells[:, k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


class Interned:
    """Features of one slice in an open-addressed table: key, start and size of its bytes, bucket and count by slot."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, buckets: int, hash_of=hash_columns):
        self.data, self.buckets = data, buckets
        slots = 1 << max(4, int(2 * len(start)).bit_length())  # under half full, so that a free slot is always near
        self.key, self.start, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.full(slots, -1, np.int64)
        self.bucket, self.count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        #: The slot of each occurrence.
        self.slot = np.zeros(len(start), np.int64)
        for length in np.unique(size).tolist():
            own = np.flatnonzero(size == length)
            for low in range(0, len(own), max(1, SLICE_BYTES // max(1, length))):
                self._put(own[low : low + max(1, SLICE_BYTES // max(1, length))], start, length, hash_of)
        used = np.flatnonzero(self.size >= 0)
        raw = memoryview(np.ascontiguousarray(data))
        self.bucket[used] = [zlib.crc32(raw[a : a + n]) % buckets for a, n in zip(self.start[used].tolist(), self.size[used].tolist(), strict=True)]
        self.count = np.bincount(self.slot, minlength=slots)

    def _put(self, own: np.ndarray, start: np.ndarray, length: int, hash_of) -> None:
        cells = self.data[start[own][:, None] + np.arange(length)]
        key = hash_of(cells) if length <= SHORT else np.array([xxhash.xxh64_intdigest(c.tobytes()) for c in cells], np.uint64)
        mask = np.uint64(len(self.key) - 1)
        at = (key & mask).astype(np.int64)
        open_ = np.arange(len(own))
        while len(open_):
            free = open_[self.size[at[open_]] < 0]
            if len(free):  # of all that want one slot the last gets it, in all three arrays
                self.start[at[free]] = start[own[free]]
                self.key[at[free]] = key[free]
                self.size[at[free]] = length
            slot = at[open_]
            same = (self.key[slot] == key[open_]) & (self.size[slot] == length)
            like = np.flatnonzero(same)
            same[like] = (self.data[self.start[slot[like]][:, None] + np.arange(length)] == cells[open_[like]]).all(1)
            self.slot[own[open_[same]]] = slot[same]
            open_ = open_[~same]
            at[open_] = (at[open_] + 1) & int(mask)


def pieces_of(views: list[np.ndarray], most: int, block: int = SLICE_BYTES) -> list[list[tuple[int, int, int, int]]]:
    """Blocks of (text, back, low, high) of about block bytes. A long text is cut behind words; from back on stand the words
    before low that features which end behind low can hold."""
    blocks, own, filled = [], [], 0
    for text, view in enumerate(views):
        low = 0
        while low < len(view):
            high = min(len(view), low + block)
            while high < len(view) and IN_WORD[view[high]]:
                rest = np.flatnonzero(~IN_WORD[view[high : high + block]])
                high = high + int(rest[0]) if len(rest) else min(len(view), high + block)
            back = low
            for _ in range(most - 1 if low else 0):
                while back and not IN_WORD[view[back - 1]]:
                    back -= 1
                while back and IN_WORD[view[back - 1]]:
                    back -= 1
            if own and filled + high - back > block:
                blocks.append(own)
                own, filled = [], 0
            own.append((text, back, low, high))
            filled += high - back
            low = high
    return [*blocks, own] if own else blocks


def features_of(views: list[np.ndarray], most: int):
    """Blocks of (words by text, text of each feature, bytes, start, size): features are all runs of 1 to most words, joined by one space."""
    for block in pieces_of(views, most):
        joined = np.concatenate([x for t, back, _, high in block for x in (views[t][back:high], np.zeros(1, np.uint8))])
        sizes = np.array([high - back + 1 for _, back, _, high in block])
        first = np.cumsum(sizes) - sizes
        old = first + np.array([low - back for _, back, low, _ in block])  # words that start before are of the piece before
        of_piece = np.array([t for t, *_ in block])
        word = IN_WORD[joined]
        kept = word | np.r_[False, word[:-1]]
        starts = np.flatnonzero(word & ~np.r_[False, word[:-1]])
        piece = np.searchsorted(first, starts, side="right") - 1
        fresh = starts >= old[piece]
        data = np.where(word, LOWER[joined], np.uint8(0x20))[kept]
        upto = np.cumsum(kept) - 1
        begin = upto[starts]
        end = np.r_[begin[1:], len(data)] - 1
        words = np.bincount(of_piece[piece[fresh]], minlength=len(views))
        texts, heads, lengths = [], [], []
        for n in range(1, most + 1):
            last = np.arange(n - 1, len(starts))
            head = last - n + 1
            ok = fresh[last] & (piece[head] == piece[last])
            texts.append(of_piece[piece[last[ok]]])
            heads.append(begin[head[ok]])
            lengths.append(end[last[ok]] - begin[head[ok]])
        yield words, np.concatenate(texts), data, np.concatenate(heads), np.concatenate(lengths)


def _views(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t.as_buffer(), np.uint8) for t in column]


def bucket_counts(docs: DataFrame, most: int = 1, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket that has any; a null text has none."""
    raw = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("raw"))

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, start, size in features_of(_views(batch.column(0)), most):
                table = Interned(data, start, size, buckets)
                total += np.bincount(table.bucket, table.count, buckets).astype(np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    return raw.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket 1000 times the logarithm of its smoothed share in the target over that in the corpus, rounded down."""
    s = np.array([corpus.get(b, 0) for b in range(buckets)], float)
    t = np.array([target.get(b, 0) for b in range(buckets)], float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, most: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight), one row for each row of docs: weight is the sum of the gains of its features."""
    rows = docs.select(F.col(doc_id).alias("own"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("raw"))
    kind = rows.schema["own"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        gain = sent.value
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for words, of, data, start, size in features_of(_views(batch.column(1)), most):
                table = Interned(data, start, size, len(gain))
                n_words += words
                n_features += np.bincount(of, minlength=batch.num_rows)
                weight += np.bincount(of, gain[table.bucket][table.slot], batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], names=["own", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"own {kind}, n_words long, n_features long, weight long").withColumnRenamed("own", doc_id)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise by a hash of seed and id (a null id as no characters), in thousandths, rounded down."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.ln(-F.ln(share)))


def rank_rows(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank (1, 2, 3 ...) in an order that is total: dealt by sampled ranges, numbered in each range, and moved on by the
    sizes of the ranges before."""
    dealt = stored(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranked-ranges")
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = sizes.select(F.col("__range").alias("__of"), (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("rank", inside).join(F.broadcast(before), F.col("__range") == F.col("__of")).withColumn("rank", F.col("rank") + F.col("__before")).drop("__range", "__of", "__before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, most: int = 1, seed: int = 2024, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row for each row of docs.

    Of the documents with least_words words or more, percent in a hundred (rounded down) are drawn: the highest
    scores, ties to the smaller id (a null id last). rank counts them from 1; the others have a null rank. Words
    are runs of ASCII letters and digits (A-Z in lower case) and characters beyond ASCII.

    A null or empty text has no features and weighs 0. Each row is a document; of rows alike in score and id
    any may come first. An empty corpus gives no rows; an empty target weighs as no counts at all. Other columns
    aren't looked at."""
    told = lambda df, column: {r[0]: r[1] for r in bucket_counts(df, most, buckets, column).collect()}  # noqa: E731  buckets rows at most
    gains = gains_of(told(docs, text), told(target, target_text), buckets)
    scored = weigh(docs, gains, most, doc_id, text).withColumn("score", F.col("weight") + gumbel(F.col(f"`{doc_id}`"), seed))
    scored = stored(scored.withColumn("tie", F.monotonically_increasing_id()), "importance-scores")
    open_ = F.col("n_words") >= least_words
    drawn = percent * scored.filter(open_).count() // 100
    columns = [F.col(f"`{doc_id}`"), "n_features", "weight", "score"]
    ranked = rank_rows(scored.filter(open_), [F.col("score").desc(), F.col(f"`{doc_id}`").asc_nulls_last(), F.col("tie")])
    ranked = ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.union(scored.filter(~open_).select(*columns, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of docs with rank, all columns kept. Ids are unique here; rows of one id would each meet all its ranks."""
    drawn = resample(docs, target, **how).filter("rank is not null")
    own = how.get("doc_id", "doc_id")
    id_ = fresh("id")
    return docs.join(drawn.select(F.col(f"`{own}`").alias(id_), F.col("rank")), F.col(f"`{own}`") == F.col(id_)).drop(id_)
