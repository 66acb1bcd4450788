"""Substring dedup by a suffix array, built block by block with a difference cover.

A byte goes if a string of LENGTH bytes covers it that also starts anywhere else. Such strings ("windows") are
suffixes that agree in their first LENGTH bytes, so they stand side by side in the order of all suffixes.

1. Suffixes are dealt to buckets by a part of their own bytes: the least hash of all GRAM-byte strings in the window. Equal
   windows have equal least hashes. Consecutive windows of one bucket are a run, and stand on one short stretch
   of text (a region). A hash that stands in the corpus once can't be part of a repeat; its run is done. This is
   exact: windows are left out only where they can't be equal to another.
2. Runs of one bucket whose regions are all the same are repeats. Of all other buckets the different regions go, with their
   bytes, to the bucket's owner. A bucket with more than REGIONS of them is cut into parts.
3. An owner takes some buckets at a time. The places that a difference cover modulo COVER picks get ranks by
   doubling. Suffixes are then sorted one range of leading bytes at a time: by their first COVER bytes, and where
   these tie, by the ranks at the places that the cover has for both. Neighbours whose first LENGTH bytes
   are the same are repeats. Memory is that of one block, however long the ties are.
4. Parts of one bucket meet once more, one window for each of their classes, by digest.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmosaic.llm.shared import discard, join_classes, stored

#: Bytes of a repeat.
LENGTH = 200
#: Windows of one run, at most.
RUN = 256
#: Period of the difference cover: bytes by which suffixes are sorted before ranks are asked.
COVER = 32
#: Different regions that one bucket hands to one owner at once, at most.
REGIONS = 2_000
#: Bytes of text that are hashed, or of regions that are sorted, at once.
BLOCK_BYTES = 1 << 21
#: Suffixes of one range of leading bytes, about.
RANGE = 1 << 17
_NO_ID = -(2**63)
_BASE = 0x9E3779B97F4A7C15
_MIX = 0xBF58476D1CE4E5B9


def gram_of(length: int) -> int:
    """Bytes of the strings whose least hash names a bucket: the power of two that is at most a sixth of the window."""
    return 1 << max(0, (length // 6).bit_length() - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed polynomial hash (modulo 2**64) of the gram bytes from each place; gram is a power of two."""
    h, factor, step = data.astype(np.uint64) + np.uint64(1), _BASE, 1
    while step < gram:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor % 2**64, 2 * step
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of width values from each place."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs_in(data: np.ndarray, first: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(piece, start, windows, hash, inner) of the runs of the pieces first:stop of data; start is a place in data.

    inner tells that the run's hash stands in it more than once, so that its own windows may be equal."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    gram = gram_of(length)
    width = length - gram + 1
    hashes = gram_hashes(data, gram)
    least = sliding_least(hashes, width)
    piece = np.searchsorted(first, np.arange(len(least)), side="right") - 1
    whole = np.arange(len(least)) + length <= stop[piece]
    changed = np.r_[True, (least[1:] != least[:-1]) | (piece[1:] != piece[:-1]) | (whole[1:] != whole[:-1])]
    starts = np.flatnonzero(changed)
    many = np.diff(np.r_[starts, len(least)])
    ok = whole[starts]
    starts, many = starts[ok], many[ok]
    cuts = -(-many // RUN)
    number = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    starts, many = np.repeat(starts, cuts) + RUN * number, np.minimum(RUN, np.repeat(many, cuts) - RUN * number)
    mark = least[starts]
    # places of each run's hash: the grams of all its windows, as (hash, place) in one sorted list
    known, back = np.unique(mark, return_inverse=True)
    at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
    place = np.flatnonzero(known[at] == hashes) if len(known) else none
    size = len(data) + 1
    listed = np.sort(at[place].astype(np.int64) * size + place)
    low = back.astype(np.int64) * size + starts
    found = np.searchsorted(listed, low + many + width - 1) - np.searchsorted(listed, low)
    return piece[starts], starts, many, mark, found > 1


def pieces_of(sizes: list[int], length: int, block: int = BLOCK_BYTES) -> list[list[tuple[int, int, int]]]:
    """Blocks of (text, low, high) of about block bytes: a long text is cut, each cut with the bytes that its last windows need."""
    blocks, own, filled = [], [], 0
    for text, size in enumerate(sizes):
        for low in range(0, max(0, size - length + 1), block):
            high = min(size, low + block + length - 1)
            if own and filled + high - low > block + length:
                blocks.append(own)
                own, filled = [], 0
            own.append((text, low, high))
            filled += high - low
    return [*blocks, own] if own else blocks


def text_runs(texts: pa.Array, length: int):
    """Blocks of (text, start, windows, hash, inner, the block's bytes, start in them) of all runs of the texts."""
    views = [t.as_buffer() for t in texts]
    for block in pieces_of([0 if v is None else len(v) for v in views], length):
        of, low, high = (np.array(x, np.int64) for x in zip(*block, strict=True))
        joined = b"".join([bytes(memoryview(views[t])[a:b]) for t, a, b in block])
        stop = np.cumsum(high - low)
        first = stop - (high - low)
        piece, start, many, mark, inner = runs_in(np.frombuffer(joined, np.uint8), first, stop, length)
        yield of[piece], start - first[piece] + low[piece], many, mark, inner, joined, start


@lru_cache(maxsize=4)
def difference_cover(period: int) -> tuple[np.ndarray, np.ndarray]:
    """(picked, shift): a set of residues such that any two places have a common distance to picked ones; shift[i, j] is that distance.

    Residues are added one by one, each the one that gives most new differences."""
    picked, seen = [0], {0}
    while len(seen) < period:
        gain = lambda r: len({d % period for p in picked for d in (r - p, p - r)} - seen)
        best = max((r for r in range(period) if r not in picked), key=lambda r: (gain(r), -r))
        seen |= {d % period for p in picked for d in (best - p, p - best)}
        picked.append(best)
    shift = np.full((period, period), period, np.int64)
    i, j = np.meshgrid(np.arange(period), np.arange(period), indexing="ij")
    inside = np.isin(np.arange(period), picked)
    for k in reversed(range(period)):
        shift[inside[(i + k) % period] & inside[(j + k) % period]] = k
    return np.array(sorted(picked), np.int64), shift


class Block:
    """Regions in a row, each from a multiple of COVER on and followed by zero bytes, and the ranks of their cover places."""

    def __init__(self, regions: list[bytes]):
        sizes = np.fromiter(map(len, regions), np.int64, len(regions))
        held = -(-sizes // COVER) * COVER + COVER
        self.first = np.cumsum(held) - held
        self.end = np.cumsum(held)
        self.data = b"".join([r.ljust(h, b"\0") for r, h in zip(regions, held.tolist(), strict=True)]) + bytes(2 * COVER)
        word = np.frombuffer(self.data, np.uint8).astype(np.uint64)
        for step in (1, 2, 4):
            word = (word[:-step] << np.uint64(8 * step)) | word[step:]
        self.word = word  # the eight bytes from each place, as a number that sorts as they do
        self._rank(int(held.max(initial=0)))

    def _rank(self, longest: int) -> None:
        """Ranks of the suffixes (up to the end of their region) at cover places: by COVER bytes, then twice as far each time."""
        picked, _ = difference_cover(COVER)
        total = int(self.end[-1]) if len(self.end) else 0
        place = (np.arange(0, total, COVER)[:, None] + picked).reshape(-1)
        self.rank = np.zeros(total + COVER, np.int64)
        order = np.lexsort([self.word[place + 8 * k] for k in reversed(range(COVER // 8))])
        new = np.zeros(len(place), bool)
        for k in range(COVER // 8):
            own = self.word[place[order] + 8 * k]
            new[1:] |= own[1:] != own[:-1]
        self.rank[place[order]] = np.cumsum(new) + 1
        region_end = np.repeat(self.end, (self.end - self.first) // COVER * len(picked))
        far = COVER
        while far < longest:
            later = place + far
            key = self.rank[place] * (len(place) + 2) + np.where(later < region_end, self.rank[np.minimum(later, total)], 0)
            known, back = np.unique(key, return_inverse=True)
            self.rank[place] = back + 1
            if len(known) == len(place):
                break
            far *= 2

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for suffixes with the same first COVER bytes, by the ranks at the next places that the cover has for both."""
        shift = difference_cover(COVER)[1][a % COVER, b % COVER]
        return np.sign(self.rank[a + shift] - self.rank[b + shift])

    def sort_ties(self, order: np.ndarray, tied: np.ndarray) -> np.ndarray:
        """order with the suffixes of each tie group (equal numbers, ascending) sorted: all groups are split at a pivot of their own, again and again."""
        open_ = np.flatnonzero(np.bincount(tied)[tied] > 1)
        group = tied.astype(np.int64)
        while len(open_):
            own = group[open_]
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            sizes = np.diff(np.r_[heads, len(own)])
            pivot = np.repeat(order[open_][heads + sizes // 2], sizes)
            told = self.compare(order[open_], pivot)
            index = np.repeat(np.arange(len(heads)), sizes)
            key = 3 * index + told + 1
            by = np.argsort(key, kind="stable")
            order[open_] = order[open_][by]
            key = key[by]
            settled = (key % 3 == 1) | (np.bincount(key, minlength=3 * len(heads))[key] == 1)
            group[open_] = key
            open_ = open_[~settled]
        return order

    def same(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the length bytes from a and from b are the same."""
        equal = np.ones(len(a), bool)
        left = np.arange(len(a))
        for k in range(0, length, 8):
            word_a, word_b = self.word[a[left] + k], self.word[b[left] + k]
            spare = np.uint64(8 * max(0, k + 8 - length))
            ok = word_a >> spare == word_b >> spare
            equal[left[~ok]] = False
            left = left[ok]
        return equal

    def classes(self, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(order, new): place in the order of the suffixes there, and whether the window differs from the one before."""
        lead = self.word[place]
        splits = np.unique(np.sort(lead)[RANGE::RANGE])
        bucket = np.searchsorted(splits, lead, side="right")
        orders, news = [], []
        for number in np.unique(bucket).tolist():  # one range of leading bytes at a time
            own = place[bucket == number]
            order = own[np.lexsort([self.word[own + 8 * k] for k in reversed(range(COVER // 8))])]
            differs = np.zeros(len(order), bool)
            for k in range(COVER // 8):
                word = self.word[order + 8 * k]
                differs[1:] |= word[1:] != word[:-1]
            order = self.sort_ties(order, np.cumsum(differs))
            new = np.ones(len(order), bool)
            new[1:] = ~self.same(order[:-1], order[1:], length)
            orders.append(order)
            news.append(new)
        return np.concatenate(orders), np.concatenate(news)


def repeats_in(regions: list[bytes], length: int, asked: np.ndarray) -> tuple[list[bytes], list[list[tuple[int, bytes]]]]:
    """For each region the bits of its windows that stand in the regions more than once; and, for regions that
    are asked, (window, digest) of one window for each class that has one there."""
    many = np.fromiter(map(len, regions), np.int64, len(regions)) - length + 1
    block = Block(regions)
    region = np.repeat(np.arange(len(regions)), many)
    place = block.first[region] + np.arange(len(region)) - np.repeat(np.cumsum(many) - many, many)
    order, new = block.classes(place, length)
    kind = np.cumsum(new) - 1
    of = np.searchsorted(block.first, order, side="right") - 1
    window = order - block.first[of]
    flat = np.zeros(len(place), bool)
    flat[(np.cumsum(many) - many)[of] + window] = np.bincount(kind)[kind] > 1
    bits = [np.packbits(x).tobytes() for x in np.split(flat, np.cumsum(many)[:-1])]
    asks: list[list[tuple[int, bytes]]] = [[] for _ in regions]
    if asked.any():
        heads = np.flatnonzero(new & asked[of])
        for a, at, where in zip(of[heads].tolist(), window[heads].tolist(), order[heads].tolist(), strict=True):
            asks[a].append((at, hashlib.blake2b(block.data[where : where + length], digest_size=16).digest()))
    return bits, asks


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """own (the id as it is), id, row (a hash of the text), raw (the bytes of the text); rows of the same id and text are alike in all that follows."""
    rows = docs.select(F.col(doc_id).alias("own"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select("own", "id", F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("raw"))


def _batch(names: list[str], kinds: list[pa.DataType], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def bucket_sizes(rows: DataFrame, length: int) -> DataFrame:
    """(bucket, n): runs of each bucket, summed in each block of text first; one with equal strings inside counts twice."""

    def run(batches):
        for batch in batches:
            for _, _, _, mark, inner, _, _ in text_runs(batch.column(0), length):
                known, back = np.unique(mark, return_inverse=True)
                yield _batch(["bucket", "n"], [pa.int64(), pa.int64()], known.view(np.int64), np.bincount(back, 1 + inner).astype(np.int64))

    return rows.select("raw").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def text_run_rows(rows: DataFrame, length: int) -> DataFrame:
    """(id, row, start, windows, bucket, high, low, inner) of all runs; high and low are the region's digest of 128 bits."""
    names = ["id", "row", "start", "windows", "bucket", "high", "low", "inner"]
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.bool_()]

    def run(batches):
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for of, start, many, mark, inner, joined, at in text_runs(batch.column(2), length):
                digest = b"".join([xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(at.tolist(), (at + many + length - 1).tolist(), strict=True)])
                digest = np.frombuffer(digest, np.int64).reshape(-1, 2)
                yield _batch(names, kinds, ids[of], marks[of], start, many, mark.view(np.int64), digest[:, 0], digest[:, 1], inner)

    return rows.select("id", "row", "raw").mapInArrow(run, "id long, row long, start long, windows int, bucket long, high long, low long, inner boolean")


def region_rows(texts: DataFrame, length: int) -> DataFrame:
    """(bucket, high, low, regions, region) from (id, row, raw, runs): the bytes of the regions that runs asks for, once for each task."""
    names = ["bucket", "high", "low", "regions", "region"]
    kinds = [pa.int64()] * 4 + [pa.binary()]

    def run(batches):
        seen = set()  # a pair of numbers for each text of the task
        for batch in batches:
            for one, text in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if text in seen:
                    continue
                seen.add(text)
                raw, runs = memoryview(batch.column(2)[one].as_buffer()), batch.column(3)[one].values
                start, windows, *rest = (runs.field(k).to_numpy() for k in range(6))
                for low in range(0, len(start), 1 << 12):
                    own = slice(low, low + (1 << 12))
                    regions = [bytes(raw[a : a + n + length - 1]) for a, n in zip(start[own].tolist(), windows[own].tolist(), strict=True)]
                    yield _batch(names, kinds, *(r[own] for r in rest), regions)

    return texts.mapInArrow(run, "bucket long, high long, low long, regions long, region binary")


def sorted_regions(regions: DataFrame, length: int, limit: int) -> DataFrame:
    """(bucket, high, low, bits, asks) from the different regions of each bucket, in owners of whole buckets or of parts of large ones."""
    part = F.when(F.col("regions") > limit, F.pmod("high", F.ceil(F.col("regions") / limit))).otherwise(0).cast("long")
    dealt = regions.withColumn("part", part).repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    names = ["bucket", "high", "low", "bits", "asks"]
    asked_kind = pa.list_(pa.struct([("window", pa.int32()), ("digest", pa.binary())]))

    def told(table):
        large = table.column("regions").to_numpy() > limit
        bits, asks = repeats_in(table.column("region").to_pylist(), length, large)
        asks = [[{"window": w, "digest": d} for w, d in own] for own in asks]
        return _batch(names, [pa.int64()] * 3 + [pa.binary(), asked_kind], *(table.column(n).to_numpy() for n in names[:3]), bits, asks)

    def run(batches):
        held = None
        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, fresh]) if held is not None else fresh
            if held.column("region").nbytes >= BLOCK_BYTES:
                owner = np.stack([held.column(n).to_numpy() for n in ("bucket", "part")])
                ends = 1 + np.flatnonzero((owner[:, 1:] != owner[:, :-1]).any(0))
                if len(ends):  # the last group may go on in the next batch
                    yield told(held.slice(0, ends[-1]))
                    held = held.slice(ends[-1])
        if held is not None and held.num_rows:
            yield told(held)

    dealt = dealt.select("bucket", "high", "low", "regions", "region", "part")
    return dealt.mapInArrow(run, "bucket long, high long, low long, bits binary, asks array<struct<window:int,digest:binary>>")


def repeated_windows(rows: DataFrame, length: int = LENGTH, limit: int = REGIONS) -> DataFrame:
    """(id, row, runs): for each text with repeats, an array of (start, windows, bits, more): windows from start on, of which
    bits (all, if null) and those numbered in more are repeats. A table of the shared folder."""
    total = lambda df, n: df.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    spread = F.struct("id", "row", "start")
    sizes = stored(bucket_sizes(rows, length).filter("n > 1"), "repeated-buckets")
    keys, spread = ["bucket", "high", "low"], F.struct("id", "row", "start")
    runs = join_classes(text_run_rows(rows, length), sizes, ["bucket"], "n", total(sizes, "n"), spread).filter("n is not null").drop("n")
    runs = stored(runs, "repeated-bucket-runs")
    discard(sizes)
    # one place of each different region tells its bytes; rows of one id and text are one place, but count each
    place = F.min(F.struct("id", "row", "start", "windows")).alias("at")
    different = stored(runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner"), place), "different-regions")
    kinds = stored(different.groupBy("bucket").agg(F.count(F.lit(1)).alias("regions"), F.max("inner").alias("within")).filter("within or regions > 1"), "mixed-buckets")
    asked = join_classes(different, kinds, ["bucket"], "regions", total(kinds, "regions"), F.col("high")).filter("regions is not null")
    asked = asked.select("at.*", *keys, "regions").groupBy("id", "row").agg(F.collect_list(F.struct("start", "windows", *keys, "regions")).alias("runs"))
    texts = rows.join(asked, ["id", "row"]).select("id", "row", "raw", "runs")
    answers = stored(sorted_regions(region_rows(texts, length), length, limit), "sorted-regions")
    discard(kinds)
    asks = answers.filter(F.size("asks") > 0).select(*keys, F.inline("asks"))
    again = asks.groupBy("digest").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("digest")
    more = asks.join(again, "digest").groupBy(*keys).agg(F.collect_list("window").alias("more"))
    single = lambda c: F.when(F.col("n") == 1, F.col(c)).alias(c)  # noqa: E731  a region that stands in several places is a repeat as a whole
    table = different.select(*keys, "n").join(answers.select(*keys, "bits"), keys, "left").join(more, keys, "left").filter("n > 1 or bits is not null")
    table = stored(table.select(*keys, "n", single("bits"), single("more")), "region-answers")
    discard(different, answers)
    told = join_classes(runs, table, keys, "n", total(table, "n"), spread).filter("n is not null")
    result = stored(told.groupBy("id", "row").agg(F.collect_set(F.struct("start", "windows", "bits", "more")).alias("runs")), "repeated-windows")
    discard(runs, table)
    return result


def removed_spans(runs: pa.StructArray | None, length: int) -> np.ndarray:
    """Starts and stops (two columns) of the bytes that repeated windows cover, in order, joined where they meet."""
    if runs is None or not len(runs):
        return np.zeros((0, 2), np.int64)
    low, high = [], []
    start, windows = runs.field(0).to_numpy(), runs.field(1).to_numpy()
    whole = runs.field(2).is_null().to_numpy(zero_copy_only=False)
    low.append(start[whole])
    high.append(start[whole] + windows[whole] + length - 1)
    for k in np.flatnonzero(~whole).tolist():
        flags = np.unpackbits(np.frombuffer(runs.field(2)[k].as_buffer(), np.uint8), count=int(windows[k]))
        if runs.field(3)[k].is_valid:
            flags[runs.field(3)[k].values.to_numpy()] = 1
        edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
        low.append(start[k] + edges[::2])
        high.append(start[k] + edges[1::2] + length - 1)
    low, high = np.concatenate(low), np.concatenate(high)
    if not len(low):
        return np.zeros((0, 2), np.int64)
    by = np.argsort(low, kind="stable")
    low, high = low[by], np.maximum.accumulate(high[by])
    heads = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
    return np.stack([low[heads], np.r_[high[heads[1:] - 1], high[-1]]], 1)


def cut_repeated_bytes(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", limit: int = REGIONS) -> DataFrame:
    """(doc_id, n_bytes, spans, kept), one row for each row of docs: bytes of the text, the spans (start, stop in bytes, stop
    exclusive) that go because strings of length bytes cover them that also start anywhere else, in any document, and
    the bytes that are left.

    Strings are judged on the input: all places of a repeat go, the first one too. They don't cross documents. Each
    row is a document, so the texts of repeated rows are repeats. Ids are whole numbers; a null id is an id like any
    other. A null text counts as empty. A text of under length bytes has no spans. Other columns aren't looked
    at. An empty table gives no rows. kept can end inside a character."""
    runs = repeated_windows(_rows(docs, doc_id, text), length, limit)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = _rows(docs, doc_id, text).join(runs, ["id", "row"], "left").select("own", "raw", "runs")
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in batches:
            for one in range(batch.num_rows):  # a row at a time: texts may be long
                raw = memoryview(batch.column(1)[one].as_buffer())
                spans = removed_spans(batch.column(2)[one].values, length)
                cuts = [0, *spans.reshape(-1).tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                told = [{"start": a, "stop": b} for a, b in spans.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(one, 1), pa.array([len(raw)], pa.int64()), pa.array([told], span), pa.array([kept], pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    found = rows.mapInArrow(run, f"id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return found.withColumnRenamed("id", doc_id)
