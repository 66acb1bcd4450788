"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text: the last 32 bytes alone decide whether a chunk ends, so that
the same passage is cut in the same places wherever it stands and an insertion moves only the chunks it
touches. What is compared over all documents is the digest of a run (its bytes, and where they are cut): a chunk with
as many that follow it as make MIN_SPAN bytes. A run that two documents or more have is a repeated passage as it stands. Its keeper is the least
of these documents: there it is left, and in all others it can go. Runs of one document that overlap or touch and have one
keeper are one span.

No text is lost by cutting what isn't kept: where a chunk is cut, it also stands in a document of lesser id, and
so on down to one where it is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobmosaic.llm.shared import join_classes, stored

WINDOW = 32
#: One position in so many may end a chunk.
MEAN_GAP = 20
#: An end that close behind another possible end is none.
MIN_GAP = 8
#: Longer chunks are cut every so many bytes.
MAX_CHUNK = 256
#: Bytes of a repeated passage, at least. A passage of 50 words has about 300, of which a chunk may be lost at either end.
MIN_SPAN = 96
#: Bytes that are hashed at once, and runs that are handed over at once.
SLICE_BYTES = 1 << 21
SLICE_RUNS = 1 << 16
_NO_ID = -(2**63)


def _gear() -> np.ndarray:
    """256 numbers of 32 bits by a mixing rule; zero bytes stand between texts and add nothing."""
    x = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of the last 32 table values, each shifted by its distance."""
    value = GEAR[data]
    step = 1
    while step < WINDOW:
        value[step:] += value[:-step] << np.uint32(step)
        step *= 2
    return value


def possible_ends(data: np.ndarray) -> np.ndarray:
    """Places behind bytes whose hash lets a chunk end, slice by slice; a slice starts with the bytes its first hash needs."""
    found = [np.zeros(0, np.int64)]
    for low in range(0, len(data), SLICE_BYTES):
        before = min(low, WINDOW - 1)
        hashes = rolling(data[low - before : low + SLICE_BYTES])[before:]
        found.append(low + 1 + np.flatnonzero(hashes < np.uint32(2**32 // MEAN_GAP)))
    return np.concatenate(found)


def chunk_ends(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Starts and ends of the chunks of texts that stand at first:last in data, WINDOW zero bytes apart; never inside a code point."""
    inner = lambda at: (data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80) & (at < len(data))
    ends = possible_ends(data)
    ends = ends[~inner(ends)]
    ends = ends[np.diff(ends, prepend=-MIN_GAP) >= MIN_GAP]
    of = np.searchsorted(first, ends - 1, side="right") - 1
    ok = of >= 0
    ends, of = ends[ok], of[ok]
    ends = ends[(ends <= last[of]) & (ends - first[of] >= MIN_GAP)]
    cuts = np.unique(np.concatenate([ends, first, last]))
    gaps = np.diff(cuts)
    inside = np.searchsorted(first, cuts[:-1], side="right") - 1
    more = np.where(cuts[:-1] < last[inside], (gaps - 1) // MAX_CHUNK, 0)
    extra = np.repeat(cuts[:-1], more) + MAX_CHUNK * (np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1)
    for _ in range(3):
        extra = extra - inner(extra)
    return np.unique(np.concatenate([cuts, extra]))


def chunks_of(raw: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in a row, and (text number, start, end) of their chunks, in bytes of that row."""
    joined = bytes(WINDOW).join(raw)
    data = np.frombuffer(joined, np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    first = np.cumsum(sizes + WINDOW) - sizes - WINDOW
    filled = sizes > 0
    numbers, begin, end = np.flatnonzero(filled), first[filled], (first + sizes)[filled]
    if not len(numbers):
        none = np.zeros(0, np.int64)
        return joined, none, none, none
    cuts = chunk_ends(data, begin, end)
    starts, stops = cuts[:-1], cuts[1:]
    of = np.searchsorted(begin, starts, side="right") - 1
    ok = starts < end[of]  # what lies between two texts is no chunk
    return joined, numbers[of[ok]], starts[ok], stops[ok]


def cut_marks(starts: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """A number for where the chunks heads..tails of a run are cut, told by the sums of the distances from its start and
    of their squares and cubes, modulo 2**64: equal bytes that are cut elsewhere are another run."""
    c = starts.astype(np.uint64)
    s = c[heads]
    n, one, two, three = (np.r_[np.uint64(0), np.cumsum(x, dtype=np.uint64)] for x in (np.ones_like(c), c, c * c, c * c * c))
    n, one, two, three = (x[tails + 1] - x[heads] for x in (n, one, two, three))
    first, second = one - n * s, two - np.uint64(2) * s * one + n * s * s
    third = three - np.uint64(3) * s * two + np.uint64(3) * s * s * one - n * s * s * s
    return first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xBF58476D1CE4E5B9) + third * np.uint64(0x94D049BB133111EB) + n


def runs_of(raw: list[bytes], min_span: int = MIN_SPAN):
    """Blocks of (text number, start, stop, first byte, bytes, and a digest of 128 bits as two numbers) of all runs; start and stop in code points of the text.

    There is a run for each chunk behind which, the chunk included, its text has min_span bytes."""
    joined, of, starts, stops = chunks_of(raw)
    if not len(of):
        return
    data = np.frombuffer(joined, np.uint8)
    points = np.cumsum(np.add.reduceat(data & 0xC0 != 0x80, np.r_[starts, stops[-1:]][: len(starts)], dtype=np.int64))
    # what lies between two texts was counted with the last chunk of a text: a code point a byte
    gap = np.where(np.r_[of[1:] != of[:-1], False], np.r_[starts[1:], stops[-1]] - stops, 0)
    ends = points - np.cumsum(gap)
    begins = np.r_[0, ends[:-1]]
    heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    text = np.cumsum(np.r_[True, of[1:] != of[:-1]]) - 1
    origin, base = begins[heads][text], starts[heads][text]
    final = np.searchsorted(stops, starts + min_span)
    whole = np.flatnonzero((final < len(of)) & (of[np.minimum(final, len(of) - 1)] == of))
    shape = cut_marks(starts, whole, final[whole])
    for low in range(0, len(whole), SLICE_RUNS):
        at = whole[low : low + SLICE_RUNS]
        to = final[at]
        digests = [xxhash.xxh3_128_digest(joined[a:b], k) for a, b, k in zip(starts[at].tolist(), stops[to].tolist(), shape[low : low + SLICE_RUNS].tolist(), strict=True)]
        yield of[at], begins[at] - origin[at], ends[to] - origin[at], starts[at] - base[at], stops[to] - starts[at], *np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T


def slices(sizes: list[int]) -> list[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES together, of one text at least."""
    cuts, size = [0], 0
    for i, n in enumerate(sizes):
        if size and size + n > SLICE_BYTES:
            cuts.append(i)
            size = 0
        size += n
    return list(zip(cuts, [*cuts[1:], len(sizes)], strict=True)) if sizes else []


def document_runs(docs: DataFrame, min_span: int = MIN_SPAN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, start, stop, low, bytes, digest, digest_low): one row for each run of each text; row is a hash of the text."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text"))
    names = ["id", "row", "start", "stop", "low", "bytes", "digest", "digest_low"]

    def run(batches):
        for batch in batches:
            ids, marks, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for low, high in slices([len(t.as_buffer()) for t in texts]):
                own, mark = ids[low:high], marks[low:high]
                for of, start, stop, first, size, *digest in runs_of(texts.slice(low, high - low).to_pylist(), min_span):
                    columns = [pa.array(x, kind) for x, kind in zip((own[of], mark[of], start, stop, first, size, *digest), _KINDS, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, "id long, row long, start int, stop int, low int, bytes int, digest long, digest_low long")


_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def _joined(runs: DataFrame, *keys: str) -> DataFrame:
    """Runs (start, stop, low, high) that overlap or touch, with the same keys, as one."""
    along = Window.partitionBy(*keys).orderBy("start", "stop")
    so_far = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start") > so_far, F.lit(True)).cast("int")
    told = runs.withColumn("new", begins).withColumn("span", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return told.groupBy(*keys, "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("low").alias("low"), F.max("high").alias("high")).drop("span")


def _spans(docs: DataFrame, min_span: int, doc_id: str, text: str) -> DataFrame:
    """(id, row, least, start, stop, low, high) of the repeated passages."""
    runs = document_runs(docs, min_span, doc_id, text)
    seen = runs.groupBy("digest", "digest_low").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n"))
    repeated = stored(seen.filter("least < most").select("digest", "digest_low", "least", "n"), "repeated-runs")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = join_classes(runs, repeated, ["digest", "digest_low"], "n", total, F.struct("id", "start")).filter(F.col("n").isNotNull())
    found = found.select("id", "row", "least", "start", "stop", "low", (F.col("low") + F.col("bytes")).alias("high")).distinct()
    return _joined(found, "id", "row", "least")


def repeated_spans(docs: DataFrame, min_span: int = MIN_SPAN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, stop, n_bytes, first_doc_id, kept): the repeated passages of all documents.

    start and stop are code points, stop exclusive. first_doc_id is the least id of the documents that have the
    passage (or each of the overlapping runs it is made of); kept is true where that is the document itself.
    Spans with different first documents may overlap; what a span that isn't kept covers can go. Repeats inside
    one document alone don't count. Ids are whole numbers; rows with one id are one document, and rows without
    an id are together one document of null id, which is the least; rows of one document with the same text
    give their spans once. A null or empty text has no span. Other columns aren't looked at. An empty table
    gives no rows."""
    spans = _spans(docs, min_span, doc_id, text)
    public = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return spans.select(public("id").alias("doc_id"), "start", "stop", (F.col("high") - F.col("low")).alias("n_bytes"), public("least").alias("first_doc_id"), (F.col("id") == F.col("least")).alias("kept"))


def cut_repeats(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """docs with the repeated spans that aren't kept cut out of their texts; all columns and rows stay.

    Each chunk of the texts is left in one document at least."""
    spans = _joined(_spans(docs, min_span, "doc_id", "text").filter("id <> least"), "id", "row")
    cuts = spans.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts")).select(F.col("id").alias("__id"), F.col("row").alias("__row"), "cuts")
    pieces = F.expr("transform(sequence(0, size(cuts)), i -> substring(text, if(i = 0, 0, element_at(cuts, i).stop) + 1, if(i = size(cuts), length(text), element_at(cuts, i + 1).start) - if(i = 0, 0, element_at(cuts, i).stop)))")
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.col("text").cast("string").alias("text"))
    joined = wide.join(cuts, (F.col("id") == F.col("__id")) & (F.xxhash64("text") == F.col("__row")), "left")
    joined = joined.withColumn("text", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(pieces, "")))
    return joined.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
