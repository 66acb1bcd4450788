"""Byte-level BPE by segment trees over byte positions, and decoding.

Each piece of a text (a match of the split pattern) starts as single bytes. A segment tree over its byte
positions stores, at each node, the least (rank, position) of the pairs that start below it; its root is thus
the leftmost pair of least rank. Each merge takes the root and sets three leaves: of the pair itself, of the
live neighbour before it and of the one that was merged away. Short pieces of like length are merged side by
side, one column of arrays each, so that a step costs a few array operations for all of them; long pieces get
a tree of their own. Pieces that have been seen are kept up to a bound.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A step's rows are encoded in slices of about so many characters.
SLICE_CHARS = 1 << 20
#: Pieces that a worker keeps, and their characters together; one slice's pieces may go beyond that.
KEPT_PIECES = 200_000
KEPT_CHARS = 1 << 23
#: Longer pieces (bytes) get a tree of their own.
SIDE_BY_SIDE = 64
#: So many pieces are merged side by side.
COLUMNS = 1 << 13
_NONE = np.iinfo(np.int64).max
_LEAST = np.iinfo(np.int32).max


class Vocabulary:
    """Ranks of byte strings, the pairs of tokens that make a token, and the split pattern."""

    def __init__(self, lines: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.ranks, self.split = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.size = size

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes; _NONE where it makes none."""
        keys = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)


@lru_cache(maxsize=2)
def vocabulary(lines: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(lines, pattern)


def merge_long(piece: bytes, vocab: Vocabulary) -> list[int]:
    """Ids of one piece of any length: O(log n) a merge."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    ids = vocab.of_byte[np.frombuffer(piece, np.uint8)]
    tree_array = np.full(2 * width, _NONE, np.int64)
    ranks = vocab.rank_of(ids[:-1], ids[1:])
    tree_array[width : width + n - 1] = np.where(ranks == _NONE, _NONE, ranks << 40 | np.arange(n - 1))
    level = width
    while level > 1:
        tree_array[level // 2 : level] = np.minimum(tree_array[level : 2 * level : 2], tree_array[level + 1 : 2 * level : 2])
        level //= 2
    tree, live, none, pairs = tree_array.tolist(), ids.tolist(), int(_NONE), vocab.pairs
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(at: int, value: int) -> None:
        node = width + at
        tree[node] = value
        while node > 1:
            node >>= 1
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                break
            tree[node] = low

    def pair(at: int) -> int:
        if after[at] >= n:
            return none
        rank = pairs.get(live[at] << 20 | live[after[at]])
        return none if rank is None else rank << 40 | at

    while tree[1] != none:
        at = tree[1] & ((1 << 40) - 1)
        gone = after[at]
        live[at] = tree[1] >> 40
        live[gone] = -1
        after[at] = after[gone]
        if after[at] < n:
            before[after[at]] = at
        put(gone, none)
        put(at, pair(at))
        if before[at] >= 0:
            put(before[at], pair(before[at]))
    return [x for x in live if x >= 0]


def merge_columns(pieces: list[bytes], width: int, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many pieces of 2 to width bytes (a power of two): all ids in a row, and how many each has."""
    count = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, count)
    cells = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(count, width).T
    at = np.arange(width)[:, None]
    # one row more than positions: a neighbour that isn't there is row `width`
    live = np.full((width + 1, count), -1, np.int32)
    live[:width] = np.where(at < lengths, vocab.of_byte[cells], -1)
    after = np.where(at + 1 < lengths, at + 1, width).astype(np.int32)
    before = np.full((width + 1, count), width, np.int32)
    before[1:width] = np.arange(width - 1)[:, None]
    tree = np.full((2 * width, count), _LEAST, np.int32)
    there = live[1:width] >= 0
    ranks = vocab.rank_of(live[: width - 1][there], live[1:width][there])
    place = np.broadcast_to(at[: width - 1], there.shape)[there]
    tree[width : 2 * width - 1][there] = np.where(ranks == _NONE, _LEAST, ranks << 8 | place)
    level = width
    while level > 1:
        tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
        level //= 2

    # flat views: row r of column c is at r * count + c
    tree, live, after, before = (x.reshape(-1) for x in (tree, live, after, before))
    column = np.flatnonzero(tree[count : 2 * count] != _LEAST)
    while len(column):
        root = tree[count + column]
        rank, here = root >> 8, root & 255
        at_here = here * count + column
        gone = after[at_here]
        at_gone = gone * count + column
        later = after[at_gone]
        at_later = later * count + column
        earlier = before[at_here]
        at_earlier = earlier * count + column
        live[at_here] = rank
        live[at_gone] = -1
        after[at_here] = later
        before[at_later] = here  # row `width` takes what has no place
        leaf = width * count
        tree[leaf + at_gone] = _LEAST
        for ok, a, b, start, to in ((later < width, rank, live[at_later], here, at_here), (earlier < width, live[at_earlier], rank, earlier, at_earlier)):
            found = vocab.rank_of(a[ok], b[ok])
            if start is here:
                tree[leaf + to] = _LEAST
            tree[leaf + to[ok]] = np.where(found == _NONE, _LEAST, found << 8 | start[ok])
        nodes = np.stack([gone, here, np.where(earlier < width, earlier, gone)]).astype(np.int64) + width
        nodes >>= 1
        while nodes[0, 0]:
            children = 2 * count * nodes + column
            tree[count * nodes + column] = np.minimum(tree[children], tree[children + count])
            nodes >>= 1
        column = column[tree[count + column] != _LEAST]
    ids = live[: width * count].reshape(width, count).T
    kept = ids >= 0
    return ids[kept], kept.sum(1)


class Encoder:
    """Encodes texts; keeps the ids of up to KEPT_PIECES pieces of KEPT_CHARS characters between calls."""

    def __init__(self, vocab: Vocabulary, kept: int = KEPT_PIECES, kept_chars: int = KEPT_CHARS):
        self.vocab, self.kept, self.kept_chars = vocab, kept, kept_chars
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _keep(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        number, need = len(self.place), self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need, len(self.pool)), np.int32)])
        if number + len(pieces) > len(self.start):
            more = np.zeros(max(number + len(pieces), len(self.start)), np.int64)
            self.start, self.count = np.concatenate([self.start, more]), np.concatenate([self.count, more])
        self.pool[self.used : need] = ids
        at = slice(number, number + len(pieces))
        self.start[at], self.count[at] = self.used + np.cumsum(counts) - counts, counts
        self.place.update(zip(pieces, range(number, number + len(pieces)), strict=True))
        self.used = need
        self.chars += sum(map(len, pieces))

    def _learn(self, pieces: list[str]) -> None:
        vocab, raws = self.vocab, [p.encode("utf-8", "surrogatepass") for p in pieces]
        whole = np.fromiter(map(vocab.ranks.get, raws, repeat(-1)), np.int64, len(raws))
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        width = np.where(whole >= 0, 0, 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64))
        width = np.where(width <= SIDE_BY_SIDE, width, -1)
        for w in np.unique(width).tolist():
            group = np.flatnonzero(width == w)
            for low in range(0, len(group), COLUMNS):
                part = group[low : low + COLUMNS].tolist()
                if w == 0:
                    ids, counts = whole[part], np.ones(len(part), np.int64)
                elif w == -1:
                    merged = [merge_long(raws[i], vocab) for i in part]
                    ids, counts = np.array([x for m in merged for x in m]), np.array([len(m) for m in merged])
                else:
                    ids, counts = merge_columns([raws[i] for i in part], w, vocab)
                self._keep([pieces[i] for i in part], ids, counts)

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts in a row, and how many each text has."""
        if len(self.place) > self.kept or self.chars > self.kept_chars:
            self.clear()
        pieces = [self.vocab.split.findall(t) for t in texts]
        fresh: set[str] = set().union(*pieces).difference(self.place)
        if fresh:
            self._learn(list(fresh))
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter(map(self.place.__getitem__, chain.from_iterable(pieces)), np.int64, int(counts.sum()))
        return flat, counts

    def lengths(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has."""
        flat, counts = self.lookup(texts)
        upto = np.r_[0, np.cumsum(self.count[flat])]
        ends = np.cumsum(counts)
        return upto[ends] - upto[ends - counts]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        flat, counts = self.lookup(texts)
        many = self.count[flat]
        ends = np.cumsum(many)
        where = np.repeat(self.start[flat] - ends + many, many) + np.arange(int(many.sum()))
        upto = np.r_[0, ends]
        last = np.cumsum(counts)
        return self.pool[where], upto[last] - upto[last - counts]


def decode(ids: np.ndarray, counts: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, and how many each list of ids has. Unknown ids raise."""
    if len(ids) and (ids.min() < 0 or ids.max() >= vocab.size):
        raise ValueError("an id is not in the vocabulary")
    many = vocab.lengths[ids]
    ends = np.cumsum(many)
    where = np.repeat(vocab.starts[ids] - ends + many, many) + np.arange(int(many.sum()))
    upto = np.r_[0, ends]
    last = np.cumsum(counts)
    return vocab.bytes[where], upto[last] - upto[last - counts]


def slices(texts: pa.Array) -> list[tuple[int, int]]:
    """Ranges of texts of about SLICE_CHARS bytes, of one text at least."""
    cuts, size = [0], 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > SLICE_CHARS:
            cuts.append(i)
            size = 0
        size += n
    return list(zip(cuts, [*cuts[1:], len(texts)], strict=True)) if len(texts) else []


def read_ranks(path: str) -> bytes:
    """The vocabulary file (rank lines in base64), read once on the driver; its size is checked before it is sent along."""
    with open(path, "rb") as f:
        lines = f.read(1 << 26)
    if len(lines) == 1 << 26 or not re.match(rb"\S+ \d+\s", lines):
        raise ValueError(f"{path} isn't a rank file of under 64 MB")
    return lines


def _offsets(counts: np.ndarray, kind) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(counts)], kind)


def encode_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """(doc_id, token_ids), one row for each row of docs, as the ranks in path and the pattern give them; with back,
    decoded too: the bytes that the ids decode to.

    A null text counts as empty and has no ids. Rows repeated are encoded again. Other columns aren't looked
    at. An empty table gives no rows."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    lines = rows.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        encoder = Encoder(vocabulary(lines.value, pattern))
        for batch in batches:
            for low, high in slices(batch.column(1)):
                ids, counts = encoder.encode(batch.column(1).slice(low, high - low).to_pylist())
                lists = pa.ListArray.from_arrays(_offsets(counts, pa.int32()), pa.array(ids, pa.int32()))
                own = [batch.column(0).slice(low, high - low), lists]
                yield pa.RecordBatch.from_arrays([*own, _decoded(lists, encoder.vocab)] if back else own, names=["id", "token_ids", "decoded"][: 2 + back])

    return rows.mapInArrow(run, f"id {kind}, token_ids array<int>" + ", decoded binary" * back).withColumnRenamed("id", doc_id)


def _decoded(lists: pa.ListArray, vocab: Vocabulary) -> pa.Array:
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    data, sizes = decode(lists.flatten().to_numpy(zero_copy_only=False), counts, vocab)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, _offsets(sizes, pa.int32()).buffers()[1], pa.py_buffer(data)])


def decode_documents(encoded: DataFrame, path: str, pattern: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, token_ids, decoded): the bytes that the ids stand for; null ids count as none."""
    none = F.array().cast("array<int>")
    rows = encoded.select(F.col(doc_id).alias("id"), F.coalesce(F.col("token_ids"), none).alias("token_ids"))
    kind = rows.schema["id"].dataType.simpleString()
    lines = rows.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        vocab = vocabulary(lines.value, pattern)
        for batch in batches:
            lists = batch.column(1)
            step = max(1, (SLICE_CHARS // 2 * len(lists)) // max(1, len(lists.flatten())))
            for low in range(0, len(lists), step):
                part = lists.slice(low, step)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, step), part, _decoded(part, vocab)], names=["id", "token_ids", "decoded"])

    return rows.mapInArrow(run, f"id {kind}, token_ids array<int>, decoded binary").withColumnRenamed("id", doc_id)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What decode_documents makes of encode_documents, in one pass through Python."""
    return encode_documents(docs, path, pattern, doc_id, text, back=True)


def count_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(length), one row for each row of docs: how many ids its text has; null counts as empty."""
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    lines = rows.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        encoder = Encoder(vocabulary(lines.value, pattern))
        for batch in batches:
            for low, high in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(encoder.lengths(batch.column(0).slice(low, high - low).to_pylist()), pa.int64())], names=["length"])

    return rows.mapInArrow(run, "length long")
