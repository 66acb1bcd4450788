"""SimHash near-dedup: fingerprints, linked within a Hamming radius by BK-trees over shards.

A shard holds the distinct fingerprints that agree on some blocks of bits: with radius r and r + 2 blocks, any
two fingerprints within r bits agree on two blocks at least, so each link lies in a shard. A shard that is
still large is dealt out again by pairs of blocks of the other bits. Each shard gets a BK-tree in the task
that owns it and answers its own members; it is sent there by the shuffle, as trees for all tasks would grow
with the data. A tree tells which of its fingerprints hang together with one link less than there are members,
so the links never number more than the fingerprints in the shards.

For a similarity of texts, fingerprints are 512 bits of the distinct shingles, and the radius is what that similarity
leads to and three standard deviations. Texts that share four fifths of their shingles differ in about 77 of these
bits, so that no block of them is both equal and rare enough for a shard; shards hold the texts with the same least
shingle hashes in a band instead. What a tree finds within the radius is a candidate: it becomes a link only if the
shingle sets themselves are that similar. First every member is compared with its nearest candidate, which joins most
of what belongs together. Then the shards that still hold several components get the shingle sets of their members, and
the task that owns the tree compares all candidates of different components, each pair in the first shard it shares, and
joins components as it goes. So no pair is given up, and links never number more than members.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmosaic.llm.shared import connected_components, discard, fresh, join_classes, stored, text_or_empty

SEED = 42
#: Shingles whose bits are counted at once.
SLICE = 1 << 15
#: A shard with more members is dealt out again, or cut into blocks.
SHARD = 2048
#: 64-bit words of a wide fingerprint.
LANES = 8
#: Bands of least hashes of a text, and how many are in each: at a similarity of 0.8, 6 in 10,000 pairs share no band.
BANDS, BAND_ROWS = 14, 4
#: Rows of bits that are summed in single bytes.
BYTE_SUMS = 255
#: A text that more candidates name is compared in several tasks.
HOT_PARTNER = 512
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_hashes(text: str | None, words: int) -> tuple[Iterator[int], int]:
    """XXH64 of each shingle, and how many there are; a text of fewer words is one shingle, one without words none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(parts) > words:
        shingles: Iterator[bytes] = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
        total = len(parts) - words + 1
    else:
        shingles, total = iter([b" ".join(parts)]), min(1, len(parts))
    return map(xxhash.xxh64_intdigest, shingles, (SEED for _ in range(total))), total


def fingerprint(text: str | None, words: int) -> int:
    """As a signed 64-bit number. Null is the empty text, whose fingerprint is zero."""
    hashed, total = shingle_hashes(text, words)
    ones = np.zeros(64, np.int64)
    for low in range(0, total, SLICE):
        block = np.fromiter(hashed, "<u8", min(SLICE, total - low))
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def distinct_shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of the shingles, each once, sorted."""
    hashed, total = shingle_hashes(text, words)
    return np.unique(np.fromiter(hashed, np.uint64, total))


def wide_fingerprint(distinct: np.ndarray, lanes: int = LANES) -> bytes:
    """64 bits a lane; each lane mixes the shingles' hashes in its own way."""
    ones = np.zeros(64 * lanes, np.int64)
    own = np.arange(1, lanes + 1, dtype=np.uint64) * _MIX[0]
    for low in range(0, len(distinct), BYTE_SUMS):
        mixed = distinct[low : low + BYTE_SUMS, None] + own
        mixed = (mixed ^ mixed >> np.uint64(30)) * _MIX[1]
        mixed = (mixed ^ mixed >> np.uint64(27)) * _MIX[2]
        mixed ^= mixed >> np.uint64(31)
        ones += np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(distinct)).tobytes()


def band_keys(distinct: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """A number for each band: a hash of the least values of the shingles' hashes under some mixing functions."""
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    own = np.arange(1, bands * rows + 1, dtype=np.uint64) * _MIX[0]
    for low in range(0, len(distinct), SLICE // 32):
        mixed = (distinct[low : low + SLICE // 32, None] + own) * _MIX[1]
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * _MIX[2]).min(0))
    raw = least.astype("<u8").tobytes()
    size = 8 * rows
    return np.array([xxhash.xxh3_64_intdigest(raw[size * i : size * (i + 1)], i) for i in range(bands)], np.uint64).view(np.int64)


def wide_radius(similarity: float, bits: int = 64 * LANES) -> int:
    """Bits in which texts whose shingles have that Jaccard similarity differ, and three standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + 3 * math.sqrt(bits * share * (1 - share)))


def fingerprints(docs: DataFrame, mark: Callable, kind: pa.DataType, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) for each row; the words are split at ASCII white space and only A-Z become lower case."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    id_kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            marks = [mark(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, kind)], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {id_kind}, fp {'long' if kind == pa.int64() else 'binary'}")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ; the last axis holds the words of a fingerprint."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


@dataclass
class Tree:
    """A BK-tree over rows of marks (distinct fingerprints, unsigned words): order holds the rows node by node, each
    followed by all below it; last is where that ends, edges are (distance, place in order) of the children."""

    marks: np.ndarray
    order: np.ndarray
    last: list[int]
    edges: list[list[tuple[int, int]]]


def build_tree(marks: np.ndarray) -> Tree:
    """From the root down: the members of a node but its first are its children's, dealt by their distance to the first."""
    order = np.arange(len(marks))
    last, edges = [0] * len(marks), [[] for _ in range(len(marks))]
    stack = [(0, len(marks))] if len(marks) else []
    while stack:
        low, high = stack.pop()
        last[low] = high
        if high - low == 1:
            continue
        below = order[low + 1 : high]
        far = distance(marks[below], marks[order[low]])
        rank = np.argsort(far, kind="stable")
        order[low + 1 : high] = below[rank]
        cuts = [0, *(np.flatnonzero(np.diff(far[rank])) + 1).tolist(), high - low - 1]
        for a, b in zip(cuts, cuts[1:], strict=False):
            edges[low].append((int(far[rank[a]]), low + 1 + a))
            stack.append((low + 1 + a, low + 1 + b))
    return Tree(marks, order, last, edges)


def ask(tree: Tree, component: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows, distances): for each node, the members of other components within the radius of it.

    All members ask at once; those at distance d from a node follow only the edges from d - radius to d + radius.
    Where all below a node are of one component, those of that component don't ask any more. component may change
    in between."""
    stack = [(0, np.arange(len(tree.order)))] if len(tree.order) else []
    while stack:
        at, asking = stack.pop()
        own = component[tree.order[at : tree.last[at]]]
        if (own == own[0]).all():
            asking = asking[component[asking] != own[0]]
            if not len(asking):
                continue
        node = int(tree.order[at])
        far = distance(tree.marks[asking], tree.marks[node])
        near = (far <= radius) & (component[asking] != component[node])
        if near.any():
            yield node, asking[near], far[near]
        for edge, child in tree.edges[at]:
            follow = asking[(far >= edge - radius) & (far <= edge + radius)]
            if len(follow):
                stack.append((child, follow))


def tree_links(marks: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of rows of marks that span the components of "within radius"."""
    links = []
    component = np.arange(len(marks))
    for node, near, _ in ask(build_tree(marks), component, radius):
        found, first = np.unique(component[near], return_index=True)
        links += [(node, int(x)) for x in near[first]]
        merged = np.append(found, component[node])
        component[np.isin(component, merged)] = merged.min()
    return links


def nearest(marks: np.ndarray, sizes: np.ndarray, component: np.ndarray, radius: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(asking row, row): the nearest row of another component within the radius, for each row that has one.

    Sets whose sizes differ by more than the share can't be that similar; they are left out."""
    best, to = np.full(len(marks), np.iinfo(np.int64).max), np.full(len(marks), -1)
    for node, near, far in ask(build_tree(marks), component, radius):
        closer = _sizes_fit(sizes[near], sizes[node], share) & (far < best[near])
        best[near[closer]], to[near[closer]] = far[closer], node
    who = np.flatnonzero(to >= 0)
    return who, to[who]


def _sizes_fit(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    return np.minimum(a, b) >= share * np.maximum(a, b)


def as_similar(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sets (sorted numbers of 64 bits) have that Jaccard similarity."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def as_similar_to(one: bytes, others: list[bytes], similarity: float) -> np.ndarray:
    """Whether each of the others (sorted numbers of 64 bits, one at least) has that Jaccard similarity with one: all are met at once."""
    own, flat = np.frombuffer(one, "<u8"), np.frombuffer(b"".join(others), "<u8")
    sizes = np.fromiter(map(len, others), np.int64, len(others)) // 8
    hits = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    both = np.add.reduceat(hits, np.cumsum(sizes) - sizes)
    return both >= similarity * (len(own) + sizes - both) - 1e-9


def checked_links(marks: np.ndarray, sizes: np.ndarray, root: np.ndarray, keys: np.ndarray, band: int, both: np.ndarray, sets: np.ndarray, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of rows that span what hangs together, over the given components, by candidates whose sets are similar; a
    pair that shares an earlier band is left to that band's shard. both: how many members of a set stand in other components; no two
    sets of different ones share more than the lesser of those numbers, so most pairs of one template needn't be met."""
    links = []
    component = np.unique(root, return_inverse=True)[1]
    for node, near, far in ask(build_tree(marks), component, radius):
        most = np.minimum(both[near], both[node])
        mine = (most >= similarity * (sizes[near] + sizes[node] - most) - 1e-9) & ~(keys[near, :band] == keys[node, :band]).any(1)
        open_ = near[mine][np.argsort(far[mine], kind="stable")]
        step = 1
        while len(open_):  # few at first: a link often settles many others
            for x in open_[:step][as_similar_to(sets[node], sets[open_[:step]].tolist(), similarity)].tolist():
                if component[x] != component[node]:
                    links.append((node, x))
                    component[component == component[x]] = component[node]
            open_ = open_[step:]
            open_, step = open_[component[open_] != component[node]], min(64, 2 * step)
    return links


def by_shard(owned: DataFrame, names: list[str], solve: Callable, out: str) -> DataFrame:
    """solve's columns for each shard; owned lies and is sorted by key and part. solve: arrays of names (fp: words) to a list of columns."""
    kinds = {"long": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in out.split(", ")]

    def found(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    def read(batch: pa.RecordBatch, name: str) -> np.ndarray:
        column = batch.column(name)
        if name == "hashes":
            return np.array([*column.to_pylist(), None], object)[:-1]
        if name == "keys":
            return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        if pa.types.is_binary(column.type):
            return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)
        values = column.to_numpy(zero_copy_only=False)
        return values.view(np.uint64)[:, None] if name == "fp" else values

    def run(batches):
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            parts.append([read(batch, n) for n in ("key", "part", *names)])
            last, first = parts[-1], parts[0]
            if len(parts) > 1 and last[0][-1] == first[0][-1] and last[1][-1] == first[1][-1]:
                continue  # all of it belongs to the shard that is being read
            whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
            starts = [0, *(np.flatnonzero((whole[0][1:] != whole[0][:-1]) | (whole[1][1:] != whole[1][:-1])) + 1).tolist()]
            done = [solve(*[x[low:high] for x in whole[2:]]) for low, high in zip(starts, starts[1:], strict=False) if high - low > 1]
            if done:
                yield found([np.concatenate(x) for x in zip(*done, strict=True)])
            parts = [[x[starts[-1] :] for x in whole]]  # the last shard may go on in the next batch
        if parts and sum(len(x[0]) for x in parts) > 1:
            yield found(solve(*[np.concatenate(x) for x in list(zip(*parts, strict=True))[2:]]))

    return owned.mapInArrow(run, out)


def solve_shards(owned: DataFrame, radius: int) -> DataFrame:
    """(a, b): links of each shard; owned (key, part, node, fp) lies and is sorted by key and part."""

    def solve(node: np.ndarray, marks: np.ndarray) -> list[np.ndarray]:
        at = np.array(tree_links(marks, radius), np.int64).reshape(-1, 2)
        return [node[at[:, 0]], node[at[:, 1]]]

    return by_shard(owned, ["node", "fp"], solve, "a long, b long")


def _bits(name: str, low: int, width: int):
    return F.shiftrightunsigned(name, low).bitwiseAND(F.lit((1 << width) - 1))


def _pairs(name: str, spans: list[tuple[int, int]]):
    """An array of longs: for each pair of bit spans, the pair's number and the bits of both."""
    keys = []
    for number, (x, y) in enumerate(combinations(spans, 2)):
        both = F.shiftleft(_bits(name, *x), y[1]).bitwiseOR(_bits(name, *y))
        keys.append(F.lit(number << 48).bitwiseOR(both))
    return F.array(*keys)


def _spans(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    cuts = [low + (high - low) * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def links_within(distinct: DataFrame, radius: int, shard: int = SHARD) -> DataFrame:
    """(a, b): links that span all components of the fingerprints (column fp, distinct) within the radius."""
    if not 1 <= radius <= 3:
        raise ValueError("radius must be 1, 2 or 3")
    blocks = _spans(0, 64, radius + 2)
    keyed = distinct.select("fp", F.explode(_pairs("fp", blocks)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("key", "of")
    members = keyed.join(shared, F.col("key") == F.col("of")).select("fp", "key", "n")
    # in a large shard, the bits outside its two blocks are cut into radius + 2 spans of their own
    finer = F.lit(None).cast("array<long>")
    for number, pair in enumerate(combinations(range(radius + 2), 2)):
        rest = [s for i, s in enumerate(blocks) if i not in pair]
        pieces = [x for low, width in rest for x in _spans(low, low + width, 4)]
        groups = [pieces[i :: radius + 2] for i in range(radius + 2)]
        keys = []
        for k, (x, y) in enumerate(combinations(groups, 2)):
            keys.append(F.xxhash64(F.lit(k), *[_bits("fp", *s) for s in x + y]))
        finer = F.when(F.shiftrightunsigned("key", 48) == number, F.array(*keys)).otherwise(finer)
    dealt = members.select("fp", "key", F.explode(F.when(F.col("n") <= shard, F.array(F.lit(0).cast("long"))).otherwise(finer)).alias("part"))
    owned = dealt.select("key", "part", F.col("fp").alias("node"), "fp").repartition("key", "part").sortWithinPartitions("key", "part", "fp")
    return solve_shards(owned, radius)


def _blocks(rows, shard: int):
    """How many blocks of half a shard so many rows fill."""
    return F.ceil(2 * rows / F.lit(shard)).cast("long")


def _part(i, j):
    return F.shiftleft(i, 31).bitwiseOR(j)


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(node, hashes): the distinct shingles of the texts of wanted (node, id, mark, kind), as bytes of sorted numbers."""
    texts = docs.select(F.col(doc_id).alias("own"), F.xxhash64(text_or_empty(text)).alias("own_mark"), F.col(text).cast("string").alias("text"))
    found = wanted.join(texts, (F.col("mark") == F.col("own_mark")) & F.col("id").eqNullSafe(F.col("own"))).select("node", "kind", "text")

    def run(batches):
        for batch in batches:
            sets = [distinct_shingles(t.as_py(), words) for t in batch.column("text")]
            right = [_kind(s) == k.as_py() for s, k in zip(sets, batch.column("kind"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(pa.array(right, pa.bool_())), pa.array([s.astype("<u8").tobytes() for s, r in zip(sets, right, strict=True) if r], pa.binary())], names=["node", "hashes"])

    return found.mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"])


def _kind(distinct: np.ndarray) -> bytes:
    """What tells a set of shingles from all others."""
    return xxhash.xxh3_128_digest(distinct.astype("<u8").tobytes())


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose sets have that Jaccard similarity. A set that many pairs ask for goes to several tasks."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    asked = pairs.select(F.explode(F.array("a", "b")).alias("of")).groupBy("of").agg(F.count(F.lit(1)).alias("n"))
    asked = stored(asked.select("of", F.ceil(F.col("n") / HOT_PARTNER).alias("copies")), "simhash-asked")
    hot = asked.filter("copies > 1")
    total = asked.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    dealt = sets.join(asked, F.col("node") == F.col("of")).select("node", "hashes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    for name in ("a", "b"):
        counted = join_classes(pairs, hot.withColumnRenamed("of", name).withColumnRenamed("copies", "of_copies"), [name], "of_copies", total, F.struct("a", "b"))
        salted = counted.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("of_copies")), F.lit(0).cast("long"))).drop("of_copies")
        own = dealt.select(F.col("node").alias(f"at_{name}"), F.col("hashes").alias(f"set_{name}"), F.col("copy").alias(f"copy_{name}"))
        pairs = salted.join(own, (F.col(name) == F.col(f"at_{name}")) & (F.col("salt") == F.col(f"copy_{name}"))).drop("salt", f"at_{name}", f"copy_{name}")

    def run(batches):
        for batch in batches:
            keep = pa.array([as_similar(a.as_py(), b.as_py(), similarity) for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def able_nodes(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(able, both): nodes of open_ (node, root, size; once each), and how many shingles of each stand in other components too.

    What two sets of different components share is among those, so a node with less than the similarity's share of them is like no
    other and is left out."""
    rows = open_.join(sets.withColumnRenamed("node", "at"), F.col("node") == F.col("at")).select("node", "root", "size", "hashes")

    def run(batches):
        for batch in batches:
            if len(batch):
                many = np.array([len(h) // 8 for h in batch.column("hashes").to_pylist()])
                flat = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(c).to_numpy(), many)) for c in ("node", "root", "size")] + [pa.array(flat)], names=["node", "root", "size", "hash"])

    each = rows.mapInArrow(run, "node long, root long, size long, hash long")
    across = each.groupBy("hash").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high").select("hash", "n")
    across = stored(across, "simhash-across")
    total = across.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = join_classes(each, across, ["hash"], "n", total, F.col("node")).filter("n is not null")
    return shared.groupBy("node", "size").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= F.lit(similarity) * F.col("size") - 1e-9).select(F.col("node").alias("able"), "both")


def _parts_across(members: DataFrame, shard: int) -> DataFrame:
    """Overfull shards whose members don't all hang together: those outside the largest component meet each other and that
    component, block by block."""
    zero = F.lit(0).cast("long")
    sizes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"))
    sizes = sizes.filter(F.col("n") > F.col("most.n"))
    sizes = stored(sizes.select(F.col("key").alias("of"), F.col("most.root").alias("largest"), _blocks(F.col("most.n"), shard).alias("inner"), _blocks(F.col("n") - F.col("most.n"), shard).alias("outer")), "simhash-sizes")
    open_ = members.join(sizes, F.col("key") == F.col("of"))
    block = lambda blocks: F.pmod(F.xxhash64("node"), blocks)
    upto = lambda blocks, part: F.transform(F.sequence(zero, F.col(blocks) - 1), part)
    own = block(F.col("outer"))
    outside = F.concat(upto("outer", lambda j: _part(F.least(own, j), F.greatest(own, j))), upto("inner", lambda j: _part(own, F.col("outer") + j)))
    inside = upto("outer", lambda i: _part(i, F.col("outer") + block(F.col("inner"))))
    return open_.select("key", F.explode(F.when(F.col("root") == F.col("largest"), inside).otherwise(outside)).alias("part"), *[c for c in members.columns if c not in ("key", "n")])


def similar_links(classes: DataFrame, docs: DataFrame, words: int, similarity: float, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """(node, root) of what hangs together by pairs that share a band and have the similarity.

    classes: node, fp, keys, size, kind, and id and mark of a document; one row for each set of shingles."""
    radius = wide_radius(similarity)
    rows = classes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("key", "of")
    members = rows.join(shared, F.col("key") == F.col("of")).select("node", "band", "key", "n")
    slim = classes.select(F.col("node").alias("at"), "fp", "size", "keys", "id", "mark", "kind")
    members = stored(members.join(slim, F.col("node") == F.col("at")).drop("at"), "simhash-members")
    sets = stored(shingle_sets(docs, members.select("node", "id", "mark", "kind").distinct(), words, doc_id, text), "simhash-sets")
    members = members.drop("id", "mark", "kind")
    block = F.when(F.col("n") > shard, F.pmod(F.xxhash64("node"), _blocks(F.col("n"), shard))).otherwise(F.lit(0).cast("long"))

    def owned(open_: DataFrame, *names: str) -> DataFrame:
        return open_.select("key", "part", *names).repartition("key", "part").sortWithinPartitions("key", "part", "node")

    def close(node: np.ndarray, marks: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        who, to = nearest(marks, sizes, np.arange(len(node)), radius, similarity)
        return [node[who], node[to]]

    def check(node: np.ndarray, band: np.ndarray, marks: np.ndarray, sizes: np.ndarray, keys: np.ndarray, root: np.ndarray, both: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
        at = np.array(checked_links(marks, sizes, root, keys, int(band[0]), both, hashes, radius, similarity), np.int64).reshape(-1, 2)
        return [node[at[:, 0]], node[at[:, 1]]]

    names = ["node", "fp", "size"]
    pairs = stored(by_shard(owned(members.withColumn("part", block), *names), names, close, "a long, b long"), "simhash-candidates")
    links = stored(similar_pairs(pairs, sets, similarity), "simhash-links")
    discard(pairs)
    for across in (False, True):  # the blocks of overfull shards alone, then what they still hold with each other
        roots = connected_components(links).withColumnRenamed("node", "rooted")
        rooted = members.filter(F.col("n") > shard) if across else members
        rooted = rooted.join(roots, F.col("node") == F.col("rooted"), "left").withColumn("root", F.coalesce("root", "node")).drop("rooted")
        rooted = stored(rooted, "simhash-rooted")
        apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select(F.col("key").alias("of"))
        open_ = rooted.join(apart, F.col("key") == F.col("of")).drop("of")
        able = stored(able_nodes(open_.select("node", "root", "size").distinct(), sets, similarity), "simhash-able")
        open_ = open_.join(able, F.col("node") == F.col("able")).drop("able")
        # a partner brings the shingles that only its component has into the union of the two: as many as the least of the key, at least
        own = open_.groupBy("key").agg(F.min(F.col("size") - F.col("both")).alias("own")).withColumnRenamed("key", "of")
        open_ = open_.join(own, F.col("key") == F.col("of")).filter(F.col("both") >= F.lit(similarity) * (F.col("size") + F.col("own")) - 1e-9).drop("of", "own")
        open_ = _parts_across(stored(open_, "simhash-open"), shard) if across else open_.withColumn("part", block)
        names = ["node", "band", "fp", "size", "keys", "root", "both", "hashes"]
        with_sets = open_.join(sets.withColumnRenamed("node", "at"), F.col("node") == F.col("at"))
        more = stored(by_shard(owned(with_sets, *names), names, check, "a long, b long"), "simhash-links")
        links = links.union(more)
    return connected_components(links)


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs; component_id is the least id reachable.

    Documents with one fingerprint are one class, and links join classes, so copies cost nothing. A null or
    empty text has fingerprint zero, which links like any other. A text of fewer words is one shingle. Ids that
    are null count only where a component has no other. Rows repeated are rows of one class. Other columns
    aren't looked at. An empty table gives no rows."""
    marks = stored(fingerprints(docs, lambda x: fingerprint(x, words), pa.int64(), doc_id, text), "simhash-marks")
    classes = stored(marks.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")), "simhash-classes")
    roots = connected_components(links_within(classes.select("fp"), radius, shard))
    found = _components(marks, classes.withColumn("node", F.col("fp")), roots)
    return found.select(F.col("id").alias(doc_id), "fp", "component_id")


def wide_marks(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, kind, fp, size, keys) for each row: hash of the text, what tells its set of shingles, the wide fingerprint, how many shingles, bands."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text_or_empty(text)).alias("mark"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            sets = [distinct_shingles(t.as_py(), words) for t in batch.column("text")]
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            columns = [pa.array([_kind(s) for s in sets], pa.binary()), pa.array([wide_fingerprint(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), keys]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), *columns], names=["id", "mark", "kind", "fp", "size", "keys"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, mark long, kind binary, fp binary, size long, keys array<long>")


def similar_roots(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(id, mark, fp) for each row of docs, fp telling its set of shingles, and (fp, least, size, root) for each such set: its least id,
    its rows, and a number that all sets of a component have."""
    marks = stored(wide_marks(docs, words, doc_id, text), "simhash-marks")
    classes = marks.groupBy("kind").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("members"), F.min(F.struct("id", "mark")).alias("one"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    classes = stored(classes.select("*", "one.id", "one.mark", F.monotonically_increasing_id().alias("node")).drop("one"), "simhash-classes")
    roots = similar_links(classes, docs, words, similarity, doc_id, text, shard)
    return marks.select("id", "mark", F.col("kind").alias("fp")), _rooted(classes.select(F.col("kind").alias("fp"), "least", F.col("members").alias("size"), "node"), roots)


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs: what hangs together by links of that Jaccard similarity of the distinct shingles.

    Each link was checked on the sets of shingles; a pair that shares no band of least hashes, or is beyond the
    radius, is no link of its own. Texts with the same set of shingles are one class; texts without any are too.
    Nulls, repeated rows and other columns: as in simhash_components."""
    marks, linked = similar_roots(docs, words, similarity, doc_id, text, shard)
    return _named(marks, linked).select(F.col("id").alias(doc_id), "fp", "component_id")


def _rooted(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, least, size, root) of classes (fp, least, size, node); roots: (node, root) of the nodes with links."""
    rooted = classes.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node"))
    return stored(rooted.select("fp", "least", "size", "root"), "simhash-roots")


def _named(marks: DataFrame, linked: DataFrame) -> DataFrame:
    """marks (id, fp) with component_id."""
    least = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "of")
    named = linked.join(least, F.col("root") == F.col("of")).select("fp", "size", "component_id")
    total = linked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return join_classes(marks, stored(named, "simhash-named"), ["fp"], "size", total, F.col("id"))


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component of similar texts, with all its columns: the one with the least id, null ids last, and of one
    id the text with the least hash. Rows that have both in common are one document and all stay. All else stays.

    What goes is written first, as ids and hashes of texts; texts move only if those are too many for Spark to broadcast."""
    marks, linked = similar_roots(docs, words, similarity, doc_id, text)
    total = linked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    rows = stored(join_classes(marks, linked.select("fp", "size", "root"), ["fp"], "size", total, F.col("id")).select("id", "mark", "root"), "near-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("untold"), F.col("id"), F.col("mark"))).alias("first")
    keepers = rows.groupBy("root").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "n", F.col("first.id").alias("keep"), F.col("first.mark").alias("keep_mark"))
    met = join_classes(rows, stored(keepers, "near-keepers"), ["root"], "n", total, F.col("mark")).filter("n is not null")
    own, mark = fresh("id"), fresh("mark")
    gone = met.filter(~(F.col("id").eqNullSafe(F.col("keep")) & (F.col("mark") == F.col("keep_mark")))).select(F.col("id").alias(own), F.col("mark").alias(mark)).distinct()
    return docs.join(stored(gone, "near-gone"), F.col(f"`{doc_id}`").eqNullSafe(F.col(own)) & (F.xxhash64(text_or_empty(text)) == F.col(mark)), "left_anti")


def _components(marks: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """marks (id, fp) with component_id; classes: fp, least, size, node; roots: (node, root) of the nodes with links."""
    return _named(marks, _rooted(classes, roots))
