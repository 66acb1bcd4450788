"""Exact top-k by inner product: ball trees over shards, branch and bound.

Vectors are dealt by position: each goes to the cell of the nearest of some centres, chosen far apart in a bounded
sample, and cells are cut into pieces of bounded size. Each piece's ball tree is built and written once. A query is asked first in the cell that
promises most; the kth score from there is shared with all other cells, and the query goes only to those whose
ball's upper bound (query times centre plus length of the query times radius) reaches it. In a piece, leaves are
visited in the order of that bound until it falls below the kth score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobmosaic.llm.shared import stored

#: Vectors in a shard and queries that share one copy of its tree, about.
SHARD_ROWS = 2048
BLOCK_ROWS = 1 << 16
LEAF_ROWS = 64
#: Cells of the space and rows of the sample that their centres come from, at most. Cells only direct the search; every row is indexed.
CELLS = 1024
SAMPLE_ROWS = 8 * CELLS
_LEAST = np.iinfo(np.int64).min


@dataclass
class Ball:
    """A node: the rows low:high of the tree's order, their centre and radius."""

    low: int
    high: int
    centre: np.ndarray
    radius: float
    children: tuple[Ball, Ball] | None = None

    def nodes(self) -> Iterator[Ball]:
        """The nodes, each before its children."""
        yield self
        for child in self.children or ():
            yield from child.nodes()


def build(points: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, Ball]:
    """The order of the rows and the root. A node is cut at the median along the line between two far points."""
    order = np.arange(len(points))

    def grow(low: int, high: int) -> Ball:
        own = points[order[low:high]]
        centre = own.mean(0)
        gaps = np.sqrt(((own - centre) ** 2).sum(1))
        ball = Ball(low, high, centre, float(gaps.max()))
        if high - low > leaf and ball.radius > 0:
            a = own[gaps.argmax()]
            b = own[((own - a) ** 2).sum(1).argmax()]
            rank = np.argsort(own @ (b - a), kind="stable")
            order[low:high] = order[low:high][rank]
            middle = (low + high) // 2
            ball.children = grow(low, middle), grow(middle, high)
        return ball

    return order, grow(0, len(points))


def upper_bound(queries: np.ndarray, length: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """No point of the ball has a greater inner product with the queries; room for rounding is left."""
    upper = queries @ centre + length * radius
    return upper + 1 + 1e-9 * (np.abs(upper) + length * (np.sqrt((centre**2).sum()) + radius))


def as_bound(score: np.ndarray) -> np.ndarray:
    """Scores to hold bounds against; the least score is none (products may lie beyond it)."""
    return np.where(score == _LEAST, -np.inf, score.astype(float))


def exact_products(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products, (queries, vectors); beyond 64 bits they stop at the ends of the range."""
    if not vectors.size or not queries.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    most = float(np.abs(vectors.astype(float)).max()) * float(np.abs(queries.astype(float)).max()) * vectors.shape[1]
    if most < 2.0**52:
        return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    if most < 2.0**62:
        return queries @ vectors.T
    whole = queries.astype(object) @ vectors.astype(object).T
    return np.array([[min(max(x, -(2**63)), 2**63 - 1) for x in row] for row in whole], np.int64)


def search(ids: np.ndarray, vectors: np.ndarray, root: Ball, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the k best of a tree for each query, those below its floor left out. ids and vectors are in the tree's order."""
    real = queries.astype(float)
    length = np.sqrt((real**2).sum(1))
    least = as_bound(floor)
    leaves: list[Ball] = []
    bounds: list[np.ndarray] = []
    stack = [(root, np.arange(len(queries)))]
    while stack:
        ball, asking = stack.pop()
        upper = upper_bound(real[asking], length[asking], ball.centre, ball.radius)
        asking, upper = asking[upper >= least[asking]], upper[upper >= least[asking]]
        if not len(asking):
            continue
        if ball.children:
            stack += [(ball.children[0], asking), (ball.children[1], asking)]
        else:
            leaves.append(ball)
            whole = np.full(len(queries), -np.inf)
            whole[asking] = upper
            bounds.append(whole)
    best_score = np.full((len(queries), k), _LEAST, np.int64)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
    filled = np.zeros((len(queries), k), bool)
    if leaves:
        upper = np.stack(bounds, 1)
        visit = np.argsort(-upper, axis=1, kind="stable")
        for step in range(len(leaves)):
            here = visit[:, step]
            bound = upper[np.arange(len(queries)), here]
            kth = np.where(filled[:, -1], np.maximum(best_score[:, -1], floor), floor)
            going = np.flatnonzero((bound >= as_bound(kth)) & (bound > -np.inf))
            if not len(going):
                break
            for number in np.unique(here[going]).tolist():
                rows, ball = going[here[going] == number], leaves[number]
                own = ids[ball.low : ball.high]
                scores = exact_products(vectors[ball.low : ball.high], queries[rows])
                fits = own[None, :] != query_ids[rows][:, None]
                score = np.concatenate([best_score[rows], np.where(fits, scores, _LEAST)], 1)
                name = np.concatenate([best_id[rows], np.broadcast_to(own, scores.shape)], 1)
                real_one = np.concatenate([filled[rows], fits], 1)
                rank = np.lexsort((name, -np.maximum(score, _LEAST + 1), ~real_one), axis=1)[:, :k]
                best_score[rows], best_id[rows], filled[rows] = (np.take_along_axis(x, rank, 1) for x in (score, name, real_one))
    keep = filled & (best_score >= floor[:, None])
    return np.nonzero(keep)[0], best_id[keep], best_score[keep]


def valid_vectors(table: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(id, v): each component x becomes floor(scale * x). Rows without an id, and vectors that are null or
    hold null or non-finite components, are left out."""
    x = F.col(embedding)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return table.filter(F.col(vec_id).isNotNull() & x.isNotNull() & fine).select(F.col(vec_id).cast("long").alias("id"), ints.alias("v"))


def far_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Points of the sample, so many at most: each next one is the farthest from those before."""
    chosen, gaps = [0], np.full(len(sample), np.inf)
    while len(chosen) < cells:
        gaps = np.minimum(gaps, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if not gaps.max() > 0:
            break
        chosen.append(int(gaps.argmax()))
    return sample[chosen]


def cells_of(points: np.ndarray, centres: np.ndarray, rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centre and its distance from it."""
    cell = np.zeros(len(points), np.int32)
    for low in range(0, len(points), rows):
        cell[low : low + rows] = ((centres**2).sum(1) - 2 * (points[low : low + rows] @ centres.T)).argmin(1)
    return cell, np.sqrt(((points - centres[cell]) ** 2).sum(1))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


#: Nodes come first in a tree's rows, then its points, then what is asked.
_NODE, _POINT, _QUERY = 0, 1, 2
_TREE = "dim int, cell int, piece int, kind int, at int, id long, v array<long>, centre array<double>, radius double, low int, high int, split boolean"


def tree_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """A piece's tree: one row a node, from the root on, and one a point, in the tree's order."""
    vectors = _stack(rows["v"])
    order, root = build(vectors.astype(float))
    balls = list(root.nodes())
    nodes = [(_NODE, at, 0, None, b.centre, b.radius, b.low, b.high, b.children is not None) for at, b in enumerate(balls)]
    points = [(_POINT, at, i, v, None, None, None, None, None) for at, (i, v) in enumerate(zip(rows["id"].to_numpy()[order].tolist(), vectors[order], strict=True))]
    both = pd.DataFrame(nodes + points, columns=["kind", "at", "id", "v", "centre", "radius", "low", "high", "split"], dtype=object)
    for place, column in enumerate(("dim", "cell", "piece")):
        both.insert(place, column, rows[column].iloc[0])
    return both


def read_tree(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, Ball]:
    """(ids, vectors, root) of rows that tree_rows has made."""
    nodes, points = rows[rows["kind"] == _NODE], rows[rows["kind"] == _POINT]
    each = zip(nodes["low"], nodes["high"], nodes["centre"], nodes["radius"], nodes["split"], strict=True)

    def grow() -> Ball:
        low, high, centre, radius, split = next(each)
        ball = Ball(int(low), int(high), np.asarray(centre, float), float(radius))
        if split:
            ball.children = grow(), grow()
        return ball

    return points["id"].to_numpy(), _stack(points["v"]), grow()


def top_k(table: DataFrame, query_every: int, k: int, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by query_every.

    Ties go to the smaller id. Rows with the query's own id aren't candidates; an id that occurs with several
    vectors is a candidate (and a query) once for each. Vectors of other dimension aren't compared. Other
    columns aren't looked at. An empty table gives no rows."""
    rows = stored(valid_vectors(table, vec_id, embedding, scale), "vectors")
    total = rows.count()
    salted = rows.select("id", "v", F.size("v").alias("dim"), F.xxhash64("id", F.monotonically_increasing_id()).alias("salt"))
    sample: dict[int, list] = {}
    few = salted.filter(F.pmod("salt", F.lit(max(1, total))) < 2 * SAMPLE_ROWS)  # about twice what is needed, so that not each partition sends a whole sample
    for row in few.orderBy("salt").limit(SAMPLE_ROWS).select("v").collect():
        sample.setdefault(len(row.v), []).append(row.v)
    wanted = min(CELLS, max(1, -(-total // shard_rows)))
    centres = {dim: far_centres(np.array(found, float).reshape(len(found), dim), wanted) for dim, found in sample.items()}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                cell, gap = cells_of(_stack(own["v"]).astype(float), centres[dim]) if dim in centres else (0, None)
                yield own.assign(cell=cell, gap=gap)[["id", "v", "dim", "salt", "cell", "gap"]]

    dealt = stored(salted.mapInPandas(deal, "id long, v array<long>, dim int, salt long, cell int, gap double"), "dealt-vectors")
    sizes = stored(dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")), "cell-sizes")
    sizes = sizes.withColumn("pieces", F.ceil(F.col("n") / shard_rows))
    # a cell's ball: the centre in the sample, the radius over all rows; no more balls than rows of the sample
    balls: dict[int, list[tuple[int, int, np.ndarray, float]]] = {}
    for row in sizes.filter("radius IS NOT NULL").orderBy("dim", "cell").collect():
        balls.setdefault(row.dim, []).append((row.cell, row.n, centres[row.dim][row.cell], row.radius))

    piece = F.pmod("salt", "pieces").cast("int")
    trees = dealt.join(sizes.drop("n", "radius"), ["dim", "cell"]).select("dim", "cell", piece.alias("piece"), "id", "v")
    trees = stored(trees.groupBy("dim", "cell", "piece").applyInPandas(tree_rows, _TREE), "ball-trees")
    queries = rows.filter(F.col("id") % query_every == 0).dropDuplicates(["id", "v"])
    queries = stored(queries.select(F.col("id").alias("q"), "v", F.xxhash64("v").alias("mark"), F.size("v").alias("dim")), "queries")
    ASKED = "q long, mark long, v array<long>, dim int, floor long, first_cell int, cell int"  # noqa: N806

    def promising(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cell to ask first: the greatest product with the centre, of those with more than k rows if there are any."""
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                cell = 0
                if dim in balls:
                    number, n, centre, _ = (np.array(x) for x in zip(*balls[dim], strict=True))
                    hope = _stack(own["v"]).astype(float) @ centre.T
                    cell = number[np.where((n > k) | (n.max() <= k), hope, -np.inf).argmax(1)]
                yield own.assign(floor=_LEAST, first_cell=cell, cell=cell)[["q", "mark", "v", "dim", "floor", "first_cell", "cell"]]

    def within_bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with each cell whose bound reaches its floor."""
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                real = _stack(own["v"]).astype(float)
                length, floor = np.sqrt((real**2).sum(1)), as_bound(own["floor"].to_numpy())
                for cell, _, centre, radius in balls.get(dim, [(0, 0, np.zeros(dim), np.inf)]):
                    reached = upper_bound(real, length, centre, radius) >= floor if dim in balls else np.ones(len(own), bool)
                    if reached.any():
                        yield own[reached].assign(cell=cell)[["q", "mark", "v", "dim", "floor", "first_cell", "cell"]]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by tree, its nodes first, then its points, then what it is asked."""
        here, held, tree = None, [], None
        for batch in batches:
            for key, own in batch.groupby(["dim", "cell", "piece", "block"], sort=False):
                if key != here:
                    here, held, tree = key, [], None
                asking = own[own["kind"] == _QUERY]
                if tree is None:
                    held.append(own[own["kind"] != _QUERY])
                if len(asking):
                    tree = tree or read_tree(pd.concat(held))
                    held = []
                    at, ids, scores = search(*tree, asking["id"].to_numpy(), _stack(asking["v"]), asking["floor"].to_numpy(), k)
                    yield pd.DataFrame({"q": asking["id"].to_numpy()[at], "mark": asking["mark"].to_numpy()[at], "id": ids, "score": scores})

    def answers(asked: DataFrame) -> DataFrame:
        """asked: queries with cell, piece and floor. Those of one piece share a copy of its tree, up to block_rows of them."""
        asked = asked.withColumn("block", F.pmod(F.xxhash64("q", "mark"), "blocks").cast("int"))
        copies = asked.select("dim", "cell", "piece", "block").distinct()
        # no null in a long column: pandas would make doubles of it
        copied = trees.join(copies, ["dim", "cell", "piece"]).withColumns({"mark": F.lit(0).cast("long"), "floor": F.lit(0).cast("long")})
        asked = asked.select("dim", "cell", "piece", "block", F.lit(_QUERY).alias("kind"), F.col("q").alias("id"), "mark", "v", "floor")
        rows = copied.unionByName(asked, allowMissingColumns=True)
        keys = ["dim", "cell", "piece", "block"]
        return rows.repartition(*keys).sortWithinPartitions(*keys, "kind", "at").mapInPandas(ask, "q long, mark long, id long, score long")

    def with_blocks(asked: DataFrame, name: str) -> DataFrame:
        """asked with pieces and blocks of its cells."""
        asked = stored(asked, name)
        blocks = asked.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
        return asked.join(sizes.drop("n", "radius").join(blocks, ["dim", "cell"]), ["dim", "cell"])

    one = F.pmod(F.xxhash64("q", "mark", F.lit("piece")), "pieces").cast("int")
    asked = with_blocks(queries.mapInPandas(promising, ASKED), "asked-first")
    first = stored(answers(asked.withColumn("piece", one)), "first-answers")
    kth = first.groupBy("q", "mark").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k).drop("n")
    rank = F.row_number().over(Window.partitionBy("q", "mark").orderBy(F.col("score").desc(), "id"))
    result = [F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score"]
    if sizes.groupBy("dim").agg(F.sum("pieces").alias("trees")).filter("trees > 1").isEmpty():
        return first.withColumn("rank", rank).select(*result)
    known = asked.select("q", "mark", "v", "dim", "first_cell").join(kth, ["q", "mark"], "left").withColumn("floor", F.coalesce("kth", F.lit(_LEAST))).drop("kth")
    others = with_blocks(known.mapInPandas(within_bounds, ASKED), "asked-others")
    rest = F.filter(F.sequence(F.lit(0), F.col("pieces").cast("int") - 1), lambda p: (F.col("cell") != F.col("first_cell")) | (p != one))
    both = first.unionByName(answers(others.withColumn("piece", F.explode(rest))))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select(*result)
