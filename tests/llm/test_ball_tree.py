import math
import random

import numpy as np

from jobmosaic.llm import ball_tree
from jobmosaic.llm.ball_tree import build, exact_products, search, top_k

SCHEMA = "vec_id long, embedding array<float>, id string, v int, shard string"


def brute(rows, every, k):
    fine = []
    for r in rows:
        if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]):
            fine.append((r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]]))
    out = set()
    for q, a in fine:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q and len(a) == len(b))
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)}
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)], "x", 1, None) for i in range(400)]
    rows += [(1000 + i, [0.5, -0.25, 0.5, 0.1, 0.0, 0.3], "x", 1, None) for i in range(150)]
    rows += [(2000, None, "x", 1, None), (2050, [None] * 6, "x", 1, None), (2100, [float("nan")] * 6, None, 1, None), (2150, [float("inf")] * 6, "x", 1, None)]
    rows += [(None, [1.0] * 6, "x", None, None), (3000, [1.0, 2.0], "x", 1, None), (3001, [1.0, -2.0], "x", 1, None), (3050, [], "x", 1, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 50, 5)
    for shard, block in ((10_000, 10_000), (60, 4), (100, 1000)):
        assert sorted(map(tuple, top_k(df, 50, 5, shard_rows=shard, block_rows=block).collect())) == want


def test_clustered_vectors_and_dimensions_out_of_the_sample(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(2000):
        at = [0.0] * 8
        at[i % 8] = 3.0
        rows.append((i + 50 * 2**55 * (i % 3), [x + rng.gauss(0, 0.05) for x in at], "x", 1, None))
    rows += [(5000 + i, [rng.gauss(0, 1) for _ in range(3 + i % 4)], "x", 1, None) for i in range(0, 400, 5)]
    asked = {}

    def counted(df, name, *by):
        table = real(df, name, *by)
        asked[name] = table.count()
        return table

    real = ball_tree.stored
    monkeypatch.setattr(ball_tree, "stored", counted)
    monkeypatch.setattr(ball_tree, "SAMPLE_ROWS", 60)
    got = sorted(map(tuple, top_k(spark.createDataFrame(rows, SCHEMA), 50, 5, shard_rows=50).collect()))
    assert got == brute(rows, 50, 5)
    assert asked["asked-others"] < asked["queries"] * asked["cell-sizes"] / 3


def test_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, top_k(df, 50, 5, shard_rows=90).collect())) == brute(rows, 50, 5)


def test_few_rows_and_none(spark):
    assert top_k(spark.createDataFrame([], SCHEMA), 50, 5).count() == 0
    rows = [(0, [1.0], "x", 1, None), (0, [1.0], "x", 1, None), (1, [2.0], "x", 1, None)]
    assert [tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA), 50, 5).collect()] == [(0, 1, 1, 256 * 512)]


def test_tree_and_bounds():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(500, 5))
    order, root = build(points, 16)
    assert sorted(order) == list(range(500))
    stack = [root]
    while stack:
        ball = stack.pop()
        own = points[order[ball.low : ball.high]]
        assert (np.sqrt(((own - ball.centre) ** 2).sum(1)) <= ball.radius + 1e-9).all()
        stack += ball.children or ()
    big = np.array([[2**40, 1], [-(2**40), 3]])
    assert exact_products(big, big).tolist() == [[2**63 - 1, -(2**63)], [-(2**63), 2**63 - 1]]
    middle = np.array([[2**28, 1], [5, 3]])
    assert exact_products(middle, middle).tolist() == [[2**56 + 1, 5 * 2**28 + 3], [5 * 2**28 + 3, 34]]
    vectors = rng.integers(-50, 50, (300, 4))
    ids = np.arange(300)
    order, root = build(vectors.astype(float), 16)
    at, found, score = search(ids[order], vectors[order], root, np.array([-1]), vectors[:1], np.array([0]), 7)
    all_scores = vectors @ vectors[0]
    want = sorted((-s, i) for i, s in enumerate(all_scores.tolist()))[:7]
    assert sorted(zip((-score).tolist(), found.tolist(), strict=True)) == [w for w in want if -w[0] >= 0]
