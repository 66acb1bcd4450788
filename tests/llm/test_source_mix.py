import random

import pytest

from jobmosaic.llm import source_mix
from jobmosaic.llm.source_mix import apply_mix, mix_documents

SCHEMA = "doc_id long, text string, source string, size string, target int, place string"


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        left = budget - sum(cap * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and left * weight[s] / open_ >= cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else left * weight[s] / open_ for s in names}
        full |= more


def rows_of(rng, n=600):
    sources = ["a", "b", "é", "Z", None, "hot", "none"]
    out = []
    for i in range(n):
        s = "hot" if rng.random() < 0.4 else rng.choice(sources)
        text = "" if s == "none" else " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, 400])))
        out.append((i, text, s, "x", 1, None))
    return out


@pytest.mark.parametrize("bits,fine,few", [(10, 1024, 100000), (3, 4, 100000), (2, 1, 0)])
def test_targets_and_thresholds(spark, monkeypatch, bits, fine, few):
    monkeypatch.setattr(source_mix, "LEVEL_BITS", bits)
    monkeypatch.setattr(source_mix, "FINE", fine)
    monkeypatch.setattr(source_mix, "BROADCAST_SOURCES", few)
    rows = rows_of(random.Random(4))
    got = mix_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[2] for r in rows}
    sizes, taken, largest = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r["size"])
        assert r.taken in (0, r["size"], 2 * r["size"])
    want = brute_targets(sizes)
    for r in got:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_no_document_more_than_twice(spark):
    """A source at its cap is taken twice as a whole; documents without words have no place of their own in that."""
    rows = [(i, "", "full", "x", 1, None) for i in range(200)] + [(1000 + i, "w w w", "full", "x", 1, None) for i in range(3)] + [(2000 + i, "w " * 90, "rich", "x", 1, None) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = {r.doc_id: r["count"] for r in apply_mix(df).groupBy("doc_id").count().collect()}
    assert max(taken.values()) == 2 and all(taken[1000 + i] == 2 for i in range(3))


def test_edges(spark):
    assert mix_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, None, None, None), (None, "a b", None, "x", 1, "y"), (3, "a\x0bb c", "s", "x", 1, "y"), (3, "a b c", "s", "x", 1, "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix_documents(df)
    assert got.count() == 4 and sorted(r["size"] for r in got.collect()) == [0, 2, 3, 3]
    mixed = apply_mix(df)
    assert mixed.columns == df.columns
    assert mixed.filter("doc_id = 3").count() % 2 == 0  # rows of one id go together
    empty = spark.createDataFrame([(1, None, "s", None, None, None)], SCHEMA)
    assert [tuple(r) for r in mix_documents(empty).collect()] == [(1, 0, 0, 0.0, 0)]
