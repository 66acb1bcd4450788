import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from jobmosaic.llm import suffix_array
from jobmosaic.llm.queries import op11_suffix_array_dedup
from jobmosaic.llm.suffix_array import COVER, Block, cut_repeated_bytes, difference_cover, repeats_in, runs_in

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    """(spans, kept) of each text by counting all strings of length bytes."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    told = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        edges = [i for i in range(len(r) + 1) if (gone[i] if i < len(r) else 0) != (gone[i - 1] if i else 0)]
        told.append((list(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return told


def check(spark, rows, length, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in cut_repeated_bytes(df, length, **more).collect())
    want = Counter((i, len((t or "").encode()), tuple(s), k) for (i, t), (s, k) in zip(rows, brute([t for _, t in rows], length), strict=True))
    assert got == want


def test_difference_cover_has_a_place_for_any_two():
    picked, shift = difference_cover(COVER)
    assert len(picked) <= 10
    for i in range(COVER):
        for j in range(COVER):
            assert (i + shift[i, j]) % COVER in picked and (j + shift[i, j]) % COVER in picked and shift[i, j] < COVER


def test_block_sorts_suffixes():
    rng = random.Random(5)
    regions = [bytes(rng.choice(b"ab") for _ in range(rng.randint(80, 300))) for _ in range(20)] + [b"a" * 300, b"ab" * 150, b"a" * 290]
    block = Block(regions)
    place = np.concatenate([f + np.arange(len(r) - 70 + 1) for f, r in zip(block.first, regions, strict=True)])
    order, new = block.classes(place, 70)
    strings = [block.data[p : p + 70] for p in order.tolist()]
    assert strings == sorted(strings)
    assert new.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]


@pytest.mark.parametrize("spread", [1, 1 << 17])
def test_repeats_in_regions(monkeypatch, spread):
    monkeypatch.setattr(suffix_array, "RANGE", max(50, spread))
    rng = random.Random(1)
    base = bytes(rng.choice(b"abc") for _ in range(500))
    regions = [base[:150], base[30:190], base[:90] + b"x" + base[91:170], bytes(rng.choice(b"abc") for _ in range(100)), b"q" * 130]
    bits, asks = repeats_in(regions, 64, np.array([True] * 5))
    seen = Counter(r[i : i + 64] for r in regions for i in range(len(r) - 63))
    for r, b in zip(regions, bits, strict=True):
        flags = np.unpackbits(np.frombuffer(b, np.uint8), count=len(r) - 63)
        assert flags.tolist() == [int(seen[r[i : i + 64]] > 1) for i in range(len(r) - 63)]
    assert len({d for own in asks for _, d in own}) == sum(map(len, asks)) == len(seen)


def test_runs_cover_each_window_once():
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.integers(97, 100, 700), np.full(600, 97), rng.integers(97, 123, 50)]).astype(np.uint8)
    first, stop = np.array([0, 400, 1290]), np.array([400, 1290, 1350])
    piece, start, many, _, _ = runs_in(data, first, stop, 40)
    held = [(p, s + k) for p, s, n in zip(piece, start, many, strict=True) for k in range(n)]
    assert sorted(held) == [(p, s) for p in range(3) for s in range(first[p], stop[p] - 39)]
    assert len(runs_in(data[:30], np.array([0]), np.array([30]), 40)[0]) == 0


def test_small_cases(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage = word(90)
    rows = [
        (1, word(200) + passage + word(50)),
        (2, passage),
        (3, word(10) + passage[:-1] + "!" + word(100)),
        (4, None),
        (5, ""),
        (6, "a" * 500),  # repeats inside one text
        (7, "ab" * 20 + word(33)),
        (8, word(400)),
        (8, word(60)),
        (None, word(70) + passage),
        (None, word(70)),
        (9, "same " * 30),
        (9, "same " * 30),
        (10, word(39)),
    ]
    check(spark, rows, 40)


def test_copies_and_large_buckets(spark, monkeypatch):
    """Near copies and a passage in ever other surroundings, in buckets that are cut into parts, in small blocks."""
    monkeypatch.setattr(suffix_array, "BLOCK_BYTES", 3000)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage, base = word(100), word(400)
    rows = [(i, word(30) + passage + word(30)) for i in range(40)] + [(100 + i, base[: 9 * i] + word(3) + base[9 * i :]) for i in range(30)] + [(200 + i, base) for i in range(5)] + [(300, "z" * 9000)]
    check(spark, rows, 60, limit=4)


def test_long_text_is_cut_with_overlap():
    raw = "".join(random.Random(6).choice("abcd") for _ in range(5000))
    saved, suffix_array.BLOCK_BYTES = suffix_array.BLOCK_BYTES, 700
    try:
        blocks = suffix_array.pieces_of([5000, 10, 900], 200, 700)
        assert sorted((t, s) for b in blocks for t, low, high in b for s in range(low, high - 199)) == [(0, s) for s in range(4801)] + [(2, s) for s in range(701)]
        assert all(sum(h - low for _, low, h in b) <= 2 * 900 for b in blocks)
        found = list(suffix_array.text_runs(pa.array([raw.encode(), None, b""], pa.binary()), 200))
        assert sum(int(n.sum()) for _, _, n, *_ in found) == 4801
    finally:
        suffix_array.BLOCK_BYTES = saved


def test_empty_table_and_other_columns(spark):
    assert cut_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "x" * 300, 5, "r", "b")], "doc_id int, text string, id int, row string, bucket string")
    got = cut_repeated_bytes(df)
    assert dict(got.dtypes)["doc_id"] == "int"
    assert [(r.doc_id, len(r.kept)) for r in got.collect()] == [(1, 0)]


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    told = brute([r.text for r in rows], 200)
    want = sorted((r.doc_id, len((r.text or "").encode()), sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for r, (s, k) in zip(rows, told, strict=True))
    got = op11_suffix_array_dedup(spark, SF)
    assert [f"{n}:{t}" for n, t in got.dtypes] == ["doc_id:bigint", "n_bytes:bigint", "n_removed:bigint", "n_spans:bigint", "kept_sha256:string"]
    assert sorted(map(tuple, got.collect())) == want
    assert any(0 < w[2] < w[1] for w in want)
