import random

import numpy as np
import pytest

from jobmosaic.llm import chunking
from jobmosaic.llm.chunking import GEAR, MAX_CHUNK, MIN_SPAN, chunks_of, cut_repeats, repeated_spans, rolling, runs_of

SCHEMA = "doc_id long, text string, id string, n int, row string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgéhilmnoprst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def chunk_texts(text):
    """The chunks of one text, as bytes."""
    joined, _, starts, stops = chunks_of([text.encode()])
    return [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def slow_runs(text):
    """(start, stop, first byte, content) of each run, in code points, by a plain walk over the chunks."""
    chunks = chunk_texts(text)
    out = []
    for i in range(len(chunks)):
        for j in range(i + 1, len(chunks) + 1):
            content = b"".join(chunks[i:j])
            if len(content) >= MIN_SPAN:
                before = b"".join(chunks[:i])
                start = len(before.decode())
                out.append((start, start + len(content.decode()), len(before), tuple(chunks[i:j])))
                break
    return out


def slow_spans(rows):
    """Spans as repeated_spans gives them, for (id, text) rows without null ids."""
    holders = {}
    for i, t in rows:
        for *_, content in slow_runs(t or ""):
            holders.setdefault(content, set()).add(i)
    want = set()
    for i, t in rows:
        open_ = {}
        for start, stop, low, content in slow_runs(t or ""):
            size = sum(map(len, content))
            if len(holders[content]) > 1:
                mine = open_.setdefault(min(holders[content]), [])
                if mine and start <= mine[-1][1]:
                    mine[-1][1], mine[-1][3] = max(mine[-1][1], stop), max(mine[-1][3], low + size)
                else:
                    mine.append([start, stop, low, low + size])
        want |= {(i, a, b, high - low, least, least == i) for least, spans in open_.items() for a, b, low, high in spans}
    return want


def test_rolling_hash():
    data = np.frombuffer(random.Random(1).randbytes(200), np.uint8)
    value = 0
    for i, byte in enumerate(data.tolist()):
        value = ((value << 1) + int(GEAR[byte])) % 2**32
        assert rolling(data)[i] == value


@pytest.mark.parametrize("slice_bytes", [1 << 21, 64, 1000])
def test_chunks_cover_texts_and_do_not_depend_on_neighbours_or_slices(monkeypatch, slice_bytes):
    rng = random.Random(2)
    texts = [words(rng, rng.randrange(200)) for _ in range(40)] + ["", "a" * 5000, "x", "é" * 900, "\0" * 1000]
    alone = [chunk_texts(t) for t in texts]
    assert all(b"".join(c) == t.encode() and all(0 < len(x) <= MAX_CHUNK + 3 for x in c) for c, t in zip(alone, texts, strict=True))
    monkeypatch.setattr(chunking, "SLICE_BYTES", slice_bytes)
    joined, of, starts, stops = chunks_of([t.encode() for t in texts])
    for i in range(len(texts)):
        assert [joined[a:b] for a, b, o in zip(starts.tolist(), stops.tolist(), of.tolist(), strict=True) if o == i] == alone[i]
    monkeypatch.setattr(chunking, "SLICE_RUNS", 7)
    blocks = [tuple(x.tolist() for x in b) for b in runs_of([t.encode() for t in texts])]
    got = [r[:4] + (texts[r[0]].encode()[r[3] : r[3] + r[4]],) for b in blocks if len(b) == 7 for r in zip(*b, strict=True)]
    assert got == [(i, a, b, c, b"".join(d)) for i, t in enumerate(texts) for a, b, c, d in slow_runs(t)]


def test_insertion_moves_few_chunks():
    rng = random.Random(3)
    text = words(rng, 2000)
    other = text[:5000] + "INSERTED" + text[5000:]
    assert len(set(chunk_texts(text)) - set(chunk_texts(other))) <= 4


def test_planted_passages(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 300), "x", 1, None) for i in range(300)]
    planted = set()
    for k in range(60):
        passage = words(rng, 55)
        for i in (k * 5, k * 5 + 1 + k % 3):
            at = rng.randrange(len(rows[i][1]))
            rows[i] = (i, rows[i][1][:at] + " " + passage + " " + rows[i][1][at:], *rows[i][2:])
            planted.add(i)
    short = words(rng, 6)
    rows += [(1000 + i, words(rng, 40) + " " + short, "x", 1, None) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    spans = repeated_spans(df).collect()
    found = {r.doc_id for r in spans}
    assert found <= planted and len(found) >= 0.97 * len(planted)
    text = {r[0]: r[1] for r in rows}
    for r in spans:
        assert len(text[r.doc_id][r.start : r.stop].encode()) == r.n_bytes
        assert text[r.doc_id][r.start : r.stop] in text[r.first_doc_id]
    left = {r.doc_id: r.text for r in cut_repeats(df).collect()}
    assert len(left) == len(rows)
    for r in spans:
        if not r.kept:
            assert text[r.doc_id][r.start : r.stop] not in left[r.doc_id]
    assert all(left[i] == text[i] for i in text if i not in found)


def test_spans_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = slow_spans([(r.doc_id, r.text) for r in docs.collect()])
    assert {tuple(r) for r in repeated_spans(docs).collect()} == want and want


def gone(docs):
    """Chunks of the documents that are in none of them after the repeats are cut."""
    before, after = (dict(d.select("doc_id", "text").collect()) for d in (docs, cut_repeats(docs)))
    changed = {i for i in before if before[i] != after[i]}
    whole = {c for i, t in before.items() if i not in changed for c in chunk_texts(t or "")}
    left = "\0".join(after[i] for i in changed).encode()
    assert changed
    return [c for c in {c for i in changed for c in chunk_texts(before[i])} - whole if c not in left]


def test_first_copy_of_each_neighbour_stays(spark):
    """Passages that stand side by side here and apart there: Z is first in document 5, X and Y in 1."""
    rng = random.Random(5)
    x, y, z, c = (words(rng, 80) for _ in range(4))
    own = lambda: words(rng, 30)
    texts = {1: f"{own()} {x} {y} {own()}", 5: f"{x} {y} {z}", 7: f"{own()} {y} {z}", 3: f"{c} {own()}", 15: f"{c} {z} {own()}", 19: f"{own()} {z} {c}"}
    df = spark.createDataFrame([(i, t, "x", 1, None) for i, t in texts.items()], SCHEMA)
    assert gone(df) == []
    spans = repeated_spans(df).collect()
    left = {r.doc_id: r.text for r in cut_repeats(df).collect()}
    assert {(r.doc_id, r.first_doc_id) for r in spans} >= {(5, 1), (5, 5), (7, 1), (7, 5), (15, 3), (15, 5)}
    assert left[1] == texts[1] and len(left[7]) < len(texts[7]) - len(y) - len(z) + 150 and z[100:-100] in left[5] and z[100:-100] not in left[15]


def test_chunks_from_many_documents_are_no_passage(spark):
    """Neighbouring chunks that are common, but each in another document, don't repeat as a passage."""
    rng = random.Random(8)
    text = words(rng, 300)
    pieces, at = [], 0
    for c in chunk_texts(text):
        pieces.append((at, at + len(c)))
        at += len(c)
    raw = text.encode()
    rows = [(0, text, "x", 1, None)]
    for k, (a, b) in enumerate(pieces):
        if b - a + 31 < MIN_SPAN:
            rows.append((k + 1, words(rng, 30) + raw[max(0, a - 31) : b].decode(errors="ignore") + words(rng, 30), "x", 1, None))
    assert repeated_spans(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_no_chunk_is_lost(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert gone(docs) == []


def test_edges(spark):
    assert repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0
    text, other = words(random.Random(9), 400), words(random.Random(10), 60)
    rows = [(None, text, "x", 1, None), (None, text, "x", 1, None), (None, other, "x", 1, None), (4, text, None, 1, None), (4, text, "x", None, None), (4, other, "x", 1, None)]
    rows += [(5, None, "x", 1, None), (6, "", "x", 1, None), (7, "short", "x", 1, None), (8, "short", "x", 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.start, r.stop, r.first_doc_id, r.kept) for r in repeated_spans(df).collect()), key=str)
    ends = sorted([len(text), len(other)], key=str)
    assert got == [(4, 0, n, None, False) for n in ends] + [(None, 0, n, None, True) for n in ends]
    cut = cut_repeats(df)
    assert cut.columns == df.columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in cut.collect()) == sorted([(0, len(text)), (0, len(text)), (0, len(other)), (4, 0), (4, 0), (4, 0), (5, 0), (6, 0), (7, 5), (8, 5)])
    long = spark.createDataFrame([(1, text * 2000, "x", 1, None), (2, "a " * 100 + text * 1000, "x", 1, None)], SCHEMA)
    assert {r.doc_id for r in repeated_spans(long).collect()} == {1, 2}
