import math
import random
import zlib
from collections import Counter

import numpy as np

from jobmosaic.llm import language_id
from jobmosaic.llm.language_id import codewords, decode, held_out, identify_languages, least_distance, profile, train_codes
from jobmosaic.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, id string, score int"


def test_codewords_of_many_languages_by_the_least_distance_of_all():
    code = codewords(200)
    near = min(int((code[a] != code[b]).sum()) for a in range(200) for b in range(a))
    tries = [np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), code.shape) for seed in range(20)]
    assert near == least_distance(code) == max(least_distance(t) for t in tries)


def test_codewords():
    assert codewords(0).shape == (0, 1) and codewords(1).tolist() == [[1]]
    for n in range(2, 12):
        code = codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code}) == n
        assert all((c > 0).any() and (c < 0).any() for c in code.T)
    near = min((a != b).sum() for i, a in enumerate(codewords(5)) for b in codewords(5)[:i])
    assert near == 8  # three wrong bits of fifteen are put right


def test_decoding_mends_wrong_bits():
    code = codewords(5)
    for i in range(5):
        margins = code[i].astype(float)
        margins[:3] *= -1
        best, score = decode(margins[None], code)
        assert best[0] == i and 0 < score[0] < 1
    clear, unclear = decode(4.0 * code[:1], code)[1][0], decode(0.0 * code[:1], code)[1][0]
    assert clear > 0.99 and abs(unclear - 0.2) < 1e-9


def test_profile_in_slices(monkeypatch):
    text = "abcdé fgh " * 50
    whole = profile(text)
    monkeypatch.setattr(language_id, "SLICE_BYTES", 64)
    assert abs(int(profile(text).sum()) - int(whole.sum())) <= 8 * 20  # slices begin and end with a space


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert len(right) > 200 and np.mean(right) > 0.98


def test_only_training_rows_teach(spark):
    rows = [(i, "aaa bbb ccc" if i % 2 else "xxx yyy zzz", "a" if i % 2 else "x", None, 1) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    train = df.filter(~held_out())
    names, _, weights = train_codes(train)
    other = df.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'q', lang) lang", "id", "score").filter(~held_out())
    assert train_codes(other)[0] == names == ["a", "x"] and np.array_equal(train_codes(other)[2], weights)
    assert all(r.lang_pred == ("a" if r.doc_id % 2 else "x") for r in identify_languages(df, train).collect())


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    rng = random.Random(1)
    rows = [(1, None, "a", None, None), (2, "", "a", None, None), (3, "12 %%", None, "q", 1), (None, "abc abd", "a", None, 1), (4, "xyz", "x", None, 1), (4, "xyz", "x", None, 1)]
    rows += [(5, "".join(rng.choice("xyz ") for _ in range(300000)), None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert identify_languages(empty, df).count() == 0
    assert all(r.lang_pred == "und" and r.score == 0 for r in identify_languages(df, empty).collect())
    got = {r.doc_id: r for r in identify_languages(df, df).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, None, 4, 5)] == ["und", "und", "und", "a", "x", "x"]
    single = identify_languages(df, df.filter("lang = 'a'")).collect()
    assert {r.lang_pred for r in single} == {"und", "a"}


def slow_cells(text):
    """Hash cells of all byte pairs and triples, by plain arithmetic."""
    data = b" " + text.lower().encode() + b" "
    found = Counter()
    for i in range(len(data) - 1):
        two = data[i] * 0x9E3779B1 + data[i + 1] * 0x85EBCA77 & 0xFFFFFFFF
        found[two >> 18] += 1
        if i + 2 < len(data):
            found[(two * 0xC2B2AE3D + data[i + 2] * 0x27D4EB2F & 0xFFFFFFFF) >> 18] += 1
    return found


def test_query_against_a_plain_twin(spark):
    """Every row of the query by a second way of training and decoding: sums, log odds for each bit, losses, nearest codeword."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    sums = {}
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and any(c.isalpha() for c in r.text or ""):
            cells = slow_cells(r.text)
            size = sum(cells.values())
            own = sums.setdefault(r.lang, Counter())
            for c, n in cells.items():
                own[c] += n if size <= language_id.DOC_WEIGHT else round(n * (language_id.DOC_WEIGHT / size))
    names = sorted(sums)
    code = codewords(len(names)).tolist()
    total = {n: sum(sums[n].values()) for n in names}
    share = lambda n, c: (sums[n][c] + 0.5) / (total[n] + 0.5 * language_id.CELLS)
    bits = range(len(code[0]))
    weight = {}

    def weights(c):
        if c not in weight:
            mean = lambda b, sign: (lambda v: sum(v) / len(v))([share(n, c) for n, w in zip(names, code, strict=True) if w[b] == sign])
            weight[c] = [math.log(mean(b, 1)) - math.log(mean(b, -1)) for b in bits]
        return weight[c]

    got = {r.doc_id: r for r in QUERIES["op9_language_id"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for r in docs:
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        cells = slow_cells(r.text)
        size = math.sqrt(sum(cells.values()))
        margins = [sum(n * weights(c)[b] for c, n in cells.items()) / size for b in bits]
        loss = [sum(math.log1p(math.exp(-m * w)) if m * w > -30 else -m * w for m, w in zip(margins, word, strict=True)) for word in code]
        best = min(range(len(names)), key=loss.__getitem__)
        score = 1 / sum(math.exp(min(700, loss[best] - x)) for x in loss)
        assert abs(got[r.doc_id].score - score) < 1e-3 and (got[r.doc_id].lang_pred == names[best] or score < 0.51)
