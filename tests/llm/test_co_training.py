import math
import random
import zlib

import numpy as np

from jobmosaic.llm.co_training import co_train, fit_logistic, keep_good, meta_features, score_quality, text_features, train_model
from jobmosaic.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, score string, quality int"
LABELS = "doc_id long, quality int, text string"


def test_logistic_finds_the_line():
    rng = np.random.default_rng(1)
    x = np.c_[rng.normal(size=(4000, 2)), np.ones(4000)]
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.5])))).astype(float)
    assert np.abs(fit_logistic(x, y, np.ones(4000), ridge=1e-6) - [2.0, -1.0, 0.5]).max() < 0.25


def test_views_teach_each_other():
    """Either view alone sees the class; few labels and a large pool."""
    rng = np.random.default_rng(2)
    truth = rng.random(3000) < 0.5
    views = tuple(np.c_[truth[:, None] * 1.5 + rng.normal(size=(3000, 4)), np.ones(3000)] for _ in range(2))
    few = np.zeros(3000, bool)
    few[:120] = True  # 30 of them calibrate
    back = np.arange(120) % 4 == 0

    def accuracy(rounds):
        model = co_train(tuple(v[few] for v in views), truth[few].astype(float), back, tuple(v[~few] for v in views), rounds)
        return np.mean((model.scores(tuple(v[~few] for v in views))[2] >= 0.5) == truth[~few])

    assert accuracy(5) > 0.93 and accuracy(5) >= accuracy(0) - 0.01
    assert co_train(tuple(v[few] for v in views), np.ones(120), back, views) is None


def test_rows_of_repeated_ids_teach_alike_in_any_order(spark):
    rng = random.Random(5)
    rows = [(i % 40, " ".join(rng.choice(["good", "text", "bad", "junk"]) for _ in range(20 + i % 7)), "s", "en", 9, None, None) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(30)], LABELS)
    models = []
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[1])):
        models.append(train_model(spark.createDataFrame(order, SCHEMA).repartition(5), labels, "doc_id", 30, 10))
    assert all(str(m) == str(models[0]) for m in models)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known, unseen = labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0")
    rows = score_quality(docs, known).join(unseen, "doc_id").collect()
    bad = [r.kept for r in rows if r.quality == 0]
    good = [r.kept for r in rows if r.quality == 1]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1, (np.mean(good), np.mean(bad))


def test_whole_text_counts():
    assert not np.array_equal(text_features("a b " * 50000), text_features("a b " * 50000 + "!" * 9999))
    assert np.array_equal(text_features(None), text_features(""))
    assert np.isfinite(meta_features({"source": None, "lang": None, "n_chars": None})).all()


def test_words_alone_tell(spark):
    """Good and bad texts of the same letters, lengths and metadata; only words and their order differ."""
    rng = random.Random(6)
    good, bad = ["stone", "river", "light", "steam"], ["notes", "ervir", "thigl", "meats"]
    rows = [(i, " ".join(rng.choice(bad if i % 3 == 0 else good) for _ in range(40)), "s", "en", 100, "x", 9) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "t") for i in range(0, 600, 2)], LABELS)
    got = score_quality(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert np.mean([r.kept == (r.doc_id % 3 > 0) for r in got if r.doc_id % 2]) > 0.95


def test_edges(spark):
    rng = random.Random(3)
    clean = lambda: " ".join(rng.choice(["the", "of", "river", "stone", "walk", "light"]) for _ in range(40)) + "."
    junk = lambda: " | ".join(rng.choice(["AA!!", "B%%", "$$"]) for _ in range(40))
    rows = [(i, junk() if i % 3 == 0 else clean(), "s", "en", 100, "x", 9) for i in range(200)]
    rows += [(None, clean(), None, None, None, None, None), (500, None, None, None, None, "x", 1), (501, "", "s", "en", 0, "x", 1), (502, clean() * 3000, "s", "en", 1, "x", 1), (7, rows[7][1], "s", "en", 100, "x", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "t") for i in range(0, 200, 2)] + [(None, 1, "t"), (4, None, "t"), (9999, 0, "t")], LABELS)
    got = score_quality(df, labels).collect()
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id % 3 > 0) for r in got if r.doc_id is None or r.doc_id < 200)
    kept = keep_good(df, labels)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted((r.doc_id or -1) for r in got if r.kept)
    none = spark.createDataFrame([], SCHEMA)
    assert score_quality(none, labels).count() == 0 and keep_good(none, labels).count() == 0
    assert score_quality(df, spark.createDataFrame([], LABELS)).filter("kept and score is null").count() == len(rows)
    assert train_model(df, labels.filter("quality = 1")) is None


def slow_scores(model, views):
    """The combined score of one document by plain sums."""
    calibrated = []
    for view, x, (slope, shift) in zip(model.views, views, model.calibration, strict=True):
        logit = sum(min(20.0, max(-20.0, (a - m) / s)) * w for a, m, s, w in zip(x, view.middle, view.spread, view.weights, strict=True))
        calibrated.append(slope * logit + shift)
    z = model.mix[0] * calibrated[0] + model.mix[1] * calibrated[1] + model.mix[2]
    return [1 / (1 + math.exp(-min(30.0, max(-30.0, v)))) for v in (*calibrated, z)]


def slow_word_cells(words):
    """Shares of 256 cells, a word and a pair of words at a time, in whole numbers modulo 2**32."""
    cells, m = [0] * 256, 1 << 32
    one = [zlib.crc32(w) * 0x9E3779B1 % m for w in words]
    for h in one + [(a * 0x85EBCA77 + (b ^ b >> 15) * 0xC2B2AE3D) % m for a, b in zip(one, one[1:])]:
        cells[h >> 24] += 1
    return [math.sqrt(n / max(1, sum(cells))) for n in cells]


def slow_text_features(text):
    raw = text.encode()
    words, size = raw.split(), max(1, len(raw))
    many = max(1, len(words))
    share = lambda test: sum(1 for b in raw if test(b)) / size
    upper, lower = sum(1 for b in raw if 65 <= b <= 90), sum(1 for b in raw if 97 <= b <= 122)
    dense = [upper / size, lower / size, share(lambda b: 48 <= b <= 57), share(lambda b: b > 127), share(lambda b: b == 32), share(lambda b: b == 10), share(lambda b: b < 32)]
    dense += [upper / max(1, upper + lower), len(set(words)) / many, sum(a == b for a, b in zip(words, words[1:])) / many, min(1.0, size / many / 20), sum(1 for b in raw if b in b"!.?") / many]
    dense += [math.log1p(size) / 12, math.log1p(many) / 10, float(many < 5), float(many < 20), max((raw.count(bytes([b])) for b in set(raw)), default=0) / size]
    marks = [raw.count(m) / size for m in (bytes([b]) for b in b"|%$#&*!.,;:?<>{}[]()/\\=_~^@\"'-")]
    return [*dense, *marks, *map(math.sqrt, marks), *slow_word_cells(words), 1.0]


def test_query_against_a_plain_twin(spark):
    """Every row of the query, from the trained model, by a second way of taking features and adding up."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = train_model(docs, labels)
    got = {r.doc_id: r for r in QUERIES["op6_quality_classifier"](spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = slow_scores(model, (slow_text_features(r.text), meta_features(r.asDict())))
        assert np.allclose([got[r.doc_id].text_score, got[r.doc_id].meta_score, got[r.doc_id].score], want, atol=1e-9)
        assert got[r.doc_id].kept == (got[r.doc_id].score >= 0.5)


def test_contradicted_documents_teach_neither(monkeypatch):
    """The views are each sure of the opposite: nothing is passed on, so the views stay as the labels made them."""
    x = np.c_[np.r_[np.full(40, -5.0), np.full(40, 5.0)], np.ones(80)]
    y, back = np.r_[np.zeros(40), np.ones(40)], np.arange(80) % 4 == 0
    pool = np.c_[np.full(30, 5.0), np.ones(30)]
    alone = co_train((x, x), y, back, (pool, pool * [-1, 1]), rounds=0)
    taught = co_train((x, x), y, back, (pool, pool * [-1, 1]), rounds=3)
    assert all(np.array_equal(a.weights, b.weights) for a, b in zip(alone.views, taught.views, strict=True))
