import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import xxhash

from jobmosaic.llm import importance
from jobmosaic.llm.importance import Interned, draw, features_of, hash_columns, pieces_of, resample
from jobmosaic.llm.queries import ORACLE_SQL, op12_importance_resampling

SF = "/root/testdata/sf0.001"


def features(text, most):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, least=20, most=1, seed=2024, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, most)[1])
    t = Counter(bucket(f) for x in target for f in features(x, most)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, text in docs:
        words, own = features(text, most)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in own)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    open_ = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(open_[: percent * len(open_) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_hash_is_xxhash64():
    rng = np.random.default_rng(1)
    for n in range(1, 32):
        cells = rng.integers(0, 256, (20, n)).astype(np.uint8)
        assert hash_columns(cells).tolist() == [xxhash.xxh64_intdigest(c.tobytes()) for c in cells]


def test_equal_hashes_are_told_apart_by_bytes():
    data = np.frombuffer(b"abc abd abc xyz " + b"w" * 40, np.uint8)
    start, size = np.array([0, 4, 8, 12, 16, 16]), np.array([3, 3, 3, 3, 40, 39])
    table = Interned(data, start, size, 1000, hash_of=lambda cells: np.full(len(cells), 7, np.uint64))
    assert table.slot[0] == table.slot[2] and len(set(table.slot.tolist())) == 5
    assert table.count[table.slot].tolist() == [2, 1, 2, 1, 1, 1]
    assert table.bucket[table.slot].tolist() == [zlib.crc32(data[a : a + n].tobytes()) % 1000 for a, n in zip(start, size, strict=True)]


def test_features_of_long_texts_cut_in_pieces(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab C9é-.  \n") for _ in range(n)) for n in (0, 900, 40, 3)] + ["x" * 500, "--", "ß ß"]
    views = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    for most in (1, 3):
        monkeypatch.setattr(importance, "pieces_of", lambda v, m: pieces_of(v, m, 64))
        got, counted = [Counter() for _ in texts], np.zeros(len(texts), int)
        for words, of, data, start, size in features_of(views, most):
            counted += words
            for t, a, n in zip(of.tolist(), start.tolist(), size.tolist(), strict=True):
                got[t][data[a : a + n].tobytes().decode()] += 1
        assert got == [Counter(features(t, most)[1]) for t in texts]
        assert counted.tolist() == [len(features(t, 1)[0]) for t in texts]


def test_small_cases(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["Alpha", "beta", "GAMMA-9", "élan", "zwölf", "x"]) for _ in range(n))
    docs = [(i, say(rng.randint(15, 60))) for i in range(120)] + [(200, None), (201, ""), (None, say(30)), (None, say(30)), (202, "one " * 19), (203, "one " * 20), (204, "--"), (5, say(40))]
    same = say(40)
    docs += [(300, same), (300, same), (301, "w" * 5000 + " " + say(25))]
    target = ["alpha alpha beta", None, "élan GAMMA 9", say(50)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    corpus = frame([(i, t, "r", 1) for i, t in docs], "doc_id long, text string, rank string, tie int")
    for most in (1, 2):
        got = resample(corpus, frame([(t,) for t in target], "text string"), percent=30, most=most, buckets=500)
        assert Counter(map(tuple, got.collect())) == brute(docs, target, 30, most=most, buckets=500)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none).collect() == []
    some = spark.createDataFrame([(i, "a b " * (20 + i)) for i in range(10)], "doc_id int, text string")
    got = resample(some, none, percent=50)
    assert dict(got.dtypes) == {"doc_id": "int", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}
    assert Counter(map(tuple, got.collect())) == brute([(i, "a b " * (20 + i)) for i in range(10)], [], 50)
    drawn = draw(some, none, percent=50).collect()
    assert sorted(r.rank for r in drawn) == [1, 2, 3, 4, 5] and drawn[0].text


def test_query_sql_and_brute_force_agree(spark):
    rows = Counter(map(tuple, op12_importance_resampling(spark, SF).collect()))
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert rows == Counter(con.execute(ORACLE_SQL["op12_importance_resampling"]).fetchall())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows == brute(docs, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
