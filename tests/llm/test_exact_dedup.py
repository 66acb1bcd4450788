import hashlib
import re

from pyspark.sql import functions as F

from jobmosaic.llm.exact_dedup import build_index, drop_exact_copies, exact_dedup, grow_directory

SCHEMA = "doc_id long, text string, norm string, hash int, m map<string,int>"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = {}
    for n, r in zip(norm, rows, strict=True):
        groups.setdefault(n, []).append(r[0])
    out = []
    for n, r in zip(norm, rows, strict=True):
        ids = [i for i in groups[n] if i is not None]
        keep = min(ids) if ids else None
        out.append((r[0], keep, len(groups[n]), r[0] == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (5, "a  b", "n", 1, None), (3, "a\t\nb", None, None, {"x": 1}), (9, "a b ", "n", 1, None), (9, "a b ", "n", 1, None), (1, None, "n", 1, None),
    (2, "", "n", 1, None), (4, " ", "n", 1, None), (None, "zz", "n", 1, None), (None, "zz", "n", 1, None), (11, "zz", "n", 1, None),
    (None, "only", "n", 1, None), (20, "x y", "n", 1, None), (21, "x y", "n", 1, None), (30, "long " * 50000, "n", 1, None), (31, "long  " * 50000, "n", 1, None),
]


def test_edges_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted((tuple(r) for r in exact_dedup(df).collect()), key=str)
    assert got == brute(ROWS)
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3, 4, 9, 9, 11, 20, 21, 30]


WEAK = lambda c: F.pmod(F.length(c), F.lit(2)).cast("long")  # noqa: E731  nearly all texts collide


def test_chains_of_colliding_hashes(spark):
    rows = [(i, f"text {i % 7}", "n", 1, None) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in exact_dedup(df, hash_of=WEAK).collect()), key=str) == brute(rows)
    index = build_index(df, hash_of=WEAK)
    assert index.select("bucket").distinct().count() == 1 and {r.link for r in index.collect()} == set(range(1, 8))


def test_directory_doubles_until_buckets_fit(spark):
    top = 1 << 60  # the first four bits of a hash
    grown = lambda counts, capacity, first: grow_directory(spark.createDataFrame([((h - 16 if h > 7 else h) * top, n) for h, n in counts.items()], "hash long, n long"), capacity, first)
    uneven = grown({0: 50, 1: 50, 2: 3, 15: 9}, 60, 1)
    assert uneven.start == 2 and uneven.splits == [[4], [8]]
    bucket = {h: spark.createDataFrame([((h - 16 if h > 7 else h) * top,)], "hash long").select(uneven.bucket()).first()[0] for h in range(16)}
    assert bucket == {0: 16, 1: 17, 2: 9, 3: 9} | dict.fromkeys(range(4, 8), 5) | dict.fromkeys(range(8, 12), 6) | dict.fromkeys(range(12, 16), 7)
    assert grown({}, 10, 0).splits == [] and grown({6: 99}, 100, 0).start == 1 and grown({6: 999}, 10, 0).splits == []
    assert grown({h: 10 for h in range(16)}, 30, 0).start == 3


def test_many_buckets_give_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few, many = exact_dedup(docs), exact_dedup(docs, capacity=2, first_depth=0)
    assert few.exceptAll(many).count() == 0 and few.count() == docs.count()
    index = build_index(docs, capacity=20, first_depth=0)
    assert index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 20
    assert index.select("bucket").distinct().count() > 8


def test_many_copies_fill_pages(spark):
    rows = [(i, f"copy  {i % 3 % 2}", "n", 1, None) for i in range(500)] + [(None, "copy 0", "n", 1, None)] * 3 + [(600 + i, f"other {i // 2}", "n", 1, None) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for hash_of in (F.xxhash64, WEAK):
        assert sorted((tuple(r) for r in exact_dedup(df, page_rows=10, hash_of=hash_of).collect()), key=str) == brute(rows)
    index = build_index(df, page_rows=10)
    assert index.filter("page is not null").select("hash", "page").distinct().count() > 40
    assert sorted(r.doc_id for r in drop_exact_copies(df).collect()) == [0, 1] + [600 + 2 * i for i in range(150)]
