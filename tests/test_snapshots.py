import csv
import datetime as dt
import io
import random

import pytest

from jobmosaic.functions.rules import Rules
from jobmosaic.plans import query as Q
from jobmosaic.plans import store as S
from jobmosaic.plans.versions import VersionedTable, grams_of
from jobmosaic.sources.snapshots import SNAPSHOT_COLUMNS, csv_records, latest_file, read_csv_rows

RULES = Rules()
NAMES = ["vagas_20260101_000000.csv", "vagas_20260201_000000.csv"]


@pytest.fixture
def small_blocks(spark):
    """Files are split every few bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def written(path, rows, end="\n", bom=True):
    text = io.StringIO()
    csv.writer(text, lineterminator=end).writerows(rows)
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.getvalue().encode())


def test_rows_of_split_files_come_in_order(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    value = lambda: rng.choice(["", "a", 'say ""', 'one "quoted"', "two\nlines", '"\n"', "\n\n\n", ",,", "é" * 40, "x" * 150, 'end"', " pad "])
    files = []
    for k, end in enumerate(("\n", "\r\n", "\n")):
        rows = [[f"{k}-{i}", value(), value()] for i in range(60)]
        written(tmp_path / f"f{k}.csv", [["a", "b", "c"], *rows], end, bom=k != 2)
        files += rows
    got = read_csv_rows(spark, ["a", "b", "c"], str(tmp_path)).orderBy("ord").collect()
    assert [[r.a, r.b or "", r.c or ""] for r in got] == files
    assert csv_records(spark, str(tmp_path)).select("ord").distinct().count() == len(files)


def test_plain_and_empty_files(spark, tmp_path):
    written(tmp_path / "p.csv", [["a", "b"], ["1", "x"], ["2", "y"]])
    (tmp_path / "q.csv").write_text("a,b\n")
    (tmp_path / "r.csv").write_text("a,b\n3,z")
    got = read_csv_rows(spark, ["a", "b"], str(tmp_path)).orderBy("ord").collect()
    assert [(r.a, r.b, r.file_name) for r in got] == [("1", "x", "p.csv"), ("2", "y", "p.csv"), ("3", "z", "r.csv")]


def snapshot_file(path, rows):
    """rows: (external_id, title, company)."""
    cell = {"source": "gupy", "area": "Data", "published_date": "2026-01-01"}
    written(path, [SNAPSHOT_COLUMNS, *[[(cell | {"external_id": k, "title": t, "company": c, "description": f"{t}\n{c}"}).get(n, "") for n in SNAPSHOT_COLUMNS] for k, t, c in rows]])


def test_only_the_latest_file_is_opened(spark, tmp_path):
    snapshot_file(tmp_path / NAMES[1], [("1", "A", "c")])
    (tmp_path / NAMES[0]).write_bytes(b"\xff\xfe not a snapshot")
    (tmp_path / "zz.csv").write_text("x")
    assert latest_file(spark, str(tmp_path)).endswith(NAMES[1])
    rows = S.read_latest(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in rows.inputFiles() if "csv-blocks" not in f] == [NAMES[1]]
    assert [(r.external_id, r.description, r.file_name) for r in rows.collect()] == [("1", "A\nc", NAMES[1])]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "other.csv").write_text("x")
    with pytest.raises(FileNotFoundError):
        S.read_latest(spark, str(tmp_path / "none"))


def size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_files_to_table_of_buckets(spark, tmp_path):
    """The same rows as merging whole tables, and a small batch writes a small part."""
    moment = [dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1), dt.datetime(2026, 3, 1)]
    first = [(str(i % 900), f"T{i}", f"C{i % 7}") for i in range(1000)]
    second = [("5", "T5 new", "C"), ("9000", "N", "C"), ("5", "T5 last", "D"), ("17", "T917", "C0"), ("9001", " ", "C")]
    for name, rows in zip(NAMES, (first, second), strict=True):
        snapshot_file(tmp_path / name, rows)
    table = VersionedTable(spark, str(tmp_path / "table"), buckets=32)
    assert table.latest() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    read = lambda n: S.incoming(S.read_snapshot(spark, str(tmp_path / n)), RULES)
    counts = [table.merge(read(n), m).first() for n, m in zip(NAMES, moment, strict=False)]
    assert [tuple(c) for c in counts] == [(900, 100, 0, 900), (1, 3, 0, 901)]
    whole = S.upsert_vagas(None, read(NAMES[0]), moment[0])
    both = S.upsert_vagas(whole.vagas, read(NAMES[1]), moment[1])
    told = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert told(table.read(0)) == told(whole.vagas) and told(table.read()) == told(both.vagas)
    assert [r.title for r in table.read().filter("external_id = '5'").collect()] == ["T5 last"]
    touched = {r[0] for r in read(NAMES[1]).select(table.bucket_of()).distinct().collect()}
    folders = {int(f.name.split("=")[1]) for f in (tmp_path / "table/data/version=1").glob("bucket=*")}
    assert folders == touched and len(touched) <= 3
    assert size(tmp_path / "table/data/version=1") < size(tmp_path / "table/data/version=0") / 5
    # the same batch under the same number gives the same version; a batch without rows changes nothing
    before = told(table.read())
    table.merge(read(NAMES[1]), moment[1], version=1)
    assert table.latest() == 1 and told(table.read()) == before
    assert tuple(table.merge(read(NAMES[1]).limit(0), moment[2]).first()) == (0, 0, 0, 901)
    assert table.latest() == 2 and told(table.read()) == before and told(table.read(0)) == told(whole.vagas)


def test_search_reads_the_buckets_that_have_its_characters(spark, tmp_path):
    assert grams_of("Ab%c_defg") == {"def", "efg"} and grams_of("a%b_") == set() and grams_of("DÉJÀ") == {"déj", "éjà"}
    rows = [(str(i), f"Analista {i:04d}", "C") for i in range(300)] + [("a", "Dev 100% Flutter Jr", "C"), ("b", "FLUTTER jr", "C"), ("c", "ab", "C"), ("d", "x\\y flutx", "C")]
    snapshot_file(tmp_path / NAMES[0], rows)
    snapshot_file(tmp_path / NAMES[1], [("a", "Dev React Jr", "C"), ("e", "Dev Flutter", "C")])
    table = VersionedTable(spark, str(tmp_path / "table"), buckets=32)
    for n, name in enumerate(NAMES):
        table.merge(S.incoming(S.read_snapshot(spark, str(tmp_path / name)), RULES), dt.datetime(2026, 1 + n, 1))
    files = lambda df: len({f.rsplit("/", 2)[1] for f in df.inputFiles()})
    for version in (0, 1):
        whole = table.read(version)
        for q in ("flutter", "Flut%jr", "flu__er", "analista 01_7", "x\\y", "%%", "ab", "100% F", "nothing here", "DEV"):
            found = table.search(RULES, q, version)
            assert sorted(r.id for r in found.collect()) == sorted(r.id for r in Q.list_vagas(whole, RULES, q=q).collect()), q
        assert files(table.search(RULES, "flutter", version)) <= 3 < 28 <= files(table.search(RULES, "%%", version))
    assert [r.external_id for r in table.search(RULES, "flutter", area="Data").orderBy("id").collect()] == ["b", "e"]


def test_records_are_parsed_once(spark, tmp_path):
    (tmp_path / "vagas_1.csv").write_text(",".join(SNAPSHOT_COLUMNS) + "\n" + ",".join(["x"] * len(SNAPSHOT_COLUMNS)) + "\n", encoding="utf-8")
    rows = S.read_snapshot(spark, str(tmp_path / "vagas_1.csv"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_csv(") == 1 and rows.count() == 1
