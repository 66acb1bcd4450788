import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from jobmosaic.sources import portals as W
from jobmosaic.sources.landed import PagesReader, read_portal, register
from tests.test_sources import THOR, VAGAS, landed


def write(folder, name, rows, group=2):
    folder.mkdir(parents=True, exist_ok=True)
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    table = pa.table({"extra": pa.array(range(len(rows)), pa.int32()), "term": pa.array(columns[0], pa.string()), "page": pa.array(columns[1], pa.int64()), "html": pa.array(columns[2], pa.string())})
    pq.write_table(table, folder / name, row_group_size=group)


def some(n, html):
    return [("termo", i, None if i % 5 == 2 else "<p>nada</p>" if i % 5 == 3 else html.replace('data-id-vaga="77"', f'data-id-vaga="{i}"') + "x" * (97 * i)) for i in range(n)]


def test_same_rows_as_pages_in_a_table_however_files_are_cut(spark, tmp_path):
    rows = some(41, VAGAS)
    write(tmp_path / "v", "a.parquet", rows[:17])
    write(tmp_path / "v" / "deeper", "b.parquet", rows[17:], group=5)
    write(tmp_path / "v", "_hidden.parquet", rows)
    write(tmp_path / "v" / ".temporary", "c.parquet", rows)
    want = sorted(tuple(r) for r in W.vagas_cards(spark.createDataFrame(rows, "term string, page long, html string")).collect())
    assert len(want) == 2 * sum(i % 5 not in (2, 3) for i in range(41))
    assert sorted(tuple(r) for r in read_portal(spark, "vagas", str(tmp_path / "v")).collect()) == want
    for size in (100, 1000, 1 << 20):
        cards = spark.read.format("vagas_pages").option("partBytes", size).load(f"file:{tmp_path}/v")
        assert sorted(tuple(r) for r in W.vagas_postings(cards).collect()) == want
    parts = PagesReader(str(tmp_path / "v"), W.vagas_fields, 1000).partitions()
    assert len(parts) > 2 and all(p.high - p.low <= 1000 for p in parts)


def test_a_portal_of_ones_own(spark, tmp_path):
    write(tmp_path, "a.parquet", [("x", 3, "<ul><li>eins</li><li>zwei</li></ul>"), (None, None, "<li>drei</li>")])
    register(spark, {"mine": lambda root: [{"title": n.text(), "none": None} for n in root.all("li")]})
    got = spark.read.format("mine_pages").load(str(tmp_path)).collect()
    assert sorted((r.term or "", r.page or 0, r.pos, r.c["title"], r.c["none"]) for r in got) == [("", 0, 0, "drei", None), ("x", 3, 0, "eins", None), ("x", 3, 1, "zwei", None)]


def test_empty_folders_and_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert read_portal(spark, "programathor", str(tmp_path / "none")).collect() == []
    write(tmp_path / "empty", "a.parquet", [])
    assert read_portal(spark, "linkedin", str(tmp_path / "empty")).collect() == []
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("linkedin_pages").load().collect()


def test_all_kinds_of_portals_in_order(spark, tmp_path):
    write(tmp_path / "programathor", "a.parquet", [("termo", 2, THOR), ("x", 1, THOR)])
    landed(spark, [{"id": 5, "name": "a"}, {"id": 4, "name": "b"}]).write.parquet(str(tmp_path / "gupy"))
    rows = W.in_order({p: read_portal(spark, p, str(tmp_path / p)) for p in ("gupy", "programathor")}, ["programathor", "outro", "gupy"], ["x", "termo"])
    assert [(r.source, r.search_term, r.external_id) for r in rows.orderBy("ord").collect()] == [("programathor", "x", "11"), ("programathor", "x", "13"), ("programathor", "termo", "11"), ("programathor", "termo", "13"), ("gupy", "termo", "5"), ("gupy", "termo", "4")]
