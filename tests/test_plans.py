import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobmosaic.functions.dates import parse_published_date, reference_date
from jobmosaic.functions.rules import Rules
from jobmosaic.plans import query as Q
from jobmosaic.plans import rankings as R
from jobmosaic.plans import store as S
from jobmosaic.plans.versions import VersionedTable
from jobmosaic.sources.snapshots import SNAPSHOT_COLUMNS
from jobmosaic.streaming.imports import stream_import

RULES = Rules()
DAY = dt.date(2026, 7, 31)


def test_dates(spark):
    cases = [("2026-06-26", dt.date(2026, 6, 26)), ("2026-06-26T10:00", dt.date(2026, 6, 26)), ("09/07/2026", dt.date(2026, 7, 9)), ("Hoje", DAY), ("Ontem", dt.date(2026, 7, 30)), ("Anteontem", dt.date(2026, 7, 29)), ("Há 3 dias", dt.date(2026, 7, 28)),
             ("há 1 dia", dt.date(2026, 7, 30)), ("Há mais de 30 dias", dt.date(2026, 7, 1)), ("Há 2 meses", dt.date(2026, 6, 1)), ("ha 1 mês", dt.date(2026, 7, 1)), ("", None), (None, None), ("qualquer coisa", None), ("32/13/2026", None), ("2026-02-30", None), (" Ontem ", dt.date(2026, 7, 30))]
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(parse_published_date("t", DAY)).collect()] == [c[1] for c in cases]


def test_reference_date(spark):
    df = spark.createDataFrame([("vagas_20260731_174407.csv",), ("vagas.csv",), ("vagas_99999999_000000.csv",)], "f string")
    changed = F.lit(dt.datetime(2026, 1, 2, 3))
    assert [r[0] for r in df.select(reference_date(F.col("f"), changed)).collect()] == [DAY, dt.date(2026, 1, 2), dt.date(2026, 1, 2)]
    assert {r[0] for r in df.select(reference_date(F.col("f"), changed, dt.date(2020, 1, 1))).collect()} == {dt.date(2020, 1, 1)}


def test_percent_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(1, 16), (3, 16), (2, 3), (1, 1), (0, 0), (5, 0)], "n long, t long")
    assert [r[0] for r in df.select(R.percent(F.col("n"), F.col("t"))).collect()] == [6.2, 18.8, 66.7, 100.0, 0.0, 0.0]


def jobs(spark, rows):
    return spark.createDataFrame(rows, "area string, workplace_type string, skills array<string>, company string, title_ord long, rep_ord long, ord long, title string, source string")


def test_rankings(spark):
    rows = [("Backend", "Remoto", ["SQL", "Java"], "A", 0, 0, 0, "t", "x"), ("Backend", " ", ["SQL"], "B", 1, 1, 1, "t", "x"), ("Data", "Híbrido", [], "A", 2, 2, 2, "t", "y")]
    df = jobs(spark, rows)
    assert [tuple(r) for r in R.area_ranking(df).orderBy("posicao").collect()] == [(1, "Backend", 2, 66.7), (2, "Data", 1, 33.3)]
    assert [tuple(r)[1:3] for r in R.workplace_ranking(df).orderBy("posicao").collect()] == [("Remoto", 1), ("Híbrido", 1), ("Não informado", 1)]
    assert [tuple(r) for r in R.workplace_by_area(df).orderBy("posicao").collect()] == [("Backend", 1, 0, 0, 0, 1), ("Data", 0, 1, 0, 0, 2)]
    assert [tuple(r) for r in R.skills_by_area(df, 1).collect()] == [("Backend", 1, "SQL", 2)]
    assert [tuple(r) for r in R.skill_base_by_area(df).collect()] == [("Backend", 2, 2)]
    assert [r.company for r in R.top_companies(df).orderBy("posicao").collect()] == ["A", "B"]
    for f in (R.area_ranking, R.workplace_ranking, R.skills_by_area, R.skill_share_by_area, R.overall_skills, R.top_companies, R.workplace_by_area):
        assert f(jobs(spark, [])).count() == 0


def incoming(spark, rows, name="vagas_20260731_000000.csv"):
    full = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "ord long, source string, external_id string, title string, area string, published_date string, skills string, company string")
    blank = {c: F.lit("") for c in SNAPSHOT_COLUMNS if c not in df.columns}
    return S.incoming(df.withColumns(blank | {"file_name": F.lit(name), "file_time": F.lit(dt.datetime(2026, 1, 1))}), RULES)


def test_upsert(spark):
    first = incoming(spark, [("g", "1", "A", "Data", "Ontem", "sql, Cobol", "c"), ("g", "2", "B", "", "", "", " "), ("g", "1", "A2", "Data", "Ontem", "SQL", "c"), ("g", " ", "x", "", "", "", "")])
    one = S.upsert_vagas(None, first, dt.datetime(2026, 8, 1))
    assert tuple(one.counters.first()) == (2, 1, 1, 2)
    table = spark.createDataFrame(one.vagas.collect(), one.vagas.schema)
    assert [(r.id, r.title, r.area, r.skills, r.company) for r in table.orderBy("id").collect()] == [(1, "A2", "Data", ["SQL"], "c"), (2, "B", "Outros/TI Geral", [], None)]
    again = S.upsert_vagas(table, first, dt.datetime(2026, 9, 1))
    assert tuple(again.counters.first()) == (0, 3, 1, 2)
    assert sorted(map(str, again.vagas.collect())) == sorted(map(str, table.select(again.vagas.columns).collect()))
    second = incoming(spark, [("h", "9", "N", "", "", "", ""), ("g", "2", "B", "", "", "sql", ""), ("g", "1", "A3", "Data", "", "", "")])
    blank = incoming(spark, [("\t", "1", "x", "", "", "", ""), ("g", "\u00a0", "x", "", "", "", ""), ("g", "7", "\u2003\n", "", "", "", ""), ("g\t", " 8", "\u00a0T\t", "\t", "", " sql\u00a0,\tJava", "\u00a0")]).collect()
    assert [(r.source, r.external_id, r.title, r.area, r.skills, r.company) for r in blank] == [("g", "8", "T", "Outros/TI Geral", ["Java", "SQL"], None)]
    two = {r.external_id: r for r in S.upsert_vagas(table, second, dt.datetime(2026, 9, 1)).vagas.collect()}
    assert two["9"].id == 3 and two["9"].created_at == dt.datetime(2026, 9, 1)
    assert two["2"].skills == ["SQL"] and two["2"].updated_at == dt.datetime(2026, 8, 1)  # links alone don't count
    assert two["1"].updated_at == dt.datetime(2026, 9, 1) and two["1"].created_at == dt.datetime(2026, 8, 1) and two["1"].published_date is None


def test_numbers_follow_order_over_ranges(spark):
    rows = S.numbered(spark.range(5, 60).repartition(4).withColumnRenamed("id", "k"), "k", 100).collect()
    assert sorted((r.k, r.id) for r in rows) == [(k, 96 + k) for k in range(5, 60)]


def test_queries(spark):
    data = [(1, "gupy", "1001", "Engenheiro de Dados Júnior", "Data", "Remoto", dt.date(2026, 7, 20), ["Python", "SQL"]), (2, "gupy", "1002", "Analista de Dados Júnior", "Data", "Híbrido", dt.date(2026, 7, 10), ["SQL"]),
            (3, "vagas", "2001", "Desenvolvedor Front-End Jr", "Frontend", "Remoto", dt.date(2026, 7, 25), ["React"]), (4, "vagas", "2002", "Estágio em Suporte Técnico", "Suporte/Infra", "Não informado", None, [])]
    v = spark.createDataFrame(data, "id long, source string, external_id string, title string, area string, workplace_type string, published_date date, skills array<string>")
    page = lambda df, *a: [r.external_id for r in Q.page_vagas(df, *a).collect()]
    assert page(v) == ["2001", "1001", "1002", "2002"] and page(v, 2, 1) == ["1001", "1002"]
    assert page(Q.list_vagas(v, RULES, area="Data", tecnologia="python")) == ["1001"] and page(Q.list_vagas(v, RULES, q="DADOS", workplace_type="Híbrido")) == ["1002"]
    one = Q.list_page(v, RULES, 1, 1, workplace_type="Remoto")
    assert one.total.first()[0] == 2 and [r.external_id for r in one.vagas.collect()] == ["1001"]
    odd = spark.createDataFrame([(1, "a\\x b"), (2, "ax b"), (3, "50% a\\")], "id long, title string")
    assert [[r.id for r in Q.list_vagas(odd, RULES, q=q).collect()] for q in ("a\\x", "a_b", "%b", "a\\", "A\\X")] == [[1], [], [1, 2], [1, 3], [1]]
    for wrong in ((0, 0), (201, 0), (5, -1)):
        with pytest.raises(ValueError):
            Q.page_vagas(v, *wrong)
    counts = {r.nome: r.vagas for r in Q.area_counts(v, RULES).collect()}
    assert counts["Data"] == 2 and counts["Mobile"] == 0 and len(counts) == 10
    tec = S.seed_tecnologias(None, RULES, spark)
    links = S.link_tecnologias(v, tec)
    tech = {r.nome: r.vagas for r in Q.tech_counts(links, tec).collect()}
    assert (tech["SQL"], tech["Python"], tech["React"], tech["Go"]) == (2, 1, 1, 0)
    assert sorted(r.id for r in Q.vagas_with_tech(v, links, tec, "sql").collect()) == [1, 2]
    for wrong in ({"area": "X"}, {"source": "X"}, {"workplace_type": "X"}, {"tecnologia": "X"}, {"q": "x"}, {"limit": 0}, {"limit": 201}, {"offset": -1}):
        with pytest.raises(ValueError):
            Q.check_vocab(RULES, **wrong)


def test_streamed_import_equals_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    head = ",".join(SNAPSHOT_COLUMNS)
    line = lambda title, key, skills="": f'Data,,{title},c,gupy,,,Ontem,,"{skills}",1.5,,t,{key},"two\nlines, ""quoted"""'
    (folder / "vagas_20260731_000000.csv").write_text("\n".join([head, line("A", 1, "SQL"), line("B", 2)]) + "\n")
    run = lambda: stream_import(spark, str(folder), str(tmp_path / "versions"), str(tmp_path / "marks"), RULES).awaitTermination()
    run()
    # two files of one batch: the later name wins, though it was written first
    (folder / "vagas_20260802_000000.csv").write_text("\n".join([head, line("C2", 3)]) + "\n")
    (folder / "vagas_20260801_000000.csv").write_text("\n".join([head, line("A2", 1, "SQL"), line("C", 3)]) + "\n")
    run()
    table = VersionedTable(spark, str(tmp_path / "versions"))
    last = table.read(1)
    got = sorted((r.id, r.external_id, r.title, r.published_date, r.description) for r in last.collect())
    text = 'two\nlines, "quoted"'
    assert got == [(1, "1", "A2", dt.date(2026, 7, 31), text), (2, "2", "B", dt.date(2026, 7, 30), text), (3, "3", "C2", dt.date(2026, 8, 1), text)]
    # the last batch runs again, as after a failure before it was marked as done
    (tmp_path / "marks" / "commits" / "1").unlink()
    for crc in (tmp_path / "marks" / "commits").glob(".1.crc"):
        crc.unlink()
    before = sorted(map(str, last.collect()))
    run()
    assert table.latest() == 1
    assert sorted(map(str, VersionedTable(spark, table.root).read().collect())) == before


def test_skills_and_sorted_rows_are_worked_out_once(spark):
    made = spark.createDataFrame([(1, "b a"), (2, "a")], "ord long, text string").withColumns({c: F.lit("x") for c in SNAPSHOT_COLUMNS}).withColumn("skills", F.split(F.lower("text"), " "))
    told = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert told(R.skills_by_area(made, 3)).count("lower(") == 1
    assert "lower(" not in told(S.sorted_export(made)) and [r.skills for r in S.sorted_export(made).collect()] == ["b, a", "a"]
