import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["parse_published_date", "score_areas", "dedupe_full", "funnel", "pipeline_jobs", "skill_share_by_area", "upsert_vagas", "seed_tecnologias", "collect_union", "programathor_cards", "strip_html", "export_ranking", "all_rankings", "read_snapshot", "latest_snapshot", "import_files", "stream_import", "stream_source_keys", "search_vagas", "same_company_classes", "landed_files", "fingerprint", "seniority_label"]


def told(rows):
    return sorted(tuple("" if x is None else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql_agree(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert told(df.select(*columns).collect()) == told(want.fetchall())


def test_every_query_has_sql():
    missing = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"} - set(entry.oracle_sql())
    assert not missing


def test_entry(spark):
    assert entry.entry(spark).columns == ["posicao", "area", "vagas", "percentual"]
