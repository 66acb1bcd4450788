from jobmosaic.functions.rules import Rules
from jobmosaic.functions.text import normalize, normalize_tech, strip_html
from jobmosaic.plans import pipeline as P
from jobmosaic.plans import rankings as R

RULES = Rules()


def test_kept_postings_are_counted_without_their_texts(spark):
    rows = [
        (0, "gupy", "1", "Desenvolvedor Júnior", "ACME", "java", "remote", "dev", ""),
        (1, "gupy", "2", "Analista Contábil Jr", "Techne", "banco de dados", "hybrid", "dev", ""),
        (2, "vagas", "3", "Analista Fiscal Jr", "FEI", "impostos", "remote", "dev", ""),
        (3, "vagas", "4", "Desenvolvedor Sênior", "FEI", "java", "remote", "dev", ""),
    ]
    raw = spark.createDataFrame(rows, "ord long, source string, external_id string, title string, company string, description string, raw_workplace string, search_term string, seniority string")
    s = P.run(raw, RULES)
    counts = R.counted(s.tech, "source")
    for counted in (counts, R.workplace_ranking(s.tech)):
        assert counted._jdf.queryExecution().optimizedPlan().toString().count("description") == 1  # among the columns of the input alone
    assert [tuple(r) for r in counts.collect()] == [("gupy", 2)]
    assert {r.ord for r in s.jobs.collect()} == {r.ord for r in s.tech.collect()} == {0, 1}
    assert {r.ord for r in s.other.collect()} == {2}
    assert {r.ord: r.skills for r in s.jobs.collect()} == {0: ["Java"], 1: []}


def test_folding_reads_white_space_of_any_kind(spark):
    white = [chr(c) for c in [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]
    rows = [(i, f"{w}<b>C#</b>{w}{w}e é{w} {w}&nbsp;SQL{w}&amp;{w}") for i, w in enumerate(white)]
    raw = spark.createDataFrame(rows, "ord long, description string").selectExpr("*", "'' as title", "'' as company")
    cleaned = P.clean(raw).select("description", "tech_body", "norm_body", strip_html("description").alias("again"), normalize_tech("description").alias("tech"), normalize("description").alias("norm"))
    assert all(r.description == r.again == "C# e é SQL &" and r.tech_body == r.tech == "c# e e sql" and r.norm_body == r.norm == "c e e sql" for r in cleaned.collect())
    only = P.clean(raw).select("norm_body")._jdf.queryExecution().optimizedPlan().toString()
    assert "3000" not in only and "3000" in P.clean(raw).select("description")._jdf.queryExecution().optimizedPlan().toString()
