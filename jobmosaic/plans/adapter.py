"""Raw postings from a table of documents, by integer arithmetic on the id and fixed lists.

The same expressions are written for Spark SQL and for the SQL of the tests' second engine, so that both start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobmosaic.functions.rules import PORTALS, SEARCH_TERMS

TITLES = [
    "Desenvolvedor Front-End Júnior", "Desenvolvedor React Jr", "Desenvolvedor Back-End Java Júnior", "Engenheiro de Dados Júnior", "Analista de Dados Jr.",
    "Estágio em Business Intelligence", "Desenvolvedor Mobile Flutter Júnior", "Desenvolvedor Android Jr", "Analista DevOps Júnior", "Estágio em Quality Assurance",
    "Analista de Testes Júnior", "Desenvolvedor Fullstack Júnior", "Estágio em Segurança da Informação", "Suporte Técnico Júnior", "Analista de Suporte Técnico Jr",
    "Programador Júnior/Pleno", "Jovem Aprendiz - Tecnologia", "Trainee de Tecnologia", "Estagiário de TI", "Analista Contábil Jr",
    "Analista Fiscal Júnior", "Jovem Aprendiz - Recepção", "Analista Administrativo I", "Estágio em Pesquisa e Desenvolvimento", "Analista de Desenvolvimento de Negócios Jr",
    "Técnico de Segurança do Trabalho Júnior", "Desenvolvedor Sênior", "Arquiteto de Software", "Tech Lead Back-End", "Gerente de Projetos",
    "Desenvolvedor I", "Assistente de Escritório Jr", "QA Tester Intern", "Desenvolvedor  C# / .NET\u00a0Jr", "Web3 Product Tester - Junior", "Analista de Sistemas Nível 1", "Especialista Kubernetes Jr",
]
COMPANIES = ["Minsait", "Minsait an Indra Company", "FEI", "Centro Universitário FEI", "ACME", "ACME Soluções em Tecnologia LTDA", "Techne", "Globoaves", "Wyntech", "Confidencial", ""]
TAILS = [
    "", "Conhecimento em Java, Spring Boot e SQL.", "Vivência com C#, .NET e C++.", "React Native ou React; Node.js e TypeScript.", "Banco de dados PostgreSQL, MySQL e Docker.",
    "Atuar com ETL, data warehouse e Power BI.", "Suporte técnico, help desk e redes.", "Testes automatizados com Selenium e Cypress.", "Inglês e Excel desejáveis.", "Front-end com HTML, CSS e JavaScript; full stack.",
    "Pipeline de dados com Airflow e Spark em AWS.", "Rotinas administrativas e atendimento.", "Kubernetes, CI/CD, Linux e Git.", "LGPD, firewall e segurança da informação.", "Linguagem C, Python & Django; api rest.", "Machine learning, agentes de IA e LLM.",
]
WORKPLACES = ["remote", "hybrid", "on-site", "Remoto", "100% Home Office", "Híbrido", "presencial", "", "100% remote", "Modelo híbrido flex", "a combinar"]
DATES = ["2026-06-26", "09/07/2026", "Hoje", "Ontem", "Anteontem", "Há 3 dias", "há 1 dia", "Há mais de 30 dias", "Há 2 meses", "", "2026-02-30", "qualquer coisa", "32/13/2026"]
REFERENCE = "2026-07-31"


def adapter_sql(dialect: str, table: str = "documents") -> str:
    """SELECT of jobs_raw for `spark` or `duckdb`."""
    quoted = lambda values: ", ".join("'" + v + "'" for v in values)  # noqa: E731  no value holds a quote
    pick = (lambda values, i: f"element_at(array({quoted(values)}), CAST({i} AS INT))") if dialect == "spark" else (lambda values, i: f"([{quoted(values)}])[{i}]")
    div = "div" if dialect == "spark" else "//"
    company = pick(COMPANIES, f"(i {div} 37) % 11 + 1")
    return f"""
SELECT i AS ord, {pick(PORTALS, "i % 5 + 1")} AS source,
  CAST(CASE WHEN i % 15 = 10 THEN i - 5 ELSE i END AS {"STRING" if dialect == "spark" else "VARCHAR"}) AS external_id,
  {pick(TITLES, "i % 37 + 1")} AS title,
  {company} || CASE WHEN (i {div} 37) % 11 < 9 THEN ' g' || lpad(CAST(i {div} 814 AS {"STRING" if dialect == "spark" else "VARCHAR"}), 6, '0') ELSE '' END AS company,
  'https://jobs.example/' || CAST(i AS {"STRING" if dialect == "spark" else "VARCHAR"}) AS url,
  coalesce(text, '') || ' ' || {pick(TAILS, "i % 16 + 1")} AS description,
  'Cidade ' || CAST(i % 7 AS {"STRING" if dialect == "spark" else "VARCHAR"}) AS location,
  {pick(WORKPLACES, "i % 11 + 1")} AS raw_workplace, {pick(DATES, "i % 13 + 1")} AS published_date,
  {pick(SEARCH_TERMS, "(CASE WHEN i % 30 = 10 THEN i - 5 ELSE i END) % 13 + 1")} AS search_term,
  CASE i % 29 WHEN 0 THEN 'Júnior' WHEN 1 THEN 'Estágio' ELSE '' END AS seniority
FROM (SELECT doc_id AS i, text FROM {table}) AS d"""


def jobs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id are no postings and are left out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id IS NOT NULL")
    return spark.sql(adapter_sql("spark", "{docs}"), docs=docs)


SNAPSHOT_AREAS = ["Data", "Backend", "", "Frontend", "Suporte/Infra", "QA", "DevOps"]
SNAPSHOT_SKILLS = ["Python, SQL", "sql,  React ,Cobol", "", "Java, java, Spring", "C#, .NET", " , inglês"]
SNAPSHOT_SCORES = ["12.0", "", "4.0", "abc", " 7.5 "]
SNAPSHOT_FILES = ["vagas_20260731_174407.csv", "vagas_20260815_090000.csv"]


def snapshot_sql(dialect: str, part: int, table: str = "documents") -> str:
    """SELECT of a snapshot's rows as strings: part 0 leaves out every third posting, part 1 others, with
    some places changed. A snapshot has 500 characters of a description, as exports have; some titles are blank or padded."""
    raw = f"({adapter_sql(dialect, table)}) AS r"
    pick = (lambda values, i: "element_at(array(" + ", ".join(f"'{v}'" for v in values) + f"), CAST({i} AS INT))") if dialect == "spark" else (lambda values, i: "([" + ", ".join(f"'{v}'" for v in values) + f"])[{i}]")
    moved = "location || CASE WHEN ord % 4 = 0 THEN ' nova' ELSE '' END" if part else "location"
    return f"""
SELECT ord, {pick(SNAPSHOT_AREAS, "ord % 7 + 1")} AS area, seniority, CASE WHEN ord % 41 = 40 THEN ' ' WHEN ord % 43 = 42 THEN chr(9) || chr(160) WHEN ord % 13 = 5 THEN chr(160) || title || chr(9) ELSE title END AS title, company, source, {moved} AS location, raw_workplace AS workplace_type,
  published_date, url, {pick(SNAPSHOT_SKILLS, "ord % 6 + 1")} AS skills, {pick(SNAPSHOT_SCORES, "ord % 5 + 1")} AS area_score, '' AS area_matches, search_term, external_id, substr(description, 1, 500) AS description
FROM {raw} WHERE ord % 3 <> {2 if part == 0 else 0}"""


def snapshot(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id IS NOT NULL")
    rows = spark.sql(snapshot_sql("spark", part, "{docs}"), docs=docs)
    return rows.selectExpr("*", f"'{SNAPSHOT_FILES[part]}' AS file_name", "current_timestamp() AS file_time")
