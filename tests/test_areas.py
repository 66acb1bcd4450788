import random
import re

import pytest
from pyspark.sql import functions as F

from jobmosaic.functions.rules import Rules, plain
from jobmosaic.functions.text import normalize, normalize_tech
from jobmosaic.operators import areas as A
from jobmosaic.operators.levels import all_levels, entry_level, seniority_label

RULES = Rules()


def model(title, body):
    """Scores by regular expressions over whole texts, as the rules are stated."""
    out = {}
    title, body = plain(title), plain(body)
    for area in RULES.areas[:-1]:
        used = {"t": [], "b": []}
        score = from_title = 0.0
        names = []
        for k in [k for k in RULES.keywords if k.area == area]:
            for where, text in (("t", title), ("b", body)):
                spans = [m.span() for m in re.finditer(rf"(?<![a-z0-9]){re.escape(k.phrase)}(?![a-z0-9])", text)]
                free = next((s for s in spans if not any(a <= s[0] and s[1] <= b for a, b in used[where])), None)
                if free:
                    used[where].append(free)
                    gain = k.weight * (3 if where == "t" else 1)
                    score, from_title = score + gain, from_title + (gain if where == "t" else 0)
                    names.append(k.keyword + ("(t)" if where == "t" else ""))
                    break
        if score:
            out[area] = (score, from_title, names)
    return out


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(rows)], "ord long, title string, description string")
    return A.with_hits(df.withColumns({"norm_title": normalize("title"), "norm_body": normalize("description")}), RULES)


def test_scores_against_model(spark):
    rng = random.Random(3)
    parts = [k.keyword for k in RULES.keywords if k.area in ("Suporte/Infra", "Frontend", "Backend", "QA", "DevOps")] + ["de", "suporte", "tecnico", "analista", "x", "front-end", "c"]
    rows = [(" ".join(rng.choice(parts) for _ in range(rng.randrange(6))), " ".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for _ in range(300)]
    rows += [("", ""), (None, None), ("Suporte Técnico Júnior", ""), ("Analista de Suporte Técnico Jr", "")]
    got = {r.ord: {s.area: (s.score, s.title_score, s.matches) for s in r.scores} for r in A.with_scores(frame(spark, rows), RULES).collect()}
    assert all(got[i] == model(t or "", b or "") for i, (t, b) in enumerate(rows))
    assert got[len(rows) - 2]["Suporte/Infra"][0] == 12.0 and got[len(rows) - 1]["Suporte/Infra"][0] == 24.0


CLASSES = [
    ("Desenvolvedor Front-End Júnior", "", "Frontend"), ("Desenvolvedor React Jr", "", "Frontend"), ("Desenvolvedor Back-End Java Júnior", "", "Backend"), ("Engenheiro de Dados Júnior", "", "Data"), ("Analista de Dados Jr", "", "Data"),
    ("Estágio em Business Intelligence", "", "Data"), ("Desenvolvedor Mobile Flutter Júnior", "", "Mobile"), ("Desenvolvedor Android Jr", "", "Mobile"), ("Analista DevOps Júnior", "", "DevOps"), ("Estágio em Quality Assurance", "", "QA"),
    ("Analista de Testes Júnior", "", "QA"), ("Desenvolvedor Fullstack Júnior", "", "Fullstack"), ("Estágio em Segurança da Informação", "", "Segurança"),
    ("Desenvolvedor Front-End Júnior", "Nosso ambiente roda em AWS com Kubernetes e Docker.", "Frontend"), ("Desenvolvedor Júnior", "Vaga para atuar com pipelines de ETL, SQL, Airflow e data warehouse.", "Data"),
    ("Estágio em desenvolvimento Android - Kotlin/Java", "Trabalhamos com SQL, dados e relatorios de BI no dia a dia.", "Mobile"), ("Estagiário de Escritório em TI", "Organizar dados.", RULES.fallback), ("Jovem Aprendiz Administrativo", "", RULES.fallback),
]


def test_classify_goldens(spark):
    found = A.classify(A.with_scores(frame(spark, [c[:2] for c in CLASSES]), RULES), RULES).orderBy("ord").collect()
    assert [r.area for r in found] == [c[2] for c in CLASSES]
    assert found[-1].area_score == 0.0 and found[-1].area_matches == "" and "engenheiro de dados" in found[3].area_matches


@pytest.mark.parametrize("tech,titles", [
    (False, ["Analista Contábil Jr", "Analista Fiscal Júnior", "Analista Comercial Jr", "Jovem Aprendiz - Recepção", "Analista Administrativo I", "Estágio Syngenta 2026 - Holambra | Pesquisa e Desenvolvimento", "Estágio em Odontologia Digital", "Analista de Desenvolvimento de Negócios Jr", "Técnico de Segurança do Trabalho Júnior"]),
    (True, ["Desenvolvedor I", "Estagiário de TI", "Web3 Product Tester - Junior", "Analista DevOps", "QA Tester Intern"]),
])
def test_gate(spark, tech, titles):
    assert all(r.tech is tech for r in frame(spark, [(t, "") for t in titles]).select(A.is_tech(RULES).alias("tech")).collect())


def test_gate_reads_the_body(spark):
    rows = [("Analista Jr", "Experiência com banco de dados"), ("Analista Jr", "sistemas e aplicação"), ("Analista Jr", "devops"), ("Estágio em Pedagogia", "banco de dados")]
    assert [r.tech for r in frame(spark, rows).orderBy("ord").select(A.is_tech(RULES).alias("tech")).collect()] == [True, False, True, False]


def test_skills(spark):
    rows = ["C# e SQL; .NET", "letra c", "JavaScript em Goiânia", "React Native", "Inglês, R, linguagem R, CSS3", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(A.extract_skills(normalize_tech("t"), RULES)).collect()]
    assert got == [[".NET", "C#", "SQL"], [], ["JavaScript"], ["React", "React Native"], ["CSS", "Inglês", "R"], []]


def test_levels(spark):
    rows = [("Dev Jr.", ""), ("Dev Júnior", ""), ("Estagiário", ""), ("Trainee", ""), ("Jovem Aprendiz", ""), ("Desenvolvedor I", ""), ("Tech Lead", ""), ("Sênior", ""), ("Dev Júnior/Pleno", ""), ("Programador", "Júnior"), (None, None)]
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "ord int, title string, seniority string").withColumn("norm_title", normalize("title"))
    label = [r[0] for r in df.orderBy("ord").select(seniority_label(F.col("norm_title"), RULES)).collect()]
    assert label == ["Júnior", "Júnior", "Estágio", "Trainee", "Aprendiz", "Júnior", None, None, "Júnior", None, None]
    assert sorted(r.ord for r in entry_level(df, RULES).collect()) == [0, 1, 2, 3, 4, 5, 8, 9]
    assert sorted(r.ord for r in entry_level(df, RULES, strict=True).collect()) == [0, 1, 2, 3, 4, 5, 9]
    assert all_levels(df).filter("seniority = 'Não filtrado'").count() == 10


def test_scores_are_left_out_where_nothing_reads_them(spark):
    jobs = A.classify(A.with_scores(frame(spark, [("Dev", "sql")]).withColumn("source", F.lit("p")), RULES), RULES)
    told = lambda *columns: jobs.select(*columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "title_score" not in told("source") and "title_score" in told("area")


def test_parts_of_keywords_are_looked_for_further_on(spark):
    rows = [("", "banco de dados dados"), ("", "dados dados banco de dados"), ("sql sql server", "sql"), ("front end front-end", "front end")]
    got = {r.ord: {s.area: (s.score, s.title_score, s.matches) for s in r.scores} for r in A.with_scores(frame(spark, rows), RULES).collect()}
    assert all(got[i] == model(t, b) for i, (t, b) in enumerate(rows))


def test_gate_of_texts_reads_the_body_where_the_title_does_not_decide(spark):
    rows = [("Analista Jr", "Experiência com banco de dados"), ("Analista Jr", "sistemas e aplicação"), ("Analista Jr", "devops"), ("Estágio em Pedagogia", "banco de dados"), ("Desenvolvedor I", ""), (None, None)]
    df = frame(spark, rows)
    assert all(r.gate is r.tech for r in df.select(A.gate("norm_title", normalize("description"), RULES).alias("gate"), A.is_tech(RULES).alias("tech")).collect())
    unread = F.raise_error(F.lit("the body is read")).cast("string")
    assert [r[0] for r in df.filter("ord > 2 and ord < 5").orderBy("ord").select(A.gate("norm_title", unread, RULES)).collect()] == [False, True]


def test_places_are_looked_for_where_keywords_meet_in_one_text(spark):
    rows = [("dados", "banco de dados"), ("banco de dados", "dados"), ("react native react", "react"), ("react", "react native"), ("suporte", "suporte tecnico suporte redes")]
    scored = A.with_scores(frame(spark, rows), RULES)
    got = {r.ord: {s.area: (s.score, s.title_score, s.matches) for s in r.scores} for r in scored.collect()}
    assert all(got[i] == model(t, b) for i, (t, b) in enumerate(rows))
    assert "locate(" not in scored._jdf.queryExecution().optimizedPlan().toString()
