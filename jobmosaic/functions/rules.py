"""Rules as data: areas and their keywords, the tech gate, seniority patterns, skills, vocabularies.

`Rules()` holds the default values; every part can be replaced, so a user edits rules by passing others.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property

# Results depend on exactly these words and on their order.
AREA_KEYWORDS = """
Data | alto | engenheiro de dados, engenharia de dados, data engineer, cientista de dados, data scientist, analista de dados, data analyst, business intelligence, analista de bi, etl, data warehouse, databricks, big data, pipeline de dados
Data | medio | dados, bi, sql, power bi, tableau, looker, airflow, spark, pyspark, hadoop, snowflake, redshift, bigquery, dbt, kafka, machine learning, aprendizado de maquina, estatistica, pandas, analytics, modelagem de dados, dataviz
Frontend | alto | front end, frontend, desenvolvedor front, front-end, desenvolvimento web front
Frontend | medio | react, reactjs, angular, vue, vuejs, svelte, next js, nextjs, html, css, sass, scss, tailwind, bootstrap, javascript, typescript, jquery, ui, interface do usuario, responsivo, figma, webpack, redux
Backend | alto | back end, backend, back-end, desenvolvedor back, desenvolvimento de apis
Backend | medio | api rest, apis, rest, microservicos, microsservicos, java, spring, spring boot, net, dotnet, c#, csharp, python, django, flask, fastapi, node, nodejs, php, laravel, ruby, rails, golang, go lang, kotlin, scala, servidor, banco de dados, postgresql, mysql, mongodb, oracle, abap, sap
Mobile | alto | mobile, android, ios, desenvolvedor android, desenvolvedor ios, aplicativos moveis, app mobile
Mobile | medio | flutter, react native, swift, swiftui, objective c, xamarin, kotlin multiplatform, play store, app store, aplicativo
DevOps | alto | devops, sre, site reliability, infraestrutura cloud, cloud engineer, plataforma cloud
DevOps | medio | aws, azure, gcp, google cloud, kubernetes, k8s, docker, container, terraform, ansible, jenkins, ci cd, pipeline, linux, infraestrutura, observabilidade, monitoramento, prometheus, grafana, cloudformation, openshift, helm, nginx
QA | alto | qa, quality assurance, analista de testes, engenheiro de qualidade, testes automatizados, automacao de testes, qualidade de software
QA | medio | teste, testes, tester, selenium, cypress, playwright, junit, pytest, jest, postman, casos de teste, regressao, bug, homologacao
Fullstack | alto | fullstack, full stack, full-stack, desenvolvedor full
Suporte/Infra | alto | suporte tecnico, help desk, helpdesk, service desk, analista de suporte, tecnico de suporte, suporte de ti, infraestrutura de ti, analista de redes
Suporte/Infra | medio | suporte, chamados, ticket, atendimento ao usuario, manutencao de computadores, hardware, windows server, active directory, redes, switch, roteador, telefonia, impressora
Segurança | alto | seguranca da informacao, cybersecurity, ciberseguranca, seguranca cibernetica, pentest, soc analyst, analista de seguranca, seguranca de redes
Segurança | medio | vulnerabilidade, firewall, siem, lgpd, iso 27001, criptografia
"""

# The tech gate.
GATE_TITLE = "ti, t i, tecnologia, tecnologia da informacao, sistemas, sistema, software, desenvolvimento, desenvolvedor, desenvolvedora, programador, programadora, programacao, developer, dev, computacao, informatica, engenharia de software, suporte tecnico, help desk, helpdesk, service desk, infraestrutura de ti, redes, servidores, banco de dados, tech, tester, web3, blockchain"
GATE_EXCLUDE = "pesquisa e desenvolvimento, desenvolvimento humano, desenvolvimento pessoal, desenvolvimento organizacional, desenvolvimento de negocios, desenvolvimento sustentavel, desenvolvimento infantil, desenvolvimento de produtos, desenvolvimento de novos produtos, desenvolvimento de materiais, desenvolvimento de embalagens, desenvolvimento de pessoas, treinamento e desenvolvimento, treinamento desenvolvimento, recursos humanos, programacao de gas, programacao de producao, programacao de manutencao, desenvolvimento de mercado, desenvolvimento comercial, tecnologia educacional, tecnologia de alimentos, tecnologia agricola, tecnologia textil, odontologia digital, marketing digital, seguranca do trabalho, tecnico em enfermagem, pedagogia, arquivologia, biomedicina, nutricao, fisioterapia, odontologia"
GATE_BODY = "desenvolvimento de software, desenvolvedor, desenvolvedora, programador, linguagem de programacao, engenharia de software, banco de dados, codigo fonte, tecnologia da informacao, suporte tecnico, help desk"

# Seniority labels with their patterns in order, and the patterns of higher levels.
SENIORITY = {
    "Júnior": [r"\bjunior\b", r"\bjr\b", r"\bjunior?es\b", r"\bnivel 1\b", r"\bentry level\b", r"\bi\b$"],
    "Estágio": [r"\bestagio\b", r"\bestagiario\b", r"\bestagiaria\b", r"\bintern\b", r"\binternship\b"],
    "Trainee": [r"\btrainee\b", r"\bprograma de trainee\b"],
    "Aprendiz": [r"\baprendiz\b", r"\bjovem aprendiz\b"],
}
SENIOR = [rf"\b{w}\b" for w in "senior, sr, pleno, pl, especialista, expert, tech lead, team lead, lider, coordenador, coordenadora, gerente, supervisor, head, arquiteto, principal, staff".split(", ")]

# Skills by group; aliases stand in brackets where they differ from the lower-case name.
SKILLS = """
linguagens | Python; Java; JavaScript [javascript, java script]; TypeScript [typescript, type script]; C# [c#, csharp, c sharp]; C++ [c++]; C [linguagem c]; PHP; Go [golang, go lang]; Ruby; Kotlin; Swift; Scala; R [linguagem r]; SQL; PL/SQL [pl sql, plsql]; ABAP; Shell/Bash [shell script, bash, powershell]; HTML [html, html5]; CSS [css, css3]
frameworks | React [react, reactjs, react js]; React Native; Angular [angular, angularjs]; Vue [vue, vuejs, vue js]; Node.js [node js, nodejs, node]; .NET [net, dotnet, asp net]; Spring [spring, spring boot]; Django; Flask; FastAPI [fastapi, fast api]; Laravel; CodeIgniter [codeigniter, code igniter]; JavaEE [javaee, java ee, j2ee, jakarta ee]; Flutter; jQuery; Bootstrap; Tailwind [tailwind, tailwindcss]
dados | Power BI [power bi, powerbi]; Excel [excel, planilhas]; Pandas; NumPy; Spark [spark, pyspark, apache spark]; Airflow [airflow, apache airflow]; ETL [etl, elt]; Tableau; Looker [looker, looker studio]; BigQuery [bigquery, big query]; Databricks; Snowflake; Redshift; dbt; Kafka [kafka, apache kafka]; Hadoop; Machine Learning [machine learning, aprendizado de maquina, ml]; Inteligência Artificial [inteligencia artificial, ia, artificial intelligence]; Agentes de IA [agentes de ia, ai agents, agentes autonomos]; LLM [llm, llms, large language model, genai, ia generativa]; Data Warehouse [data warehouse, datawarehouse, dw]; Estatística [estatistica]
bancos | PostgreSQL [postgresql, postgres]; MySQL; SQL Server [sql server, sqlserver, t sql]; Oracle; MongoDB [mongodb, mongo]; Redis; Firebase
cloud_devops | AWS [aws, amazon web services]; Azure [azure, microsoft azure]; GCP [gcp, google cloud]; Docker; Kubernetes [kubernetes, k8s]; Terraform; Ansible; Jenkins; CI/CD [ci cd, integracao continua]; Git [git, github, gitlab, versionamento]; Linux [linux, ubuntu, centos]; Nginx; Grafana; Prometheus
qa | Selenium; Cypress; Playwright; Postman; JUnit; Pytest; Jest; Testes Automatizados [testes automatizados, automacao de testes]; Testes Manuais [testes manuais, teste manual]; Testes Funcionais [testes funcionais, teste funcional]; Testes de Regressão [testes de regressao, teste de regressao]
suporte_infra | Windows Server; Active Directory [active directory, ad]; Windows; Redes/TCP-IP [tcp ip, redes de computadores, redes]; VPN; Firewall; ITIL; Service Desk [service desk, help desk, helpdesk]; Zendesk; Office 365 [office 365, o365, microsoft 365]; Hardware [hardware, manutencao de computadores]; VMware [vmware, virtualizacao]
praticas | API REST [api rest, rest, restful, apis rest]; Scrum; Metodologias Ágeis [metodologias ageis, agile, metodologia agil, kanban]; Microserviços [microservicos, microsservicos]; POO [poo, orientacao a objetos, programacao orientada a objetos]; Inglês [ingles, english]; Figma; UX/UI [ux, ui, ux ui]; LGPD; SAP; Salesforce
"""

# Work modes, and words that don't tell companies apart.
REMOTE, HYBRID, ON_SITE, NOT_TOLD = "Remoto", "Híbrido", "Presencial", "Não informado"
WORKPLACE_ORDER = [REMOTE, HYBRID, ON_SITE, NOT_TOLD]
WORKPLACE_EXACT = {"remote": REMOTE, "remoto": REMOTE, "home office": REMOTE, "hybrid": HYBRID, "hibrido": HYBRID, "on site": ON_SITE, "onsite": ON_SITE, "presencial": ON_SITE}
WORKPLACE_PARTS = [("home office", REMOTE), ("remoto", REMOTE), ("hibrid", HYBRID), ("presencial", ON_SITE)]
COMPANY_NOISE = "ltda sa eireli epp me mei inc llc corp group grupo company holding participacoes brasil brazil do da de dos das e em solucoes servicos sistemas tecnologia tecnologias informatica consultoria consultores associados confidencial empresa multinacional vagas".split()

# Portals in the order of a run, and the search terms.
PORTALS = ["gupy", "vagas", "programathor", "trampos", "linkedin"]
SEARCH_TERMS = ["desenvolvedor junior", "desenvolvedor jr", "programador junior", "analista de sistemas junior", "estagio desenvolvimento", "estagio ti", "estagio tecnologia", "trainee tecnologia", "engenheiro de dados junior", "analista de dados junior", "qa junior", "devops junior", "suporte tecnico junior"]

FALLBACK_AREA = "Outros/TI Geral"
NOT_FILTERED = "Não filtrado"


def plain(text: str, keep: str = "") -> str:
    """Lower-case ASCII letters and digits (and the characters of keep), one space for all else."""
    split = unicodedata.normalize("NFKD", text)
    base = "".join(c for c in split if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(f"[^a-z0-9{re.escape(keep)}]+", " ", base).split())


@dataclass(frozen=True)
class Keyword:
    area: str
    weight: float
    keyword: str
    phrase: str
    rank: int


def _keywords(weights: dict[str, float]) -> list[Keyword]:
    by_area: dict[str, list[tuple[str, str, float]]] = {}
    for row in AREA_KEYWORDS.strip().splitlines():
        area, tier, words = row.split(" | ")
        by_area.setdefault(area, []).extend((w, plain(w), weights[tier]) for w in words.split(", "))
    found = []
    for area, words in by_area.items():
        words.sort(key=lambda w: -len(w[1]))  # stable: equal lengths keep their order
        found += [Keyword(area, weight, word, phrase, rank) for rank, (word, phrase, weight) in enumerate(words)]
    return found


def _skills() -> list[tuple[str, str, list[str]]]:
    found = []
    for row in SKILLS.strip().splitlines():
        group, entries = row.split(" | ")
        for entry in entries.split("; "):
            name, _, aliases = entry.partition(" [")
            found.append((name, group, aliases[:-1].split(", ") if aliases else [name.lower()]))
    return found


@dataclass(frozen=True)
class Rules:
    """All rules of a run."""

    keywords: list[Keyword] = field(default_factory=lambda: _keywords({"alto": 4.0, "medio": 1.0}))
    gate_title: list[str] = field(default_factory=lambda: GATE_TITLE.split(", "))
    gate_exclude: list[str] = field(default_factory=lambda: GATE_EXCLUDE.split(", "))
    gate_body: list[str] = field(default_factory=lambda: GATE_BODY.split(", "))
    skills: list[tuple[str, str, list[str]]] = field(default_factory=_skills)
    seniority: dict[str, list[str]] = field(default_factory=lambda: SENIORITY)
    senior: list[str] = field(default_factory=lambda: SENIOR)
    title_boost: float = 3.0
    min_score: float = 3.0
    strong_weight: float = 4.0
    fallback: str = FALLBACK_AREA

    @cached_property
    def areas(self) -> list[str]:
        """Areas in rule order, the fallback last."""
        return [*dict.fromkeys(k.area for k in self.keywords), self.fallback]

    @cached_property
    def strong(self) -> list[str]:
        return list(dict.fromkeys(k.phrase for k in self.keywords if k.weight >= self.strong_weight))

    @cached_property
    def aliases(self) -> dict[str, str]:
        """Phrase to skill."""
        return {plain(a, "#+"): name for name, _, aliases in self.skills for a in aliases}
