"""One query for each operator, over postings adapted from the given tables. Arrays are given as joined strings, dates as text."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmosaic.functions import text as T
from jobmosaic.functions.dates import parse_published_date, reference_date
from jobmosaic.functions.folders import scratch
from jobmosaic.functions.rules import Rules
from jobmosaic.operators import areas as A
from jobmosaic.operators import dedupe as D
from jobmosaic.operators import levels as L
from jobmosaic.plans import pipeline as P
from jobmosaic.plans import query as Q
from jobmosaic.plans import rankings as R
from jobmosaic.plans import store as S
from jobmosaic.plans.adapter import REFERENCE, SNAPSHOT_FILES, jobs_raw, snapshot
from jobmosaic.plans.versions import VersionedTable
from jobmosaic.sources import portals as W
from jobmosaic.sources.landed import read_portal
from jobmosaic.sources.snapshots import SNAPSHOT_COLUMNS
from jobmosaic.streaming.imports import stream_import as start_import
from jobmosaic.streaming.keys import keep_source_keys, source_keys

RULES = Rules()
DAY = dt.date.fromisoformat(REFERENCE)
MOMENTS = [dt.datetime(2026, 8, 1), dt.datetime(2026, 8, 16)]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def on(maker: Callable[[SparkSession, str], DataFrame], **queries: Callable[[DataFrame], DataFrame]) -> None:
    """Queries that only differ in what they do with the rows of maker."""
    for name, f in queries.items():
        QUERIES[name] = lambda spark, sf_dir, f=f: f(maker(spark, sf_dir))


def joined(c: str, name: str | None = None):
    return F.concat_ws(", ", c).alias(name or c)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clean(D.first_of_term(jobs_raw(spark, sf_dir)))


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of which every second one has its whole text in the short fields too, so that these are as varied as texts are."""
    longer = lambda c: F.when(F.col("ord") % 2 == 1, F.concat(c, F.lit(" "), "description")).otherwise(F.col(c))
    return jobs_raw(spark, sf_dir).withColumns({c: longer(c) for c in ("title", "company", "search_term", "raw_workplace")})


def levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.entry_level(cleaned(spark, sf_dir), RULES)


def stages(spark: SparkSession, sf_dir: str) -> P.Stages:
    return P.run(jobs_raw(spark, sf_dir), RULES)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages(spark, sf_dir).jobs


def tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same postings, for what reads neither area nor skills."""
    return stages(spark, sf_dir).tech


# texts and fields
on(
    documents,
    squash_ws=lambda d: d.select("doc_id", F.md5(T.squash_ws("text")).alias("value")),
    normalize=lambda d: d.select("doc_id", F.md5(T.normalize("text")).alias("value")),
    normalize_tech=lambda d: d.select("doc_id", F.md5(T.normalize_tech("text")).alias("value")),
)
on(
    jobs_raw,
    source_key=lambda d: d.select("ord", T.source_key("source", "external_id").alias("value")),
    searchable_text=lambda d: d.select("ord", F.md5(T.searchable_text("title", "description")).alias("value")),
    parse_published_date=lambda d: d.select("ord", parse_published_date("published_date", DAY).cast("string").alias("value")),
    extract_skills=lambda d: d.select("ord", joined(A.extract_skills(T.normalize_tech(F.concat_ws(" ", "title", "description")), RULES), "skills")),
    term_first_seen=lambda d: D.first_of_term(d).select("ord", "source", "search_term", "external_id"),
    term_yield=lambda d: R.term_yield(D.first_of_term(d)),
)
on(
    worded,
    normalize_workplace=lambda d: d.select("ord", T.normalize_workplace("raw_workplace").alias("value")),
    fingerprint=lambda d: d.select("ord", T.fingerprint("title", "company").alias("value")),
    slugify_term=lambda d: d.select("ord", T.slugify_term("search_term").alias("value")),
    company_identity=lambda d: d.select("ord", F.array_join(T.company_identity("company"), " ").alias("value")),
    seniority_label=lambda d: d.select("ord", L.seniority_label(T.normalize("title"), RULES).alias("label"), L.seniority_label(T.normalize("title"), RULES, True).alias("strict")),
)
on(
    cleaned,
    entry_level=lambda d: L.entry_level(d, RULES).select("ord", "seniority"),
    entry_level_strict=lambda d: L.entry_level(d, RULES, True).select("ord", "seniority"),
    all_levels=lambda d: L.all_levels(d).select("ord", "seniority"),
    is_tech=lambda d: A.with_hits(d, RULES).select("ord", A.is_tech(RULES).alias("tech")),
    keyword_hits=lambda d: A.keyword_hits(A.with_hits(d, RULES), RULES),
    score_areas=lambda d: A.with_hits(d, RULES).select("ord", F.explode(A.score_areas(RULES)).alias("s")).select("ord", "s.area", "s.score", "s.title_score", joined("s.matches", "matches")),
    classify=lambda d: A.classify(A.with_scores(A.with_hits(d, RULES), RULES), RULES).select("ord", "area", "area_score", "area_matches"),
)
on(
    levelled,
    dedupe_source_key=lambda d: D.dedupe_source_key(d).select("ord", "first_ord", "source", "external_id", "search_term"),
    dedupe_fingerprint=lambda d: D.dedupe_fingerprint(D.dedupe_source_key(d)).select("ord", "first_ord", "search_term"),
    dedupe_full=lambda d: D.dedupe_full(d).select("ord", "first_ord", "rep_ord", "title_ord"),
    same_company_pairs=lambda d: D.same_company_pairs(d).select("ord_a", "ord_b"),
    same_company_classes=D.same_company_classes,
)


@query
def tech_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stages(spark, sf_dir)
    return s.tech.select("ord", F.lit("tech").alias("lado")).unionByName(s.other.select("ord", F.lit("nao_tech").alias("lado")))


@query
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(T.strip_html("html")).alias("value"))


# rankings of classified postings
on(
    jobs,
    pipeline_jobs=lambda d: d.select("ord", "source", "external_id", "seniority", "search_term", "area", "area_score", "area_matches", joined("skills"), "rep_ord", "title_ord"),
    area_ranking=R.area_ranking,
    rank_position=lambda d: R.ranked(R.counted(d, "area"), "area"),
    workplace_by_area=R.workplace_by_area,
    overall_skills=R.overall_skills,
    skills_by_area=R.skills_by_area,
    topn_per_group=lambda d: R.skills_by_area(d, 3),
    skill_base_by_area=R.skill_base_by_area,
    skill_share_by_area=R.skill_share_by_area,
    sample_per_area=R.sample_per_area,
    fallback_share_by_source=lambda d: R.fallback_share_by_source(d, RULES),
    best_area=lambda d: d.select("ord", "area", "area_score"),
    to_row=lambda d: S.to_row(d).select("source", "external_id", "area", "title", "skills", F.length("description").cast("long").alias("size")),
)
on(
    tech,
    workplace_ranking=R.workplace_ranking,
    seniority_counts=lambda d: R.counted(d, "seniority"),
    source_counts=lambda d: R.counted(d, "source"),
    top_companies=R.top_companies,
    workplace_informed_share=R.workplace_informed_share,
)


@query
def all_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ranking of one run of the pipeline, read from one table of sums: (ranking, posicao, grupo, nome, vagas, valor)."""
    r = R.rankings(jobs(spark, sf_dir), RULES)
    none, told = F.lit(None), {}
    told["area_ranking"] = (r.area_ranking(), "posicao", none, "area", "vagas", "percentual")
    told["workplace_ranking"] = (r.workplace_ranking(), "posicao", none, "modalidade", "vagas", "percentual")
    told["workplace_informed_share"] = (r.workplace_informed_share(), none, none, "modalidade", "vagas", "percentual_informado")
    told["workplace_by_area"] = (r.workplace_by_area(), "posicao", none, "area", "remoto", "hibrido")
    told["seniority_counts"] = (r.seniority_counts(), none, none, "seniority", "vagas", none)
    told["source_counts"] = (r.source_counts(), none, none, "source", "vagas", none)
    told["fallback_share_by_source"] = (r.fallback_share_by_source(), none, none, "source", "outros", "percentual")
    told["top_companies"] = (r.top_companies(), "posicao", none, "company", "vagas", none)
    told["overall_skills"] = (r.overall_skills(), "posicao", none, "tecnologia", "vagas", none)
    told["skills_by_area"] = (r.skills_by_area(), "posicao", "area", "tecnologia", "vagas", none)
    told["skill_base_by_area"] = (r.skill_base_by_area(), none, none, "area", "vagas", "base")
    told["skill_share_by_area"] = (r.skill_share_by_area(), "posicao", "area", "tecnologia", "vagas", "percentual")
    kinds = (("posicao", "long"), ("grupo", "string"), ("nome", "string"), ("vagas", "long"), ("valor", "double"))
    column = lambda c: F.col(c) if isinstance(c, str) else c
    parts = [df.select(F.lit(name).alias("ranking"), *[column(c).cast(kind).alias(n) for c, (n, kind) in zip(columns, kinds, strict=True)]) for name, (df, *columns) in told.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.funnel(jobs_raw(spark, sf_dir), RULES)


@query
def snapshot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = (P.run(jobs_raw(spark, sf_dir).filter(F.col("ord") % 3 != part), RULES).jobs for part in (0, 2))
    return R.snapshot_drift(now, before)


# exports: written, then read back
def _exported(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    path = scratch(df.sparkSession, name)
    S.write_csv(df, path)
    return S.read_csv(df.sparkSession, path, columns)


@query
def export_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _exported(S.to_row(jobs(spark, sf_dir)), "export-jobs", SNAPSHOT_COLUMNS)
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("source", "external_id", "area", "seniority", "title", "company", "skills", "area_matches", "search_term")]
    return back.select(*empty, F.col("area_score").cast("double").alias("area_score"), F.md5("description").alias("description"))


@query
def sorted_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row in a sorted export, read back file by file."""
    path = scratch(spark, "sorted-export")
    S.sorted_export(jobs(spark, sf_dir)).select("area", "title", "source", "external_id").write.parquet(path)
    back = spark.read.parquet(path)
    return back.withColumn("posicao", F.row_number().over(Window.partitionBy("area").orderBy(F.input_file_name(), F.monotonically_increasing_id())).cast("long")).select("area", "posicao", "title")


@query
def export_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _exported(R.area_ranking(jobs(spark, sf_dir)), "export-ranking", ["posicao", "area", "vagas", "percentual"])
    return back.select(F.col("posicao").cast("long"), "area", F.col("vagas").cast("long"), F.col("percentual").cast("double"))


@query
def export_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _exported(R.skills_by_area(jobs(spark, sf_dir), 15).orderBy("area", "posicao"), "export-skills", ["area", "posicao", "tecnologia", "vagas"])
    return back.select("area", F.col("posicao").cast("long"), "tecnologia", F.col("vagas").cast("long"))


# snapshots, import and the imported table
def landed_snapshots(spark: SparkSession, sf_dir: str, *parts: int) -> str:
    """A folder with these snapshots as CSV, each a folder of parts in order of arrival. Some titles hold line ends and quotes."""
    path = scratch(spark, "snapshots")
    for part in parts or range(len(SNAPSHOT_FILES)):
        rows = snapshot(spark, sf_dir, part).repartitionByRange("ord").sortWithinPartitions("ord").withColumn("description", F.when(F.col("ord") % 19 == 3, F.concat(F.lit('"a\n'), "description", F.lit('\n\n"b, c'))).otherwise(F.col("description")))
        S.write_csv(rows.select(*SNAPSHOT_COLUMNS), f"{path}/{SNAPSHOT_FILES[part]}")
    return path


_told = ("source", "external_id", "title", "area", "skills", "area_score", "published_date", "url")


def _as_read(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in _told], F.md5(F.coalesce("description", F.lit(""))).alias("description"), "file_name")


@query
def read_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_read(S.read_snapshot(spark, landed_snapshots(spark, sf_dir)))


@query
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_read(S.read_latest(spark, landed_snapshots(spark, sf_dir)))


@query
def import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both snapshots as CSV files, merged one after the other into a table of buckets; what its last version holds."""
    path = landed_snapshots(spark, sf_dir)
    table = VersionedTable(spark, scratch(spark, "table"))
    for name, moment in zip(SNAPSHOT_FILES, MOMENTS, strict=True):
        table.merge(S.incoming(S.read_snapshot(spark, f"{path}/{name}"), RULES), moment)
    return _imported(table.read())


@query
def search_vagas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with wildcards in the table of buckets, by its index."""
    table = VersionedTable(spark, scratch(spark, "table"), buckets=16)
    for part, moment in enumerate(MOMENTS):
        table.merge(S.incoming(snapshot(spark, sf_dir, part), RULES), moment)
    return _slim(table.search(RULES, "mobile%j_nior", source="gupy"))


def _imported(d: DataFrame) -> DataFrame:
    return d.select("id", "source", "external_id", "title", "company", "area", "location", F.col("published_date").cast("string").alias("published_date"), "area_score", joined("skills"), F.md5("description").alias("description"))


def both_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir, 0).unionByName(snapshot(spark, sf_dir, 1))


on(
    both_snapshots,
    reference_date=lambda d: d.select("ord", "file_name", reference_date(F.col("file_name"), F.col("file_time")).cast("string").alias("value"), reference_date(F.col("file_name"), F.col("file_time"), DAY).cast("string").alias("given")),
    float_or_null=lambda d: d.select("ord", "file_name", S.float_or_null("area_score").alias("value")),
    blank_to_null=lambda d: d.select("ord", "file_name", S.blank_to_null("area").alias("area"), S.blank_to_null("company").alias("company"), S.blank_to_null("seniority").alias("seniority")),
    parse_skills_list=lambda d: d.select("ord", "file_name", joined(S.parse_skills_list("skills", RULES), "value")),
)


def imported(spark: SparkSession, sf_dir: str) -> S.Imported:
    first = S.upsert_vagas(None, S.incoming(snapshot(spark, sf_dir, 0), RULES), MOMENTS[0])
    return S.upsert_vagas(first.vagas, S.incoming(snapshot(spark, sf_dir, 1), RULES), MOMENTS[1])


@query
def stream_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, as files come: each snapshot, then the second one again. What the last version holds."""
    path = scratch(spark, "stream")
    for batch, part in enumerate((0, 1, 1)):
        rows = snapshot(spark, sf_dir, part).repartitionByRange("ord").sortWithinPartitions("ord")
        S.write_csv(rows.select(*SNAPSHOT_COLUMNS), f"{path}/in/{batch}/{SNAPSHOT_FILES[part]}")
        start_import(spark, f"{path}/in", f"{path}/table", f"{path}/marks", RULES).awaitTermination()
    return _imported(VersionedTable(spark, f"{path}/table").read(2))


@query
def stream_source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings in three batches that don't follow their order; the row that stays of each key after the last one."""
    path = scratch(spark, "stream-keys")
    for batch in (2, 0, 1):
        jobs_raw(spark, sf_dir).filter(F.col("ord") % 3 == batch).write.parquet(f"{path}/in/{batch}")
        raw = spark.readStream.schema(jobs_raw(spark, sf_dir).schema).option("recursiveFileLookup", True).parquet(f"{path}/in")
        keep_source_keys(raw, f"{path}/changes", f"{path}/marks", RULES).awaitTermination()
    return source_keys(spark, f"{path}/changes").select("ord", "first_ord", "source", "external_id", "search_term")


def vagas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imported(spark, sf_dir).vagas


@query
def upsert_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imported(spark, sf_dir).counters


def tecnologias(spark: SparkSession) -> DataFrame:
    return S.seed_tecnologias(None, RULES, spark)


@query
def seed_tecnologias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds a table that has some technologies of the snapshot already, one in a wrong group, and one that no rule knows."""
    old = vagas(spark, sf_dir).select(F.explode("skills").alias("nome")).distinct()
    old = old.select(F.rank().over(Window.orderBy("nome")).cast("long").alias("id"), "nome", F.lit("velho").alias("grupo"))
    unknown = spark.range(1).select(F.lit(900).cast("long").alias("id"), F.lit("COBOL").alias("nome"), F.lit("velho").alias("grupo"))
    return S.seed_tecnologias(old.unionByName(unknown), RULES, spark)


@query
def link_tecnologias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.link_tecnologias(vagas(spark, sf_dir), tecnologias(spark))


def counts_of_tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.tech_counts(link_tecnologias(spark, sf_dir), tecnologias(spark))


@query
def vagas_with_tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vagas(spark, sf_dir)
    return Q.vagas_with_tech(v, S.link_tecnologias(v, tecnologias(spark)), tecnologias(spark), "sql").select("id", "external_id")


_slim = lambda d: d.select("id", "source", "external_id", "title", F.col("published_date").cast("string").alias("published_date"))
on(
    vagas,
    upsert_vagas=lambda d: d.select("id", "source", "external_id", "title", "company", "area", "seniority", "location", "workplace_type", F.col("published_date").cast("string").alias("published_date"), "url", "area_score", "search_term", joined("skills"), F.col("created_at").cast("string").alias("created_at"), F.col("updated_at").cast("string").alias("updated_at")),
    list_vagas=lambda d: _slim(Q.list_vagas(d, RULES, area="Data", source="gupy", q="jr")),
    check_vocab=lambda d: _slim(Q.list_vagas(d, RULES, tecnologia="PYTHON", q="des_nv%")),
    page_vagas=lambda d: _slim(Q.page_vagas(d, 50, 10)),
    list_page=lambda d: (lambda p: _slim(p.vagas).crossJoin(p.total))(Q.list_page(d, RULES, 20, 5, q="jr")),  # total: one row
    filtered_total=lambda d: Q.filtered_total(Q.list_vagas(d, RULES, area="Backend")),
    table_health=lambda d: Q.filtered_total(d),
    get_vaga=lambda d: _slim(Q.get_vaga(d, 7)),
    vaga_resumo=lambda d: Q.vaga_resumo(d).select("id", "title", "company", "area", "url", joined("skills")),
    area_counts_vocab=lambda d: Q.area_counts(d, RULES),
    count_by_area=lambda d: Q.vocab_sort(Q.area_counts(d, RULES)),
    get_area=lambda d: Q.by_name(Q.area_counts(d, RULES), "nome", "data"),
)
on(
    counts_of_tech,
    tech_counts_vocab=lambda d: d,
    count_by_tecnologia=Q.vocab_sort,
    vocab_sort=lambda d: Q.vocab_sort(d).limit(10),
    get_tecnologia=lambda d: Q.by_name(d, "nome", "PYTHON"),
    tech_filters=lambda d: Q.tech_filters(d, "Linguagens", True),
)


# landed records and pages: each page of the pages table is a posting, with its own title, links, text and address
def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("page_id IS NOT NULL")
    own = pages.selectExpr("page_id AS i", "coalesce(url, '') AS own_url", "coalesce(html, '') AS own_html", "CASE page_id % 2 WHEN 0 THEN 'estagio ti' ELSE 'qa junior' END AS term", "page_id div 20 AS page", "page_id % 20 AS pos")
    return own.withColumn("own_title", F.regexp_extract("own_html", "<title>([^<]*)", 1))


def _marked(text: str) -> str:
    """A text as it stands in a page, between tags or quotes."""
    return f"""replace(replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


def _some(record: str) -> str:
    """Ids as numbers and as strings, and some records that are cut off."""
    either = f"if(i % 7 = 3, {record.replace('{id}', 'CAST(i AS STRING)')}, {record.replace('{id}', 'i')})"
    return f"if(i % 17 = 9, substr({either}, 1, 40), {either})"


def _deep(html: str) -> str:
    """Some pages are nested thousands deep, some are empty, and some close what they never opened."""
    return f"CASE WHEN i % 23 = 6 THEN '' WHEN i % 19 = 4 THEN concat(repeat('<div>', 3000), {html}) WHEN i % 19 = 5 THEN concat('</ul></div>', {html}, '<p') ELSE {html} END"


def gupy_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = """to_json(named_struct('id', if(i % 11 = 5, null, {id}), 'name', if(i % 13 = 7, '', concat('Vaga ', i, ' ', own_title)), 'careerPageName', concat('Empresa ', i % 5), 'careerPageUrl', 'https://c.example', 'jobUrl', if(i % 2 = 0, own_url, null),
      'description', own_html, 'publishedDate', '2026-07-20T10:00:00Z', 'isRemoteWork', i % 3 = 0, 'city', if(i % 4 = 0, ' ', concat(' Cidade  ', i % 7)), 'state', if(i % 4 < 2, '', 'SP'), 'country', ' Brasil ', 'workplaceType', if(i % 5 = 0, 'hybrid', null)))"""
    return _landed(spark, sf_dir).selectExpr("term", "page", "pos", f"{_some(record)} AS json")


def trampos_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = """to_json(named_struct('id', if(i % 11 = 5, null, {id}), 'name', if(i % 13 = 7, '  ', concat(' Vaga ', i, ' ', own_title)), 'type_name', if(i % 3 = 0, null, 'Tipo A'), 'type_slug', if(i % 2 = 0, 'estagio', 'clt'), 'category_name', own_url, 'home_office', if(i % 5 = 0, true, null), 'hybrid', i % 3 = 1,
      'salary', if(i % 4 = 0, 'Não divulgada', if(i % 4 = 1, '', 'R$ 2.000')), 'published_at', '2026-07-21T09:00:00-03:00', 'custom_company_name', if(i % 6 = 0, 'Própria', null), 'company', named_struct('name', concat('Casa ', i % 9, ' '), 'description', own_html),
      'email_share_url', if(i % 7 = 0, concat('https://t.example/o/', i, '/share/email'), null), 'whatsapp_share_url', if(i % 7 = 1, concat('https://w.example/o/', i, '/share/w'), null)))"""
    return _landed(spark, sf_dir).selectExpr("term", "page", "pos", f"{_some(record)} AS json")


def vagas_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = f"""concat('<ul><li class="vaga odd "><h2><a class="link-detalhes-vaga" ', if(i % 11 = 5, '', concat('data-id-vaga="', i, '"')), if(i % 3 = 0, concat(' title="Vaga &amp; ', i, ' ', {_marked('own_title')}, '"'), ''), ' href="', if(i % 2 = 0, '', 'https://x.example'), '/vagas/v', i, '"><mark>Dev</mark> de  Software ', {_marked('own_title')}, '</a></h2>
      <span class="emprVaga"> Casa ', i % 9, ' </span><span class="nivelVaga">Pleno</span><div class="detalhes"><p>Texto: <b>a</b>', {_marked('own_html')}, '</p></div><div class="vaga-local"><i></i> ', if(i % 4 = 0, '100% Home Office', 'Rio / RJ'), ' </div><span class="data-publicacao"><i></i>09/07/2026</span></li><li class="outra">x</li></ul>')"""
    return _landed(spark, sf_dir).selectExpr("term", "i AS page", f"{_deep(html)} AS html")


def programathor_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = f"""concat('<div class="wrapper-jobs-list"><a href="/jobs/', i, '-dev"><h3 class="x">', if(i % 5 = 2, '<span class="y color-red">Vencida</span> ', if(i % 5 = 3, '<span class="color-red">Nova</span>', '')), 'Programador ', i, ' ', {_marked('own_title')}, '</h3><div class="cell-list-content-icon"><span><i class="fa fa-briefcase"></i>Casa ', i % 9, '</span>
      <span><i class="fas fa-map-marker-alt"></i>', element_at(array('São Paulo  (Híbrido)', 'Remoto', 'Recife', ''), cast(i % 4 + 1 as int)), '</span>', if(i % 3 = 0, '<span><i class="far fa-money-bill-alt"></i>Até R$4.000</span>', ''), '<span><i class="far fa-chart-bar"></i>Júnior</span><span><i class="far fa-file-alt"></i>', if(i % 6 = 0, 'Estágio', 'PJ'), '</span></div>
      ', concat_ws(' ', transform(regexp_extract_all(own_html, '<li><a href="[^"]*">([^<]*)</a>', 1), x -> concat('<span class="tag-list z">', {_marked('x')}, '</span>'))), '</a><a href="/outro">y</a></div>')"""
    return _landed(spark, sf_dir).selectExpr("term", "i AS page", f"{_deep(html)} AS html")


def linkedin_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = f"""concat('<ul><li><div class="base-card job" data-entity-urn="', if(i % 11 = 5, 'urn:x', concat('urn:li:jobPosting:', i)), '"><a class="base-card__full-link" href="', {_marked('own_url')}, '?position=1&amp;pageNum=0"><span>s</span></a><h3 class="base-search-card__title">', if(i % 13 = 7, '', concat('Dev &lt;', i, '&gt; ', {_marked('own_title')})), '</h3>
      <h4 class="base-search-card__subtitle">Casa ', i % 9, '</h4><span class="job-search-card__location">', if(i % 4 = 0, 'Brasil (Remote)', 'São Paulo'), '</span><time datetime="2026-08-01T00">x</time></div></li></ul>')"""
    return _landed(spark, sf_dir).selectExpr("term", "i AS page", f"{_deep(html)} AS html")


_LANDED = {"gupy": gupy_landed, "trampos": trampos_landed, "vagas": vagas_landed, "programathor": programathor_landed, "linkedin": linkedin_landed}


@query
def gupy_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.gupy_json(gupy_landed(spark, sf_dir)).select(*W.RAW)


@query
def trampos_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.trampos_json(trampos_landed(spark, sf_dir)).select(*W.RAW)


@query
def vagas_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.vagas_cards(vagas_landed(spark, sf_dir)).select(*W.RAW)


@query
def programathor_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.programathor_cards(programathor_landed(spark, sf_dir)).select(*W.RAW)


@query
def linkedin_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.linkedin_cards(linkedin_landed(spark, sf_dir)).select(*W.RAW)


@query
def collect_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.collect_union({p: f(spark, sf_dir) for p, f in _LANDED.items()})


@query
def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from files: every portal's pages and records land in a folder of their own and are read by the portal's format."""
    postings = {}
    for portal, landed in _LANDED.items():
        folder = scratch(spark, f"landed-{portal}")
        landed(spark, sf_dir).write.parquet(folder)
        postings[portal] = read_portal(spark, portal, folder)
    return W.in_order(postings)
