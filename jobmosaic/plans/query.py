"""Read-only queries on the imported table: filters, pages, counts with the whole vocabulary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmosaic.functions.rules import PORTALS, WORKPLACE_ORDER, Rules
from jobmosaic.plans.rankings import percent


def check_vocab(rules: Rules, area: str | None = None, workplace_type: str | None = None, source: str | None = None, tecnologia: str | None = None, q: str | None = None, limit: int = 50, offset: int = 0) -> None:
    """Refuses what the vocabulary doesn't have, while the plan is made."""
    for name, value, known in (("area", area, rules.areas), ("workplace_type", workplace_type, WORKPLACE_ORDER), ("source", source, PORTALS)):
        if value is not None and value not in known:
            raise ValueError(f"{name}: {value!r} isn't one of {known}")
    if tecnologia is not None and tecnologia.lower() not in {n.lower() for n, _, _ in rules.skills}:
        raise ValueError(f"tecnologia: {tecnologia!r} isn't known")
    if q is not None and not 2 <= len(q) <= 100:
        raise ValueError("q takes 2 to 100 characters")
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200 and offset 0 or more")


def vagas_with_tech(vagas: DataFrame, links: DataFrame, tecnologias: DataFrame, tecnologia: str) -> DataFrame:
    """Postings that have a technology (in any case)."""
    wanted = tecnologias.filter(F.lower("nome") == tecnologia.lower()).select(F.col("id").alias("tecnologia_id"))
    having = links.join(F.broadcast(wanted), "tecnologia_id").select(F.col("vaga_id").alias("id"))  # names are unique: one row
    return vagas.join(having, "id", "left_semi")


def list_vagas(vagas: DataFrame, rules: Rules, area: str | None = None, workplace_type: str | None = None, source: str | None = None, tecnologia: str | None = None, q: str | None = None) -> DataFrame:
    """All filters together; q is looked for in the title in any case, with % and _ as wildcards; a backslash is itself."""
    check_vocab(rules, area, workplace_type, source, tecnologia, q)
    for name, value in (("area", area), ("workplace_type", workplace_type), ("source", source)):
        if value is not None:
            vagas = vagas.filter(F.col(name) == value)
    if q is not None:
        literal = q.replace("\\", "\\\\")
        vagas = vagas.filter(F.col("title").ilike(f"%{literal}%"))
    if tecnologia is not None:
        vagas = vagas.filter(F.exists("skills", lambda s: F.lower(s) == tecnologia.lower()))
    return vagas


def page_vagas(vagas: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """The newest first, those without a date last, then by id."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200 and offset 0 or more")
    return vagas.orderBy(F.col("published_date").desc_nulls_last(), "id").offset(offset).limit(limit)


@dataclass
class Page:
    """total: one row, how many postings the filters let through; vagas: the page of them that was asked for."""

    total: DataFrame
    vagas: DataFrame


def list_page(vagas: DataFrame, rules: Rules, limit: int = 50, offset: int = 0, **filters: str | None) -> Page:
    """What the listing answers: filters as in list_vagas. The filters go down to the scan of the table for both parts."""
    found = list_vagas(vagas, rules, **filters)
    return Page(filtered_total(found), page_vagas(found, limit, offset))


def vaga_resumo(vagas: DataFrame) -> DataFrame:
    return vagas.drop("description").withColumn("skills", F.array_sort("skills"))


def get_vaga(vagas: DataFrame, vaga_id: int) -> DataFrame:
    return vagas.filter(F.col("id") == vaga_id)


def by_name(table: DataFrame, column: str, name: str) -> DataFrame:
    return table.filter(F.lower(column) == name.lower())


def area_counts(vagas: DataFrame, rules: Rules) -> DataFrame:
    """(nome, vagas, percentual): every area of the vocabulary, with 0 too, and areas that only the data have."""
    vocabulary = vagas.sparkSession.createDataFrame([(a,) for a in rules.areas], "nome string")
    counts = vagas.groupBy(F.col("area").alias("nome")).agg(F.count(F.lit(1)).alias("vagas"))
    total = vagas.agg(F.count(F.lit(1)).alias("total"))
    full = counts.join(vocabulary, "nome", "full").withColumn("vagas", F.coalesce("vagas", F.lit(0).cast("long")))
    return full.crossJoin(F.broadcast(total)).select("nome", "vagas", percent(F.col("vagas"), F.col("total")).alias("percentual"))  # total: one row


def tech_counts(links: DataFrame, tecnologias: DataFrame) -> DataFrame:
    """(nome, grupo, vagas): every technology, with 0 too."""
    counts = links.groupBy(F.col("tecnologia_id").alias("id")).agg(F.count(F.lit(1)).alias("vagas"))
    return tecnologias.join(counts, "id", "left").select("nome", "grupo", F.coalesce("vagas", F.lit(0).cast("long")).alias("vagas"))


def vocab_sort(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("vagas"), "nome")


def tech_filters(counts: DataFrame, grupo: str | None = None, com_vagas: bool = False) -> DataFrame:
    if grupo is not None:
        counts = counts.filter(F.lower("grupo") == grupo.lower())
    return counts.filter("vagas > 0") if com_vagas else counts


def filtered_total(vagas: DataFrame) -> DataFrame:
    return vagas.agg(F.count(F.lit(1)).alias("total"))
