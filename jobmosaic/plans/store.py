"""Snapshots of postings: export, reading back, idempotent import, technologies and their links."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmosaic.functions.dates import parse_published_date, reference_date
from jobmosaic.functions.joins import kept
from jobmosaic.functions.rules import FALLBACK_AREA, Rules
from jobmosaic.functions.text import mapping, strip_ws
from jobmosaic.sources.snapshots import SNAPSHOT_COLUMNS, latest_file, read_csv_rows

#: Columns of the table that a change of which counts as an update.
COMPARED = ["title", "company", "area", "seniority", "location", "workplace_type", "published_date", "url", "description", "area_score", "area_matches", "search_term"]


def to_row(jobs: DataFrame, *more: str) -> DataFrame:
    """The columns of a snapshot (and more): the description cut to 500 characters, skills joined."""
    shaped = jobs.withColumns({"description": F.substring("description", 1, 500), "skills": F.concat_ws(", ", "skills")})
    return shaped.select(*SNAPSHOT_COLUMNS, *more)


def sorted_export(jobs: DataFrame) -> DataFrame:
    """The rows of a snapshot in order. A sort reads its rows twice, first to cut them into ranges, so they are written before it."""
    rows = kept(to_row(jobs, "ord"), "sorted-rows")
    return rows.orderBy("area", "title", "ord").drop("ord")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def known_rows(rows: DataFrame) -> DataFrame:
    """Rows with a source, an external id and a title."""
    filled = lambda c: strip_ws(F.coalesce(F.col(c), F.lit(""))) != ""
    return rows.filter(filled("source") & filled("external_id") & filled("title"))


def read_snapshot(spark: SparkSession, *paths: str) -> DataFrame:
    """A snapshot's rows as strings, in file order (ord), with the name and last change of their file. Large files are read in
    blocks side by side; a folder of parts named like a snapshot is one."""
    return known_rows(read_csv_rows(spark, SNAPSHOT_COLUMNS, *paths))


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the snapshot whose name comes last; the others aren't opened."""
    path = latest_file(spark, folder)
    if path is None:
        raise FileNotFoundError(f"{folder} has no vagas_*.csv")
    return read_snapshot(spark, path)


def latest_snapshot(rows: DataFrame) -> DataFrame:
    """Rows of the file whose name comes last."""
    last = rows.agg(F.max("file_name").alias("last"))
    return rows.join(F.broadcast(last), F.col("file_name") == F.col("last")).drop("last")  # one row


def blank_to_null(c: str) -> Column:
    return F.nullif(strip_ws(F.coalesce(F.col(c), F.lit(""))), F.lit(""))


def float_or_null(c: str) -> Column:
    return blank_to_null(c).try_cast("double")


def parse_skills_list(c: Column | str, rules: Rules) -> Column:
    """Names of a comma list that are known (in any case), spelled as known, each once, sorted."""
    c = F.col(c) if isinstance(c, str) else c
    known = mapping({name.lower(): name for name, _, _ in rules.skills})
    names = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda s: F.try_element_at(known, F.lower(strip_ws(s))))
    return F.array_sort(F.array_distinct(F.filter(names, lambda s: s.isNotNull())))


def incoming(snapshot: DataFrame, rules: Rules, reference: dt.date | None = None) -> DataFrame:
    """A snapshot's rows as rows of the table: blanks are null, dates and scores are parsed. Needs ord, file_name and file_time."""
    day = reference_date(F.col("file_name"), F.col("file_time"), reference)
    text = ["company", "seniority", "location", "url", "description", "area_matches", "search_term"]
    return known_rows(snapshot).select(
        "ord", strip_ws("source").alias("source"), strip_ws("external_id").alias("external_id"), strip_ws("title").alias("title"),
        F.coalesce(blank_to_null("area"), F.lit(FALLBACK_AREA)).alias("area"), *[blank_to_null(c).alias(c) for c in text],
        blank_to_null("workplace_type").alias("workplace_type"), parse_published_date("published_date", day).alias("published_date"),
        float_or_null("area_score").alias("area_score"), parse_skills_list("skills", rules).alias("skills"),
    )


def numbered(rows: DataFrame, order: str, start: int) -> DataFrame:
    """id = start + 1, start + 2 ... in the order of a column. Sampled ranges of it are numbered side by side: they are
    written with the number of their range, and only the ranges' sizes, one row each, are summed in one task."""
    ranged = kept(rows.repartitionByRange(F.col(order)).withColumn("__range", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    offsets = sizes.select(F.col("__range").alias("__of"), (F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return ranged.join(offsets, F.col("__range") == F.col("__of")).withColumn("id", F.lit(start) + F.col("__offset") + inside).drop("__range", "__of", "__offset")


@dataclass
class Imported:
    vagas: DataFrame
    counters: DataFrame


def upsert_vagas(table: DataFrame | None, rows: DataFrame, now: dt.datetime, top: int | None = None, was: int | None = None) -> Imported:
    """Merges incoming rows into the table by (source, external_id); table is None to start anew.

    Of rows with one key the last wins with all its fields; keys that don't come in stay as they are. A known key
    keeps id and created_at, and updated_at moves only if one of the compared columns changes. Counters: criadas,
    atualizadas (rows less criadas), sem_data (rows without a date), total. Where table is a part of a larger one that has every
    key of the rows, top is the highest id of that one and was its number of rows."""
    key = ["source", "external_id"]
    last = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("ord").desc()))).filter("__n = 1").drop("__n", "ord")
    firsts = rows.groupBy(*key).agg(F.min("ord").alias("__first"))
    moment = F.lit(now).cast("timestamp")
    fields = [*COMPARED, "skills"]
    columns = ["id", *key, *fields, "created_at", "updated_at"]
    if top is None:
        top = 0 if table is None else table.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    if was is None:
        was = 0 if table is None else table.count()
    new = firsts if table is None else firsts.join(table.select(*key), key, "left_anti")
    ids = kept(numbered(new, "__first", top).select(*key, "id"), "new-ids")  # keys alone
    if table is None:
        vagas = last.join(ids, key).withColumns({"created_at": moment, "updated_at": moment}).select(*columns)
    else:
        known = table.select(F.lit(False).alias("__new"), *[F.col(c).alias(f"__old_{c}") for c in table.columns])
        fresh = ids.select(F.lit(True).alias("__new"), *[(F.col(c) if c in (*key, "id") else F.lit(None).cast(table.schema[c].dataType)).alias(f"__old_{c}") for c in table.columns])
        both = known.unionByName(fresh).join(last.withColumn("__comes", F.lit(True)), [F.col(f"__old_{k}") == F.col(k) for k in key], "left")
        changed = F.lit(False)
        for c in COMPARED:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"__old_{c}"))
        comes = F.coalesce("__comes", F.lit(False))
        vagas = both.select(
            F.col("__old_id").alias("id"), *[F.col(f"__old_{c}").alias(c) for c in key], *[F.when(comes, F.col(c)).otherwise(F.col(f"__old_{c}")).alias(c) for c in fields],
            F.when(F.col("__new"), moment).otherwise(F.col("__old_created_at")).alias("created_at"),
            F.when(F.col("__new") | (comes & changed), moment).otherwise(F.col("__old_updated_at")).alias("updated_at"),
        )
    seen = rows.agg(F.count(F.lit(1)).alias("__rows"), F.count_if(F.col("published_date").isNull()).alias("sem_data"))
    counters = ids.agg(F.count(F.lit(1)).alias("criadas")).crossJoin(seen)  # single rows
    return Imported(vagas, counters.select("criadas", (F.col("__rows") - F.col("criadas")).alias("atualizadas"), "sem_data", (F.lit(was).cast("long") + F.col("criadas")).alias("total")))


def seed_tecnologias(old: DataFrame | None, rules: Rules, spark: SparkSession) -> DataFrame:
    """(id, nome, grupo): missing names are added, groups follow the rules, nothing is deleted."""
    known = spark.createDataFrame([(i, n, g) for i, (n, g, _) in enumerate(rules.skills, 1)], "place long, nome string, grupo string")
    if old is None:
        return known.select(F.col("place").alias("id"), "nome", "grupo")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    was = old.select(F.col("id").alias("old_id"), F.col("nome").alias("old_nome"), F.col("grupo").alias("old_grupo"))
    both = was.join(F.broadcast(known), F.col("old_nome") == F.col("nome"), "full").crossJoin(F.broadcast(top))  # rules and one row
    fresh = F.col("top") + F.count(F.when(F.col("old_id").isNull(), 1)).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return both.select(F.coalesce("old_id", fresh).alias("id"), F.coalesce("old_nome", "nome").alias("nome"), F.coalesce("grupo", "old_grupo").alias("grupo"))


def link_tecnologias(vagas: DataFrame, tecnologias: DataFrame) -> DataFrame:
    """(vaga_id, tecnologia_id) for each skill of a posting that is known, in any case."""
    names = vagas.select(F.col("id").alias("vaga_id"), F.explode("skills").alias("skill"))
    return names.join(F.broadcast(tecnologias.select(F.col("id").alias("tecnologia_id"), "nome")), F.lower("skill") == F.lower("nome")).select("vaga_id", "tecnologia_id").distinct()
