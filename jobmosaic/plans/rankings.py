"""Rankings, shares and crosstabs of classified postings. Counts tie by name; percents round halves to even."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmosaic.functions.joins import kept
from jobmosaic.functions.rules import NOT_TOLD, WORKPLACE_ORDER, Rules
from jobmosaic.functions.text import strip_ws


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one decimal, exact halves to the even digit; 0 if whole is 0. Integer arithmetic throughout."""
    n, t = (part * 1000).cast("long"), F.nullif(whole.cast("long"), F.lit(0).cast("long"))
    low = ((n - F.pmod(n, t)) / t).cast("long")
    rest = 2 * F.pmod(n, t)
    up = (rest > t) | ((rest == t) & (low % 2 == 1))
    return F.coalesce((low + F.when(up, 1).otherwise(0)) / F.lit(10.0), F.lit(0.0))


def counted(df: DataFrame, key: str, name: str = "vagas") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def ranked(counts: DataFrame, key: str, by: str = "vagas") -> DataFrame:
    """posicao 1..n by falling count, then name, over a small aggregate."""
    return counts.withColumn("posicao", F.row_number().over(Window.orderBy(F.col(by).desc(), F.col(key))).cast("long"))


def with_percent(counts: DataFrame, by: str = "vagas") -> DataFrame:
    return counts.withColumn("percentual", percent(F.col(by), F.sum(by).over(Window.partitionBy())))


def area_ranking(jobs: DataFrame) -> DataFrame:
    return _areas(counted(jobs, "area"))


def _areas(counts: DataFrame) -> DataFrame:
    return with_percent(ranked(counts, "area")).select("posicao", "area", "vagas", "percentual")


def workplace_ranking(jobs: DataFrame) -> DataFrame:
    """In the order of the known labels, then unknown ones by name; blank counts as not told; labels without rows are left out."""
    return _workplaces(counted(jobs, "workplace_type"))


def _workplaces(by_type: DataFrame) -> DataFrame:
    label = F.coalesce(F.nullif(strip_ws("workplace_type"), F.lit("")), F.lit(NOT_TOLD))
    counts = by_type.groupBy(label.alias("modalidade")).agg(F.sum("vagas").alias("vagas"))
    place = F.array_position(F.array(*[F.lit(w) for w in WORKPLACE_ORDER]), F.col("modalidade"))
    order = Window.orderBy(F.when(place == 0, F.lit(99)).otherwise(place), "modalidade")
    return with_percent(counts.withColumn("posicao", F.row_number().over(order).cast("long"))).select("posicao", "modalidade", "vagas", "percentual")


def workplace_by_area(jobs: DataFrame) -> DataFrame:
    """One column a known label; a blank label counts nowhere. Rows in the order of the ranking."""
    return _crosstab(jobs.groupBy("area", "workplace_type").agg(F.count(F.lit(1)).alias("vagas")))


def _crosstab(cells: DataFrame) -> DataFrame:
    names = ("remoto", "hibrido", "presencial", "nao_informado")
    told = lambda w: F.sum(F.when(F.col("workplace_type") == w, F.col("vagas")).otherwise(0))
    sums = cells.groupBy("area").agg(F.sum("vagas").alias("vagas"), *[told(w).alias(n) for w, n in zip(WORKPLACE_ORDER, names, strict=True)])
    return ranked(sums, "area").select("area", *names, "posicao")


def mentions(jobs: DataFrame) -> DataFrame:
    """(area, tecnologia) for each skill of each posting. Spark puts a filter on what a plain explode of a column reads, and moves it
    down to the raw postings: their texts would be folded and searched twice."""
    return each_skill(jobs, "area").filter("tecnologia IS NOT NULL").select("area", "tecnologia")


def overall_skills(jobs: DataFrame, top: int = 20) -> DataFrame:
    return _top(counted(mentions(jobs), "tecnologia"), "tecnologia", top)


def _top(counts: DataFrame, key: str, top: int) -> DataFrame:
    return ranked(counts.orderBy(F.desc("vagas"), key).limit(top), key)


def topn_per_group(counts: DataFrame, group: str, key: str, top: int, by: str = "vagas") -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.col(by).desc(), F.col(key))
    return counts.withColumn("posicao", F.row_number().over(order).cast("long")).filter(F.col("posicao") <= top)


def skills_by_area(jobs: DataFrame, top: int = 8) -> DataFrame:
    counts = mentions(jobs).groupBy("area", "tecnologia").agg(F.count(F.lit(1)).alias("vagas"))
    return topn_per_group(counts, "area", "tecnologia", top).select("area", "posicao", "tecnologia", "vagas")


def skill_base_by_area(jobs: DataFrame) -> DataFrame:
    """Postings with a skill at least, and all postings, by area; areas without such postings are left out."""
    sums = jobs.groupBy("area").agg(F.count_if(F.size("skills") > 0).alias("base"), F.count(F.lit(1)).alias("vagas"))
    return sums.filter("base > 0")


def skill_share_by_area(jobs: DataFrame, least: int = 6, areas: int = 8, top: int = 8) -> DataFrame:
    """Percent of an area's postings with skills that name a skill; areas of least postings or more, the largest ones.

    One pass: each posting also counts once under no skill, which gives its area's sums."""
    counts = each_skill(jobs, "area").groupBy("area", "tecnologia").agg(F.count(F.lit(1)).alias("vagas"), F.count_if("told").alias("told"))
    return _shares(counts, least, areas, top)


def each_skill(jobs: DataFrame, *columns: str) -> DataFrame:
    """A row for each posting (tecnologia null) and one for each of its skills; told: the posting has skills."""
    each = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("skills", F.array().cast("array<string>")))
    return jobs.select(*columns, F.explode(each).alias("tecnologia"), F.coalesce(F.size("skills") > 0, F.lit(False)).alias("told"))


def _shares(counts: DataFrame, least: int, areas: int, top: int) -> DataFrame:
    of_area, whole = Window.partitionBy("area"), F.col("tecnologia").isNull()  # counts: areas times skills
    sums = counts.withColumns({"base": F.max(F.when(whole, F.col("told"))).over(of_area), "vagas_area": F.max(F.when(whole, F.col("vagas"))).over(of_area)})
    named = sums.filter(~whole & (F.col("base") >= least)).withColumn("place", F.dense_rank().over(Window.orderBy(F.desc("base"), "area"))).filter(F.col("place") <= areas)
    best = topn_per_group(named, "area", "tecnologia", top)
    return best.select("area", "posicao", "tecnologia", "vagas", "base", "vagas_area", percent(F.col("vagas"), F.col("base")).alias("percentual"))


def top_companies(jobs: DataFrame, top: int = 15) -> DataFrame:
    named = jobs.filter(strip_ws(F.coalesce("company", F.lit(""))) != "")
    return _top(counted(named, "company"), "company", top)


def sample_per_area(jobs: DataFrame, each: int = 5) -> DataFrame:
    """The first postings of each area, areas in the order of the ranking."""
    jobs = kept(jobs.select("area", "ord", "title", "title_ord", "rep_ord"), "sample")
    order = Window.partitionBy("area").orderBy("title_ord", "rep_ord")  # each task passes on its first ones only
    firsts = jobs.withColumn("n", F.row_number().over(order).cast("long")).filter(F.col("n") <= each)
    return firsts.join(F.broadcast(area_ranking(jobs).select("area", "posicao")), "area").select("posicao", "area", "n", "ord", "title")


def workplace_informed_share(jobs: DataFrame) -> DataFrame:
    """Share of each work mode of all postings, and of those whose mode is told."""
    return _informed(workplace_ranking(jobs))


def _informed(ranking: DataFrame) -> DataFrame:
    told = F.sum(F.when(F.col("modalidade") != NOT_TOLD, F.col("vagas")).otherwise(0)).over(Window.partitionBy())
    share = F.when(F.col("modalidade") != NOT_TOLD, percent(F.col("vagas"), told))
    return ranking.select("modalidade", "vagas", "percentual", share.alias("percentual_informado"))


def fallback_share_by_source(jobs: DataFrame, rules: Rules) -> DataFrame:
    sums = jobs.groupBy("source").agg(F.count_if(F.col("area") == rules.fallback).alias("outros"), F.count(F.lit(1)).alias("vagas"))
    return sums.withColumn("percentual", percent(F.col("outros"), F.col("vagas")))


def snapshot_drift(now: DataFrame, before: DataFrame) -> DataFrame:
    side = lambda df, n: area_ranking(df).select("area", F.col("vagas").alias(f"vagas_{n}"), F.col("percentual").alias(f"percentual_{n}"))
    return side(now, "agora").join(side(before, "antes"), "area", "full").na.fill(0)


def term_yield(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("source", "search_term").agg(F.count(F.lit(1)).alias("vagas"))


#: The groupings that all rankings are read from, and the bits of those columns that a grouping leaves out.
GROUPED = ["area", "workplace_type", "tecnologia", "seniority", "source", "company"]
GROUPINGS = {"area_workplace": ["area", "workplace_type"], "area_skill": ["area", "tecnologia"], "seniority": ["seniority"], "source": ["source"], "company": ["company"]}


@dataclass
class Rankings:
    """Every ranking of one set of classified postings, read from one table of sums.

    sums has a row for each group of each grouping: vagas (postings), told (those with skills), outros (those of the fallback
    area); in area_skill, vagas of a row with a skill are its mentions, and the row without one has the area's postings."""

    sums: DataFrame

    def of(self, grouping: str) -> DataFrame:
        """The groups of one grouping; only its folder is read."""
        return self.sums.filter(F.col("grouping") == grouping).select(*GROUPINGS[grouping], "vagas", "told", "outros")

    def _by(self, key: str, grouping: str, *sums: str) -> DataFrame:
        return self.of(grouping).groupBy(key).agg(*[F.sum(c).alias(c) for c in sums or ("vagas",)])

    def area_ranking(self) -> DataFrame:
        return _areas(self._by("area", "area_workplace"))

    def workplace_ranking(self) -> DataFrame:
        return _workplaces(self._by("workplace_type", "area_workplace"))

    def workplace_informed_share(self) -> DataFrame:
        return _informed(self.workplace_ranking())

    def workplace_by_area(self) -> DataFrame:
        return _crosstab(self.of("area_workplace"))

    def seniority_counts(self) -> DataFrame:
        return self.of("seniority").select("seniority", "vagas")

    def source_counts(self) -> DataFrame:
        return self.of("source").select("source", "vagas")

    def fallback_share_by_source(self) -> DataFrame:
        return self.of("source").select("source", "outros", "vagas", percent(F.col("outros"), F.col("vagas")).alias("percentual"))

    def top_companies(self, top: int = 15) -> DataFrame:
        named = self.of("company").filter(strip_ws(F.coalesce("company", F.lit(""))) != "")
        return _top(named.select("company", "vagas"), "company", top)

    def overall_skills(self, top: int = 20) -> DataFrame:
        named = self.of("area_skill").filter("tecnologia is not null")
        return _top(named.groupBy("tecnologia").agg(F.sum("vagas").alias("vagas")), "tecnologia", top)

    def skills_by_area(self, top: int = 8) -> DataFrame:
        named = self.of("area_skill").filter("tecnologia is not null").select("area", "tecnologia", "vagas")
        return topn_per_group(named, "area", "tecnologia", top).select("area", "posicao", "tecnologia", "vagas")

    def skill_base_by_area(self) -> DataFrame:
        return self.of("area_skill").filter("tecnologia is null and told > 0").select("area", F.col("told").alias("base"), "vagas")

    def skill_share_by_area(self, least: int = 6, areas: int = 8, top: int = 8) -> DataFrame:
        return _shares(self.of("area_skill").select("area", "tecnologia", "vagas", "told"), least, areas, top)


def rankings(jobs: DataFrame, rules: Rules) -> Rankings:
    """One aggregate over grouping sets of the postings, written once in a folder for each grouping.

    Sums are made in each task first, so that large areas, portals or companies are a row a task. A posting takes part
    once for itself and once for each of its skills."""
    rows = each_skill(jobs, *[c for c in GROUPED if c != "tecnologia"])
    marked = rows.withColumns({"own": F.col("tecnologia").isNull().cast("long"), "fallback": (F.col("tecnologia").isNull() & (F.col("area") == rules.fallback)).cast("long"), "with_skills": (F.col("tecnologia").isNull() & F.col("told")).cast("long")})
    sets = marked.groupingSets([[F.col(c) for c in columns] for columns in GROUPINGS.values()], *[F.col(c) for c in GROUPED])
    sums = sets.agg(F.grouping_id().alias("left_out"), F.count(F.lit(1)).alias("every"), F.sum("own").alias("own"), F.sum("with_skills").alias("told"), F.sum("fallback").alias("outros"))
    bits = {name: sum(1 << (len(GROUPED) - 1 - i) for i, c in enumerate(GROUPED) if c not in columns) for name, columns in GROUPINGS.items()}
    grouping = F.coalesce(*[F.when(F.col("left_out") == number, F.lit(name)) for name, number in bits.items()])
    named = sums.withColumn("grouping", grouping).withColumn("vagas", F.when(F.col("grouping") == "area_skill", F.col("every")).otherwise(F.col("own")))
    return Rankings(kept(named.select(*GROUPED, "vagas", "told", "outros", "grouping"), "rankings", "grouping"))
