"""From raw postings to ranked areas, and the counts of each stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmosaic.functions.joins import kept
from jobmosaic.functions.rules import Rules
from jobmosaic.functions.text import company_identity, normalize, normalize_tech, normalize_workplace, squash_ws, strip_tags, without_marks
from jobmosaic.operators.areas import classify, extract_skills, gate, with_hits, with_scores
from jobmosaic.operators.dedupe import first_of_term, survivors_of, text_size
from jobmosaic.operators.levels import all_levels, entry_level


def clean(jobs: DataFrame) -> DataFrame:
    """Title, company and description cleaned, and the folded columns that later steps read, each made once.

    Folding takes white space of any kind as one space, so that it reads the description before its white space is squashed."""
    tidy = jobs.withColumns({"title": squash_ws("title"), "company": squash_ws("company"), "description": strip_tags("description")})
    if "raw_workplace" in jobs.columns:
        tidy = tidy.withColumn("workplace_type", normalize_workplace("raw_workplace")).drop("raw_workplace")
    marked = tidy.withColumns({"tech_title": normalize_tech("title"), "tech_body": normalize_tech("description")})
    folded = marked.withColumns({"norm_title": without_marks("tech_title"), "norm_company": normalize("company"), "norm_body": without_marks("tech_body"), "description": squash_ws("description")})
    return folded.withColumns({
        "fingerprint": F.sha1(F.concat_ws("|", "norm_title", "norm_company").cast("binary")),
        "identity": company_identity("norm_company", folded=True),
    })


def with_levels(jobs: DataFrame, rules: Rules, strict: bool = False, every: bool = False) -> DataFrame:
    return all_levels(jobs) if every else entry_level(jobs, rules, strict)


def enrich(jobs: DataFrame, rules: Rules) -> DataFrame:
    """area, area_score, area_matches and skills for postings that have their hits."""
    scored = classify(with_scores(jobs, rules), rules)
    return scored.withColumn("skills", extract_skills(F.trim(F.concat_ws(" ", "tech_title", "tech_body")), rules)).drop("scores")


@dataclass
class Stages:
    """The rows after each stage: raw and levelled are slim (keys, folded title, lengths, tech), flagged has all columns and tech.

    tech are the kept postings without area and skills: what reads neither is best taken from there, as no text is read for it again."""

    raw: DataFrame
    levelled: DataFrame
    flagged: DataFrame
    jobs: DataFrame

    @property
    def tech(self) -> DataFrame:
        return self.flagged.filter("tech")

    @property
    def other(self) -> DataFrame:
        return self.flagged.filter(~F.col("tech"))


def run(raw: DataFrame, rules: Rules | None = None, strict: bool = False, every_level: bool = False, keep_non_tech: bool = False, counted: bool = False) -> Stages:
    """first of its term -> level -> dedupe -> tech gate -> area and skills.

    Up to the dedupe only slim rows go through shuffles; who survives is worked out at once, as a slim table. The gate is
    asked with them, where a text is cleaned for its length anyway. Then the raw postings meet that table, and only
    survivors of the gate are cleaned and scored, lazily. counted: the slim rows before the
    level filter are written too, so that what counts them doesn't read the raw postings again."""
    rules = rules or Rules()
    slim = clean(raw).select("ord", "source", "external_id", "search_term", "seniority", "norm_title", "fingerprint", "identity", text_size(raw), gate("norm_title", normalize("description"), rules).alias("tech"))
    first = kept(first_of_term(slim), "first-of-term") if counted else first_of_term(slim)
    levelled = with_levels(first, rules, strict, every_level)
    told = ["first_ord", "rep_ord", "title_ord", "search_term", "seniority", "tech"]
    flagged = clean(raw.drop("search_term", "seniority").join(survivors_of(levelled).select("ord", *told), "ord"))
    return Stages(first, levelled, flagged, enrich(with_hits(flagged if keep_non_tech else flagged.filter("tech"), rules), rules).drop("title_hits", "body_hits"))


def funnel(raw: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(etapa, vagas): raw rows after S7, dropped by level, duplicates, not tech, kept. The first counts are of the slim table that
    the dedupe starts from; the raw postings' texts are read for it once.

    Counts come from written tables, not from metrics observed on the way: a task that runs again would count twice there."""
    s = run(raw, rules, counted=True)
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    flags = s.flagged.agg(F.count_if("tech").alias("tech"), F.count_if(~F.col("tech")).alias("other"))
    one = count(s.raw).withColumnRenamed("n", "raw").crossJoin(count(s.levelled).withColumnRenamed("n", "levelled")).crossJoin(flags)  # single rows
    rows = {"brutas": F.col("raw"), "senioridade": F.col("raw") - F.col("levelled"), "duplicadas": F.col("levelled") - F.col("tech") - F.col("other"), "nao_tech": F.col("other"), "mantidas": F.col("tech")}
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("etapa"), v.cast("long").alias("vagas")) for k, v in rows.items()])))
