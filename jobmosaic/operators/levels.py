"""Seniority: labels from titles, and the filters on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmosaic.functions.rules import NOT_FILTERED, Rules


def _any(title: Column, patterns: list[str]) -> Column:
    return title.rlike("|".join(f"(?:{p})" for p in patterns))


def seniority_label(norm_title: Column, rules: Rules, strict: bool = False) -> Column:
    """The first label, in rule order, of which a pattern is in the plain title; null if none, or (strict) if a higher level is named too."""
    label = F.lit(None).cast("string")
    for name, patterns in reversed(list(rules.seniority.items())):
        label = F.when(_any(norm_title, patterns), F.lit(name)).otherwise(label)
    return F.when(~_any(norm_title, rules.senior), label) if strict else label


def level_of(rules: Rules, strict: bool = False) -> Column:
    """The declared level (the title isn't asked then) or the label from norm_title; null if there is neither."""
    return F.coalesce(F.nullif(F.coalesce("seniority", F.lit("")), F.lit("")), seniority_label(F.col("norm_title"), rules, strict))


def entry_level(jobs: DataFrame, rules: Rules, strict: bool = False) -> DataFrame:
    """Rows with a level; seniority holds it."""
    return jobs.withColumn("seniority", level_of(rules, strict)).filter(F.col("seniority").isNotNull())


def all_levels(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("seniority", F.coalesce(F.nullif(F.col("seniority"), F.lit("")), F.lit(NOT_FILTERED)))
