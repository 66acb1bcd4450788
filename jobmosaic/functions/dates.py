"""Dates as portals write them, and the day a snapshot was made."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobmosaic.functions.text import SPACES


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")


def parse_published_date(raw: Column | str, reference: Column | dt.date) -> Column:
    """A date, or null. An ISO date at the start counts alone, an impossible one is null; then dd/mm/yyyy; then
    words relative to the reference day, the longest form of `ontem` first; then days and months (of 30 days) ago."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    reference = reference if isinstance(reference, Column) else F.lit(reference)
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), f"^{SPACES}|{SPACES}$", "")
    low = F.lower(text)
    iso, br = r"^(\d{4})-(\d{2})-(\d{2})", r"^(\d{2})/(\d{2})/(\d{4})$"
    ago = r"h[aá]\s+(?:mais\s+de\s+)?(\d+)\s+"
    parts = lambda pattern, *groups: [F.regexp_extract(text, pattern, g) for g in groups]
    number = lambda pattern: F.regexp_extract(low, pattern, 1).try_cast("int")
    days, months = ago + r"dias?", ago + r"m[eê]s(?:es)?"
    found = F.when(text.rlike(iso), _date(*parts(iso, 1, 2, 3))).when(text.rlike(br), _date(*parts(br, 3, 2, 1)))
    for word, back in (("anteontem", 2), ("ontem", 1), ("hoje", 0)):
        found = found.when(low.rlike(rf"(?U)\b{word}\b"), F.date_sub(reference, back))
    return found.when(low.rlike(days), F.date_sub(reference, number(days))).when(low.rlike(months), F.date_sub(reference, F.lit(30) * number(months)))


def reference_date(file_name: Column, modified: Column, given: dt.date | None = None) -> Column:
    """The day in a snapshot's name (yyyymmdd_hhmmss), or of the file's last change; a given day wins."""
    stamp = F.regexp_extract(file_name, r"(\d{8})_(\d{6})", 1)
    return F.coalesce(F.lit(given).cast("date"), F.try_to_date(stamp, "yyyyMMdd"), modified.cast("date"))
