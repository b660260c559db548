"""Cleaning of typed tags and text to search in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import pretty_date, pretty_resolution, pretty_time
from .paths import strip_folder_date


def sanitize_tag(raw: Column, most: int = 40) -> Column:
    """Letters, digits, blanks, `_` and `-`, single blanks, trimmed and cut; an empty text if nothing is left."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9 _-]", ""), " +", " ")
    trim = lambda x: F.trim(x, F.lit(" -_"))
    return trim(F.substring(trim(text), 1, most))


def clean_web_tags(tags: Column, most: int = 40) -> Column:
    """Sorted and distinct; unlike typed tags, runs of blanks stay."""
    clean = F.transform(tags, lambda t: F.substring(F.trim(F.regexp_replace(t, r"[^A-Za-z0-9 _-]", "")), 1, most))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != ""))))


def first_spellings(tags: Column) -> Column:
    """Distinct whatever the case, in order, with the first spelling."""
    return F.aggregate(tags, F.array().cast("array<string>"), lambda acc, t: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc).otherwise(F.array_append(acc, t)))


def without_tag(tags: Column, name: str) -> Column:
    return F.filter(tags, lambda t: F.lower(t) != name.lower())


def search_blob() -> Column:
    c = F.col
    return F.lower(F.concat_ws(" ", c("folder"), strip_folder_date(c("folder")), c("filename"), F.substring("taken_at", 1, 10), pretty_date(c("taken_at")), pretty_time(c("taken_at")), c("verdict"), pretty_resolution(c("width"), c("height")), c("note")))
