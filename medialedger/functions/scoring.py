"""The score: three axes, penalties, verdicts and notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config

NOTE_JOIN = " · "


def blank(c: Column) -> Column:
    """NULL for an empty text."""
    return F.nullif(c, F.lit(""))


def clip100(x: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))


def rescale(value: Column, low: float, high: float) -> Column:
    if high - low < 1e-9:
        return F.when(value.isNull(), 0.0).otherwise(50.0)
    return F.when(value.isNull(), 0.0).otherwise(clip100((value - low) / (high - low) * 100.0))


def verdict_for(score: Column, config: Config) -> Column:
    first, *rest = config.bands
    out = F.when(score >= first[0], first[1])
    for limit, label in rest:
        out = out.when(score >= limit, label)
    return out.otherwise(config.bands[-1][1])


def technical(nima: Column, sharpness: Column, config: Config) -> Column:
    fallback = clip100(F.log1p(F.greatest(sharpness, F.lit(0.0))) / F.log1p(F.lit(800.0)) * 100.0)
    return F.when(nima.isNull(), fallback).otherwise(rescale(nima, *config.nima_range))


def _trips(d, columns: dict[str, Column]) -> Column:
    c = columns.get(d.column, F.col(d.column))
    return c > d.limit if d.above else c < d.limit


def defects(config: Config, **columns: Column) -> Column:
    """Wordings of all faults, in the rules' order."""
    return F.filter(F.array(*(F.when(_trips(d, columns), F.lit(d.text)) for d in config.defects)), lambda x: x.isNotNull())


def penalty(config: Config, **columns: Column) -> Column:
    return reduce(lambda a, b: a + b, (F.when(_trips(d, columns), d.penalty).otherwise(0.0) for d in config.defects), F.lit(0.0))


def composite(config: Config) -> Column:
    c = F.col
    raw = rescale(c("aesthetic_raw"), *config.aesthetic_range) * config.w_aesthetic + technical(c("nima_raw"), c("sharpness"), config) * config.w_technical + F.coalesce(c("subject_score"), F.lit(0.0)) * config.w_subject
    frame = F.when(c("source_type") == "video_frame", config.frame_penalty).otherwise(0.0)
    return clip100(raw - penalty(config) - frame)


def rounded(x: Column, digits: int = 0) -> Column:
    """As text, half to even on the exact value, without grouping."""
    return F.call_function("format_number", x, F.lit("0" if digits == 0 else "0." + "0" * digits))


def note(config: Config) -> Column:
    label = blank(F.col("subject_label"))
    named = F.coalesce(F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, F.lit(2), F.length(label))), F.lit("no clear subject"))
    found = defects(config)
    parts = [
        F.concat(F.lit("Aesthetic "), rounded(rescale(F.col("aesthetic_raw"), *config.aesthetic_range))),
        F.concat(F.lit("Technical "), rounded(technical(F.col("nima_raw"), F.col("sharpness"), config))),
        named,
        F.when(F.size(found) > 0, F.element_at(found, 1)),
    ]
    return F.concat_ws(NOTE_JOIN, *parts)


def split_note(text: Column, config: Config) -> tuple[Column, Column]:
    """(facts, fault): a known fault at the end is peeled off."""
    facts, fault = F.coalesce(text, F.lit("")), F.lit("")
    for d in reversed(config.defects):
        end = NOTE_JOIN + d.text
        hit = F.coalesce(text, F.lit("")).endswith(end)
        facts = F.when(hit, F.substring(text, F.lit(1), F.length(text) - len(end))).otherwise(facts)
        fault = F.when(hit, d.text).otherwise(fault)
    return facts, fault


def recompute(catalog: DataFrame, config: Config) -> DataFrame:
    """Score, verdict and note of all rows that were measured; others stay as they are."""
    measured = blank(F.col("error")).isNull() & F.col("aesthetic_raw").isNotNull()
    keep = lambda new, name: F.when(measured, new).otherwise(F.col(name)).alias(name)
    score = composite(config)
    new = {"composite": keep(score, "composite"), "verdict": keep(verdict_for(score, config), "verdict"), "note": keep(note(config), "note")}
    return catalog.select(*(new.get(c, F.col(c)) for c in catalog.columns))
