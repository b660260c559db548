"""Fitting the score's ranges and bands to the collection, from exact order statistics."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scoring import composite
from .catalog import keepers

#: Bits of a sort key that one pass counts.
BITS = 16


def nearest_index(q: float, n: int) -> int:
    """The element at q of n sorted ones: half to even, within bounds."""
    return min(max(0, int(round(q * (n - 1)))), n - 1)


class Statistics(NamedTuple):
    n: int
    values: list[float | None]


def sort_key(value: Column) -> Column:
    """A long that sorts as a double does: its bits, those of negative ones turned over."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def order_statistics(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, Statistics]:
    """For columns of doubles, the number of values and the elements at the quantiles; nulls don't count.

    All at once, by histograms of the next BITS bits of the values' sort keys, within the bins that hold a wanted rank. A
    histogram has at most 2**BITS bins for a rank, whatever the number of rows; a bin whose values are all equal is an
    answer, so two or three passes are usual, and four the most. Nothing is sorted.
    """
    names = list(wanted)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(names))))
    values = df.select(each.alias("x")).select("x.i", "x.v").where("v is not null").withColumn("key", sort_key(F.col("v")))
    counts, found = dict.fromkeys(range(len(names)), 0), {}
    open_: dict[tuple[int, int], list[tuple[int, int]]] = {}  # column and bin: place of the quantile, and rank within the bin
    for shift in range(64 - BITS, -1, -BITS):
        bin_, above = F.shiftright("key", shift), F.shiftright("key", min(63, shift + BITS))
        rows = values
        if shift < 64 - BITS:
            within = [(F.col("i") == i) & (above == b) for i, b in open_]
            rows = rows.where(functools.reduce(operator.or_, within))
        bins = rows.groupBy("i", bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        if shift == 64 - BITS:
            for r in bins:
                counts[r["i"]] += r["n"]
            top = {i: [(k, nearest_index(q, counts[i])) for k, q in enumerate(wanted[c])] for i, c in enumerate(names) if counts[i]}
            groups = {(i, None): x for i, x in top.items()}
        else:
            groups = dict(open_)
        open_ = {}
        for (i, prefix), ranks in groups.items():
            below = 0
            left = sorted(ranks, key=lambda x: x[1])
            for r in sorted((r for r in bins if r["i"] == i and prefix in (None, r["b"] >> BITS)), key=lambda r: r["b"]):
                while left and left[0][1] < below + r["n"]:
                    k, rank = left.pop(0)
                    if shift == 0 or r["low"] == r["high"]:
                        found[i, k] = r["low"]
                    else:
                        open_.setdefault((i, r["b"]), []).append((k, rank - below))
                below += r["n"]
        if not open_:
            break
    return {c: Statistics(counts[i], [found.get((i, k)) for k in range(len(wanted[c]))]) for i, c in enumerate(names)}


def widened(low: float, high: float, least: float) -> tuple[float, float]:
    if high - low >= least:
        return low, high
    middle = (low + high) / 2
    return middle - least / 2, middle + least / 2


def guarded(thresholds: Sequence[float]) -> list[float]:
    """Bands from the best down; from the bottom up each is at least 0.1 over the next."""
    out = list(thresholds)
    for i in range(len(out) - 2, -1, -1):
        if out[i] <= out[i + 1]:
            out[i] = out[i + 1] + 0.1
    return out


def calibrate(catalog: DataFrame, config: Config) -> Config | None:
    """A config whose ranges and bands fit the keepers; None with too few of them."""
    rows = keepers(catalog)
    raw = order_statistics(rows, {"aesthetic_raw": config.range_quantiles, "nima_raw": config.range_quantiles})
    n = raw["aesthetic_raw"].n
    if n < config.min_keepers:
        return None
    fitted = {"aesthetic_range": widened(*raw["aesthetic_raw"].values, config.min_span)}
    if raw["nima_raw"].n >= config.min_keepers:
        fitted["nima_range"] = widened(*raw["nima_raw"].values, config.min_span)
    ranged = config.with_values(fitted)
    scores = order_statistics(rows.select(composite(ranged).alias("v")), {"v": config.band_quantiles})["v"]
    limits = guarded([*scores.values, config.bands[-1][0]])
    bands = tuple((limit, label) for limit, (_, label) in zip(limits, config.bands, strict=True))
    return ranged.with_values({"bands": bands, "keeper_count": n})


def should_recalibrate(catalog: DataFrame, config: Config) -> bool:
    """Enough keepers, and none fitted before or a tenth more or fewer since."""
    n = keepers(catalog).count()
    if n < config.min_keepers:
        return False
    return not config.keeper_count or abs(n - config.keeper_count) / max(config.keeper_count, 1) >= config.keeper_growth


def observed_range(catalog: DataFrame) -> DataFrame:
    """Smallest, largest and number of the raw scores."""
    cols = [("aesthetic_raw", "aesthetic"), ("nima_raw", "nima")]
    return keepers(catalog).agg(*(f(c).alias(f"{name}_{k}") for c, name in cols for k, f in (("min", F.min), ("max", F.max), ("n", F.count))))
