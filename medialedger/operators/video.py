"""Planning of sampled frames, their dates, and which stills to take out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Config
from ..functions.dates import frame_taken_at
from ..functions.paths import virtual_path
from ..functions.scoring import blank, rounded
from .catalog import fine


def sample_plan(clips: DataFrame, config: Config) -> DataFrame:
    """(path, source_video, timestamp_s) of the frames of each clip (path, duration).

    A frame every so many seconds from 0 on; the midpoint of clips too short for one; one more near the end if the rest is
    as long as a step.
    """
    every = float(config.sample_every)
    count = F.least(F.bround(F.col("duration") / every).cast("int"), F.lit(config.sample_cap))
    grid = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: k * every)).otherwise(F.array(F.col("duration") / 2))
    last = F.element_at(grid, -1)
    tail = (F.col("duration") - last >= every) & (count < config.sample_cap) & (count > 0)
    times = F.when(tail, F.concat(grid, F.array(F.col("duration") - F.least(F.lit(0.5), F.col("duration") * 0.02)))).otherwise(grid)
    out = clips.where("duration > 0").withColumn("timestamp_s", F.explode(times))
    return out.select(virtual_path(F.col("path"), F.col("timestamp_s")).alias("path"), F.col("path").alias("source_video"), "timestamp_s")


def backfill_dates(catalog: DataFrame, clips: DataFrame) -> DataFrame:
    """taken_at of undated frames, from their clip's creation time (path, created); other rows stay."""
    made = clips.select(F.col("path").alias("_clip"), F.col("created").alias("_created"))
    rows = catalog.join(made, catalog["source_video"] == made["_clip"], "left")
    undated = (F.col("source_type") == "video_frame") & blank(F.col("taken_at")).isNull() & fine()
    date = F.when(undated, F.coalesce(frame_taken_at(F.col("_created"), F.col("timestamp_s")), F.col("taken_at"))).otherwise(F.col("taken_at"))
    return rows.withColumn("taken_at", date).select(*catalog.columns)


def extraction_plan(catalog: DataFrame, config: Config, image_format: str = "jpg") -> DataFrame:
    """The best frames of each clip over the least score, with where to write them; `capped` ones are over the clip's limit."""
    rows = catalog.where((F.col("source_type") == "video_frame") & fine() & blank(F.col("dup_of")).isNull() & blank(F.col("source_video")).isNotNull() & (F.col("composite") >= config.extract_min))
    place = F.row_number().over(W.partitionBy("source_video").orderBy(F.desc("composite"), "path"))
    stem = F.regexp_replace(F.regexp_extract("source_video", r"[^/\\]*$", 0), r"(?<=.)\.[^.]*$", "")
    name = F.concat(stem, F.lit("/"), stem, F.lit("_"), F.lpad(F.format_string("%.2f", "timestamp_s"), 8, "0"), F.lit("s_"), rounded(F.col("composite")), F.lit(f".{image_format}"))
    return rows.withColumn("rank", place).where(F.col("rank") <= config.extract_per_clip).select("path", "source_video", "timestamp_s", "composite", "rank", name.alias("dest"))


def extraction_capped(catalog: DataFrame, config: Config) -> DataFrame:
    """How many frames over the least score each clip's limit leaves out."""
    rows = catalog.where((F.col("source_type") == "video_frame") & fine() & blank(F.col("dup_of")).isNull() & (F.col("composite") >= config.extract_min))
    return rows.groupBy("source_video").agg(F.greatest(F.lit(0), F.count(F.lit(1)) - config.extract_per_clip).cast("long").alias("capped")).where("capped > 0")
