"""Statistics, galleries, tags, search and orders of the report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Config
from ..functions.dates import year_span
from ..functions.paths import UNFILED, folder_group, strip_folder_date, top_folder
from ..functions.scoring import blank
from ..functions.tags import search_blob
from .catalog import fine, real_path


def report_stats(rows: DataFrame, config: Config) -> DataFrame:
    """One row of eleven numbers."""
    ok, single = fine(), blank(F.col("dup_of")).isNull()
    n = lambda c, name: F.count_if(c).alias(name)
    labels = [label for _, label in config.bands]
    frame = F.col("source_type") == "video_frame"
    return rows.agg(
        n(ok, "total"),
        n(ok & single & (F.col("verdict") == labels[0]), "top"),
        n(ok & single & (F.col("verdict") == labels[1]), "strong"),
        n(ok & single & (F.col("verdict") == labels[2]), "maybe"),
        n(ok & ~single, "dups"),
        F.count_distinct("folder").alias("folders"),
        n(~ok, "errors"),
        n(ok & ~F.coalesce(frame, F.lit(False)), "photos"),
        n(ok & frame, "video_frames"),
        F.count_distinct(blank(F.col("source_video"))).alias("clips"),
        n(ok & blank(F.col("extracted_path")).isNotNull(), "extracted"),
    )


def strong_stats(rows: DataFrame, config: Config) -> DataFrame:
    """report_stats with the shortlist's size and its hidden duplicates."""
    listed = fine() & F.col("verdict").isin(*config.shortlist)
    single = blank(F.col("dup_of")).isNull()
    more = rows.agg(F.count_if(listed & single).alias("shortlisted"), F.count_if(listed & ~single).alias("hidden_dups"))
    return report_stats(rows, config).withColumn("_k", F.lit(1)).join(more.withColumn("_k", F.lit(1)), "_k").drop("_k")


def folder_counts(rows: DataFrame) -> DataFrame:
    """(folder, shown, images) of the top folders in name order; the row without a folder is the total."""
    counts = rows.where(fine()).select(top_folder(F.col("folder")).alias("folder")).rollup("folder").agg(F.count(F.lit(1)).alias("images"))
    shown = strip_folder_date(F.col("folder"))
    return counts.select("folder", F.when(F.col("folder").isNotNull(), shown).alias("shown"), "images").orderBy(F.col("folder").isNull().desc(), F.lower("shown"), "folder")


def covers(rows: DataFrame, k: int = 4) -> DataFrame:
    """The k best rows of each gallery; the limit is applied before the shuffle, too."""
    place = F.row_number().over(W.partitionBy("gallery").orderBy(F.desc_nulls_last("composite"), "path"))
    return with_galleries(rows).withColumn("rank", place).where(F.col("rank") <= k)


def with_galleries(rows: DataFrame) -> DataFrame:
    """rows with their gallery; names are taken apart once for each folder."""
    folder = F.coalesce("folder", F.lit(""))
    names = rows.select(folder.alias("_folder")).distinct().withColumn("gallery", folder_group(F.col("_folder")))
    return rows.withColumn("_folder", folder).join(names, "_folder").drop("_folder")


def folder_tiles(rows: DataFrame, likes: DataFrame | None = None) -> DataFrame:
    """A tile for each gallery that has rows: count, dates, likes (photo_id, hearts), best score, four cover paths."""
    r = with_galleries(rows).withColumn("_day", F.substring(blank(F.col("taken_at")), 1, 10))
    if likes is None:
        r = r.withColumn("hearts", F.lit(0).cast("long"))
    else:
        r = r.join(likes.select("photo_id", "hearts"), "photo_id", "left")
    tiles = r.groupBy("gallery").agg(F.count(F.lit(1)).alias("images"), F.min("_day").alias("oldest"), F.max("_day").alias("newest"), F.sum(F.coalesce("hearts", F.lit(0))).alias("likes"), F.max("composite").alias("best"))
    top = covers(rows.select("folder", "path", "composite")).groupBy("gallery").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("covers"))
    return tiles.join(top, "gallery").withColumn("years", year_span(F.col("oldest"), F.col("newest")))


def sort_tiles(tiles: DataFrame, key: str = "name", descending: bool = False) -> DataFrame:
    """By name, score, date or likes; galleries without a name last, then ties by name."""
    columns = {"name": natural_key(F.col("gallery")), "score": F.col("best"), "date": blank(F.col("newest")), "likes": F.col("likes")}
    c = columns[key]
    by = c.desc_nulls_last() if descending else c.asc_nulls_last()
    return tiles.orderBy(F.col("gallery") == UNFILED, by, natural_key(F.col("gallery")), "gallery")


def natural_key(name: Column) -> Column:
    """Compares numbers by value and letters without case and accents."""
    runs = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    # a number is led by its length, and that by the length's length, so that numbers of any size sort by value
    bare = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    size = lambda x: F.length(x).cast("string")
    padded = F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.concat(size(size(bare(x))), size(bare(x)), bare(x))).otherwise(x))
    return F.collate(F.array_join(padded, ""), "UNICODE_CI_AI")


def explode_tags(tags: DataFrame) -> DataFrame:
    """(key, pos, tag) from (key, tags)."""
    return tags.select("key", F.posexplode("tags").alias("pos", "tag"))


def distinct_spellings(tags: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(key, pos, tag) with each tag once whatever its case, as first spelt; only tags that are wanted.

    Lists are dealt by key before they are taken apart, so no row of a single tag is shuffled.
    """
    first = F.row_number().over(W.partitionBy("key", F.lower("tag")).orderBy("pos"))
    each = explode_tags(tags.repartition("key"))
    return (each if wanted is None else each.where(wanted)).withColumn("_n", first).where("_n = 1").drop("_n")


def tag_counts(tags: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(tag, photos), spelt as first seen, in order of the lower-cased tag; of wanted tags."""
    out = distinct_spellings(tags, wanted).groupBy(F.lower("tag").alias("low")).agg(F.count("key").alias("photos"), F.min_by("tag", F.struct("key", "pos")).alias("tag"))
    return out.select("tag", "photos", "low").orderBy("low").drop("low")


def tag_menu(tags: DataFrame, term: str = "", chosen: Sequence[str] = (), most: int = 40) -> DataFrame:
    low = F.lower("tag")
    wanted = low.contains(term.lower())
    if chosen:
        wanted = wanted & ~low.isin(*(c.lower() for c in chosen))
    return tag_counts(tags, wanted).orderBy(low).limit(most)


def attach_tags(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """tags by path, else by a frame's clip; an empty array without any."""
    own, clip = tags.select(F.col("key").alias("_k1"), F.col("tags").alias("_t1")), tags.select(F.col("key").alias("_k2"), F.col("tags").alias("_t2"))
    out = rows.withColumn("_real", real_path())
    out = out.join(own, out["path"] == own["_k1"], "left").join(clip, F.col("_real") == clip["_k2"], "left")
    return out.withColumn("tags", F.coalesce("_t1", "_t2", F.array().cast("array<string>"))).drop("_real", "_k1", "_k2", "_t1", "_t2")


def tags_of_report(tags: DataFrame, rows: DataFrame) -> DataFrame:
    """Only the tags of rows that are shown."""
    keys = rows.select(F.col("path").alias("key")).union(rows.select(real_path())).distinct()
    return tags.join(keys, "key", "left_semi")


def remove_tag(tags: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(tags without it, number of photos that had it); photos without a tag left go."""
    hit = F.exists("tags", lambda t: F.lower(t) == name.lower())
    left = tags.withColumn("tags", F.filter("tags", lambda t: F.lower(t) != name.lower())).where(F.size("tags") > 0)
    return left, tags.agg(F.count_if(hit).alias("hits"))


def card_filter(verdict: str | None = None, duplicates: bool = False, kind: str | None = None, folder: str | None = None, gallery: str | None = None, tags: Sequence[str] = (), text: str = "", liked: bool = False) -> Column:
    """All conditions together; chosen tags are alternatives."""
    out = fine()
    if verdict:
        out = out & (F.col("verdict") == verdict)
    if not duplicates:
        out = out & blank(F.col("dup_of")).isNull()
    if kind:
        out = out & (F.coalesce("source_type", F.lit("photo")) == {"photo": "photo", "video": "video_frame"}[kind])
    if folder:
        out = out & (top_folder(F.col("folder")) == folder)
    if gallery:
        out = out & (folder_group(F.col("folder")) == gallery)
    if tags:
        out = out & F.arrays_overlap(F.transform("tags", F.lower), F.array(*(F.lit(t.lower()) for t in tags)))
    if text:
        low = F.lit(text.lower())
        out = out & (search_blob().contains(low) | F.concat(F.lit("|"), F.lower(F.array_join("tags", "|")), F.lit("|")).contains(low))
    if liked:
        out = out & (F.col("hearts") > 0)
    return out


def sort_cards(rows: DataFrame, key: str = "score", descending: bool = True) -> DataFrame:
    """By score, date (as text), folder, name or hearts; empty values last either way, ties by score and path."""
    columns = {"score": F.col("composite"), "date": blank(F.col("taken_at")), "folder": natural_key(blank(F.col("folder"))), "name": natural_key(blank(F.col("filename"))), "hearts": F.col("hearts") if "hearts" in rows.columns else F.lit(0)}
    c = columns[key]
    return rows.orderBy(c.isNull(), c.desc() if descending else c.asc(), F.desc_nulls_last("composite"), "path")


def catalog_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("composite"), "path")


def scan_stats(listing: DataFrame, todo: DataFrame) -> DataFrame:
    """Found stills and clips, too small and hidden ones (flags of the listing), and what is to do."""
    left = todo.select("path").withColumn("_todo", F.lit(True))
    n = lambda c, name: F.count_if(c).alias(name)
    flags = {c: F.col(c) if c in listing.columns else F.lit(False) for c in ("too_small", "hidden")}
    return listing.join(left, "path", "left").agg(n(F.col("kind") == "photo", "stills"), n(F.col("kind") == "video", "videos"), n(F.col("_todo").isNull(), "done"), n(F.col("_todo"), "todo"), n(flags["too_small"], "too_small"), n(flags["hidden"], "hidden"))


def output_inventory(files: DataFrame) -> DataFrame:
    """(kind, files, bytes) of written outputs (kind, length)."""
    return files.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
