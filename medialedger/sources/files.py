"""Listings, pictures, catalogs, tags, calibrations and report files."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.dates import megapixels, pretty_date, pretty_time
from ..operators.catalog import evolve, keyed, shortlist, skipped
from ..operators.publish import entry_json, manifest_put
from ..operators.report import catalog_order
from ..schema import CATALOG, REPORT_COLUMNS
from .large_json import object_entries

#: Suffixes by kind. Fixed values.
RAW = ("nef", "cr2", "cr3", "arw", "dng", "orf", "rw2", "raf", "pef", "srw")
STANDARD = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp", "heic", "heif")
VIDEO = ("mp4", "mov", "avi", "mkv", "m4v", "mts", "m2ts", "webm")


def kind_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(suffix.isin(*RAW), "raw").when(suffix.isin(*STANDARD), "photo").when(suffix.isin(*VIDEO), "video")


def list_media(spark: SparkSession, root: str, folder: str | None = None, include_video: bool = True, config: Config | None = None) -> DataFrame:
    """(path, rel_path, kind, size, mtime) of the media files under root; the files' bytes are never read."""
    base = root.rstrip("/") + (f"/{folder.strip('/')}" if folder else "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "length", "modificationTime")
    out = files.withColumn("kind", kind_of(F.col("path"))).where("kind is not null")
    if not include_video:
        out = out.where("kind <> 'video'")
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    top = "/" + root.split(":", 1)[-1].strip("/")
    out = out.select("path", F.substring(plain, F.lit(len(top) + 2), F.length(plain)).alias("rel_path"), "kind", F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"))
    return out if config is None else out.where(~skipped(config))


def content_digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def fingerprint(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, size, mtime, sha256) of all files, for comparing a library with itself."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    top = "/" + root.split(":", 1)[-1].strip("/")
    return files.select(F.substring(plain, F.lit(len(top) + 2), F.length(plain)).alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").cast("long").alias("mtime"), content_digest(F.col("content")).alias("sha256"))


def read_images(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Decoded pictures; those that can't be decoded stay as rows without pixels."""
    return spark.read.format("image").option("dropInvalid", False).load(path if isinstance(path, str) else list(path))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog with all columns of the schema; an empty one where none was written yet."""
    try:
        return evolve(spark.read.option("mergeSchema", True).parquet(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CATALOG)


def write_keyed(catalog: DataFrame, path: str, buckets: int = 200) -> None:
    """A snapshot dealt into buckets by file (column `_file`) and sorted by it: joins by file read it where it lies."""
    spark = catalog.sparkSession
    rows = keyed(catalog)
    name = f"keyed_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "_file").sortBy("_file").option("path", path).mode("overwrite").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    spark.createDataFrame([(buckets, kinds)], "buckets int, columns string").coalesce(1).write.mode("overwrite").json(f"{path}/_layout")


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of `write_keyed`, with its layout."""
    layout = spark.read.schema("buckets int, columns string").json(f"{path}/_layout").first()
    name = f"keyed_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({layout['columns']}) USING parquet CLUSTERED BY (_file) SORTED BY (_file) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_catalog(catalog: DataFrame, path: str) -> None:
    """A new snapshot; sorted within files by path, so that lookups prune."""
    catalog.sortWithinPartitions("path").write.mode("overwrite").parquet(path)


def read_tags(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tags as (key, tags), one row with the numbers of dropped values and elements)."""
    pairs = object_entries(spark, path).select("key", "value")
    pairs = pairs.withColumn("is_list", F.schema_of_variant("value").startswith("ARRAY"))
    lists = pairs.where("is_list").select("key", F.try_variant_get("value", "$", "array<variant>").alias("items"))
    keep = F.filter("items", lambda x: F.schema_of_variant(x) == "STRING")
    tags = lists.select("key", F.transform(keep, lambda x: F.try_variant_get(x, "$", "string")).alias("tags"))
    dropped = pairs.agg(F.count_if(~F.col("is_list")).alias("dropped_values")).withColumn("_k", F.lit(1)).join(lists.agg(F.coalesce(F.sum(F.size("items") - F.size(keep)), F.lit(0)).alias("dropped_elements")).withColumn("_k", F.lit(1)), "_k").drop("_k")
    return tags, dropped


def read_web_tags(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tags as (photo_id, tags), one row with the numbers of dropped values and elements); keys that are no ids are dropped, too."""
    tags, dropped = read_tags(spark, path)
    ident = F.lower("key").rlike("^[0-9a-f]{16}$")
    wrong = tags.agg(F.count_if(~ident).alias("dropped_keys")).withColumn("_k", F.lit(1))
    return tags.where(ident).select(F.lower("key").alias("photo_id"), "tags"), dropped.withColumn("_k", F.lit(1)).join(wrong, "_k").drop("_k")


#: A request to set or take back a heart, as it is logged.
HEART_LOG = "photo_id string, token string, action string, ts long, seq long"


def read_heart_log(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Logged requests: JSON lines or Parquet."""
    return spark.read.schema(HEART_LOG).option("recursiveFileLookup", True).format(kind).load(path)


def stream_heart_log(spark: SparkSession, path: str, kind: str = "json", files_per_batch: int = 1000) -> DataFrame:
    """The same log as it grows; a batch has so many files at most."""
    reader = spark.readStream.schema(HEART_LOG).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
    return reader.format(kind).load(path)


MANIFEST = "photo_id string, kind string, local_sha string, url_path string, filename string, uploaded_at long"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """What was uploaded: the latest entry of each photo and kind; none where nothing was written yet."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], MANIFEST)
    return manifest_put(rows.limit(0), rows)


def append_manifest(entries: DataFrame, path: str) -> None:
    """Adds entries; read_manifest takes the latest, so nothing is rewritten."""
    entries.select(*(c.split()[0] for c in MANIFEST.split(", "))).write.mode("append").parquet(path)


def report_table(rows: DataFrame) -> DataFrame:
    """The report's columns with size, date, time and joined tags."""
    tags = F.array_join("tags", "; ") if "tags" in rows.columns else F.lit("")
    return rows.select(*REPORT_COLUMNS, megapixels(F.col("width"), F.col("height")).alias("megapixels"), pretty_date(F.col("taken_at")).alias("taken_date"), pretty_time(F.col("taken_at")).alias("taken_time"), tags.alias("tags"))


def write_report(rows: DataFrame, path: str) -> None:
    report_table(catalog_order(rows)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_shortlist(rows: DataFrame, config: Config, path: str) -> None:
    """The report's columns for the shortlist's rows."""
    write_report(shortlist(rows, config), path)


def write_calibration(spark: SparkSession, config: Config, path: str) -> None:
    fitted = {k: v for k, v in asdict(config).items() if k in ("aesthetic_range", "nima_range", "bands", "w_aesthetic", "w_technical", "w_subject", "keeper_count")}
    spark.createDataFrame([(json.dumps(fitted),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_calibration(spark: SparkSession, path: str, config: Config) -> Config:
    """Known keys applied; the config as it is where the file can't be read."""
    try:
        text = "".join(r[0] for r in spark.read.text(path).collect())
        values = json.loads(text)
    except (AnalysisException, ValueError):
        return config
    if not isinstance(values, dict):
        return config
    allowed = ("aesthetic_range", "nima_range", "bands", "w_aesthetic", "w_technical", "w_subject", "keeper_count")
    clean = {k: tuple(map(tuple, v)) if k == "bands" else tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in allowed}
    return config.with_values(clean)


def write_payload(entries: DataFrame, path: str) -> None:
    """The gallery's entries as JSON lines, one object for each photo."""
    entries.select(entry_json(F.col("entry")).alias("value")).write.mode("overwrite").text(path)
