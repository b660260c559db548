"""The catalog's life: admission, resuming, upserts, deletions, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.paths import below_floor, in_folders, is_hidden
from ..functions.scoring import blank
from ..schema import CATALOG, KEPT_ON_UPSERT


def fine(c: str = "error") -> Column:
    """Without an error."""
    return blank(F.col(c)).isNull()


def keepers(catalog: DataFrame) -> DataFrame:
    return catalog.where(fine() & blank(F.col("dup_of")).isNull() & F.col("aesthetic_raw").isNotNull())


def shortlist(catalog: DataFrame, config: Config) -> DataFrame:
    return catalog.where(F.col("verdict").isin(*config.shortlist) & blank(F.col("dup_of")).isNull())


def strong_rows(catalog: DataFrame, config: Config) -> DataFrame:
    """The two best verdicts, duplicates flagged but kept."""
    return catalog.where(fine() & F.col("verdict").isin(*config.shortlist)).withColumn("is_duplicate", blank(F.col("dup_of")).isNotNull())


def undated_frames(catalog: DataFrame) -> DataFrame:
    return catalog.where((F.col("source_type") == "video_frame") & blank(F.col("source_video")).isNotNull() & blank(F.col("taken_at")).isNull() & fine())


def outside_environments(listing: DataFrame, marker: str = "pyvenv.cfg", children: tuple[str, ...] = ("lib", "lib64", "include", "scripts", "bin", "share", "etc")) -> DataFrame:
    """listing (rel_path) without what lies in the named folders of a folder that holds the marker file."""
    folder = lambda p: F.regexp_replace(p, "(^|/)[^/]*$", "")
    homes = listing.where(F.regexp_extract("rel_path", "[^/]*$", 0) == marker).select(folder(F.col("rel_path")).alias("home")).distinct()
    p = F.split("rel_path", "/")
    step = F.sequence(F.lit(1), F.size(p) - 1)
    inner = F.transform(step, lambda k: F.struct(F.array_join(F.slice(p, F.lit(1), k - 1), "/").alias("home"), F.lower(F.element_at(p, k)).alias("child")))
    above = listing.where(F.size(p) > 1).select("rel_path", F.explode(inner).alias("x")).where(F.col("x.child").isin(*children)).select("rel_path", "x.home")
    return listing.join(above.join(homes, "home", "left_semi"), "rel_path", "left_anti")


def admit(listing: DataFrame, sizes: DataFrame, floor: int) -> DataFrame:
    """listing with width, height and too_small; sizes are (path, width, height), unknown for files that can't be probed."""
    return listing.join(sizes, "path", "left").withColumn("too_small", below_floor(F.col("width"), F.col("height"), floor))


def report_rows(catalog: DataFrame, config: Config, listing: DataFrame | None = None) -> DataFrame:
    """Rows with why they are left out (`dropped`: hidden, too_small, missing, or NULL for those that stay)."""
    rows = catalog if listing is None else flag_existing(catalog, listing)
    hidden = is_hidden(F.coalesce(blank(F.col("rel_path")), F.col("path")), config.hide_folder)
    missing = F.lit(False) if listing is None else ~F.col("exists")
    reason = F.when(hidden, "hidden").when(below_floor(F.col("width"), F.col("height"), config.min_edge), "too_small").when(missing, "missing")
    return rows.withColumn("dropped", reason)


def real_path() -> Column:
    return F.coalesce(blank(F.col("source_video")), F.col("path"))


def keyed(catalog: DataFrame) -> DataFrame:
    """catalog with `_file`, the file that a row is of: its clip's path, or its own. A stored layout has it and is dealt by it, so
    that joins by file need not shuffle the catalog.
    """
    return catalog if "_file" in catalog.columns else catalog.withColumn("_file", real_path())


def resume_todo(listing: DataFrame, catalog: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    """Files to measure: not those with an error-free row of the same size and time, nor clips with any error-free frame."""
    todo = listing
    if not force:
        done = keyed(catalog).where(fine()).select("_file", blank(F.col("source_video")).isNotNull().alias("_frame"), F.col("mtime").alias("_m"), F.col("size").alias("_s"))
        same = (F.abs(todo["mtime"] - F.col("_m")) < 1.0) & (todo["size"] == F.col("_s"))
        todo = todo.join(done, (todo["path"] == F.col("_file")) & (F.col("_frame") | same), "left_anti")
    return todo if limit is None else todo.orderBy("path").limit(limit)


def flag_existing(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    here = listing.select(F.col("path").alias("_p")).distinct().withColumn("_here", F.lit(True))
    out = keyed(catalog).join(here, F.col("_file") == F.col("_p"), "left").withColumn("exists", F.coalesce("_here", F.lit(False)))
    return out.select(*catalog.columns, "exists")


def existing_only(catalog: DataFrame, listing: DataFrame | None) -> DataFrame:
    """Rows whose file, or clip, is listed; all rows if the library can't be listed."""
    return catalog if listing is None else flag_existing(catalog, listing).where("exists").drop("exists")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """new rows replace old ones by path, but for the names and the extracted file, which stay. Of a layout by file, rows of a path
    stay with its file.
    """
    o, n = old.alias("o"), (keyed(new) if "_file" in old.columns else new).alias("n")
    same = F.col("o.path") == F.col("n.path")
    if "_file" in old.columns:
        # only the file is a key of the join, as the layout is dealt by nothing else
        same = (F.col("o._file") == F.col("n._file")) & (F.col("o.path") >= F.col("n.path")) & (F.col("o.path") <= F.col("n.path"))
    both = o.join(n, same, "full")
    is_new = F.col("n.path").isNotNull()

    def pick(c: str) -> Column:
        if c in KEPT_ON_UPSERT:
            return F.when(F.col("o.path").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*(pick(c).alias(c) for c in old.columns))


def forget(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    return catalog.join(paths.select("path").distinct(), "path", "left_anti")


def forget_video(catalog: DataFrame, clips: DataFrame) -> DataFrame:
    """Drops a clip's frames and the clip's own row."""
    gone = clips.select(F.col("path").alias("_clip")).distinct()
    return catalog.join(gone, catalog["path"] == gone["_clip"], "left_anti").join(gone, catalog["source_video"] == gone["_clip"], "left_anti")


def union_all(stills: DataFrame, frames: DataFrame) -> DataFrame:
    return stills.unionByName(frames, allowMissingColumns=True)


def evolve(catalog: DataFrame) -> DataFrame:
    """All columns of the schema, in order; rows of old catalogs are stills."""
    out = [(F.col(f.name) if f.name in catalog.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CATALOG]
    return catalog.select(*out).withColumn("source_type", F.coalesce("source_type", F.lit("photo")))


def library_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rel_path, change) between two fingerprints (rel_path, size, mtime, sha256)."""
    a, b = before.alias("a"), after.alias("b")
    same = F.lit(True)
    for c in ("size", "mtime", "sha256"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    change = F.when(F.col("a.rel_path").isNull(), "added").when(F.col("b.rel_path").isNull(), "removed").when(~same, "changed")
    return a.join(b, F.col("a.rel_path") == F.col("b.rel_path"), "full").select(F.coalesce("a.rel_path", "b.rel_path").alias("rel_path"), change.alias("change")).where("change is not null")


def skipped(config: Config) -> Column:
    return in_folders(F.col("rel_path"), config.skip_folders)
