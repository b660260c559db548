"""One query for each family of operators, with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import dates, paths, scoring, tags as tag_functions
from ..operators import calibrate, catalog as cat, dedup, hearts, measure, publish, report, search, video
from ..operators.components import scratch, stored
from ..operators.order import numbered
from ..sources import files
from . import derived as d
from .derived import CONFIG

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
R = "WITH RECURSIVE"


def query(sql: str | None = None, tables: str = d.CATALOG_SQL) -> Callable:
    """Registers a query under its name, with SQL over the side tables."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {tables} {sql}" if tables else sql
        return f

    return put


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _placed(ordered: DataFrame) -> DataFrame:
    """Ordered rows with `place`, from 1, as they stand: ids rise along the order."""
    return numbered(ordered.withColumn("_at", F.monotonically_increasing_id()), "place", F.col("_at")).withColumn("place", F.col("place") + 1).drop("_at")


def _folder(s: SparkSession, name: str) -> str:
    return f"{scratch(s)}/{name}-{uuid.uuid4().hex}"


@query("SELECT path, round(composite, 6) AS composite, verdict, note FROM cat WHERE measured")
def score_catalog(s, sf):
    return d.catalog(s, sf).where("error is null and aesthetic_raw is not null").select("path", _r("composite"), "verdict", "note")


@query("SELECT verdict, count(*) AS n, round(min(composite), 6) AS low, round(max(composite), 6) AS high FROM cat WHERE measured GROUP BY verdict")
def verdict_bands(s, sf):
    return d.catalog(s, sf).where("composite is not null").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("composite"), 6).alias("low"), F.round(F.max("composite"), 6).alias("high"))


@query("SELECT path, CASE WHEN fault IS NULL OR NOT measured THEN note ELSE substr(note, 1, length(note) - length(fault) - 3) END AS facts, CASE WHEN measured THEN coalesce(fault, '') ELSE '' END AS fault FROM cat")
def notes(s, sf):
    facts, fault = scoring.split_note(F.col("note"), CONFIG)
    return d.catalog(s, sf).select("path", facts.alias("facts"), fault.alias("fault"))


@query("SELECT path, round(composite, 6) AS composite FROM cat WHERE error IS NULL AND aesthetic_raw IS NOT NULL")
def keepers(s, sf):
    return cat.keepers(d.catalog(s, sf)).select("path", _r("composite"))


#: Reports over a catalog that has duplicates, by plain arithmetic.
DUP = ", dup AS (SELECT *, k % 43 = 0 AS is_dup FROM cat)"
STATS = """count(*) FILTER (error IS NULL) AS total, count(*) FILTER (error IS NULL AND NOT is_dup AND verdict = 'TOP PICK') AS top, count(*) FILTER (error IS NULL AND NOT is_dup AND verdict = 'STRONG') AS strong,
 count(*) FILTER (error IS NULL AND NOT is_dup AND verdict = 'MAYBE') AS maybe, count(*) FILTER (error IS NULL AND is_dup) AS dups, count(DISTINCT folder) AS folders, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (error IS NULL AND source_type = 'photo') AS photos,
 count(*) FILTER (error IS NULL AND source_type = 'video_frame') AS video_frames, count(DISTINCT source_video) AS clips, count(*) FILTER (error IS NULL AND extracted_path IS NOT NULL) AS extracted"""


def _with_dups(s, sf) -> DataFrame:
    return d.catalog(s, sf).withColumn("dup_of", F.when(d.number() % 43 == 0, "/lib/keeper.jpg"))


@query(f"{DUP} SELECT {STATS} FROM dup")
def report_stats(s, sf):
    return report.report_stats(_with_dups(s, sf), CONFIG)


@query(f"{DUP} SELECT {STATS}, count(*) FILTER (error IS NULL AND NOT is_dup AND verdict IN ('TOP PICK', 'STRONG')) AS shortlisted, count(*) FILTER (error IS NULL AND is_dup AND verdict IN ('TOP PICK', 'STRONG')) AS hidden_dups FROM dup")
def strong_stats(s, sf):
    return report.strong_stats(_with_dups(s, sf), CONFIG)


NODES = "nodes AS (SELECT DISTINCT h FROM cat WHERE error IS NULL)"
PAIRS = f"{NODES}, pairs AS (SELECT a.h AS a, b.h AS b, bit_count(xor(a.h, b.h)) AS distance FROM nodes a JOIN nodes b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 5)"


@query(f", {PAIRS} SELECT a, b, CAST(distance AS INT) AS distance FROM pairs")
def near_dup_pairs(s, sf):
    return dedup.near_pairs(dedup.hashed_rows(d.raw_catalog(s, sf)).select("h").distinct(), CONFIG.hamming)


def _groups(s, sf):
    return dedup.duplicate_groups(d.catalog(s, sf), CONFIG.hamming)


REACH = f"""{PAIRS}, links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs UNION ALL SELECT h, h FROM nodes),
reach(n, m) AS (SELECT a, b FROM links UNION SELECT r.n, l.b FROM reach r JOIN links l ON r.m = l.a),
roots AS (SELECT n, min(m) AS g FROM reach GROUP BY n),
grp AS (SELECT path, composite, g, count(*) OVER (PARTITION BY g) AS group_size, first_value(path) OVER (PARTITION BY g ORDER BY composite DESC NULLS LAST, path) AS keeper FROM cat JOIN roots ON n = h WHERE error IS NULL)"""


@query(f", {REACH} SELECT path, g AS group_id, group_size, keeper FROM grp WHERE group_size > 1")
def dup_groups(s, sf):
    return _groups(s, sf)


FLAGGED = f"{REACH}, flagged AS (SELECT c.*, CASE WHEN group_size > 1 AND keeper <> c.path THEN keeper END AS dup_of FROM cat c LEFT JOIN grp ON grp.path = c.path)"


def _flagged(s, sf) -> DataFrame:
    return dedup.flag_duplicates(d.catalog(s, sf), _groups(s, sf))


@query(f", {FLAGGED} SELECT path, dup_of FROM flagged")
def flag_duplicates(s, sf):
    return _flagged(s, sf).select("path", "dup_of")


@query(f", {FLAGGED} SELECT path, dup_of IS NOT NULL AS is_duplicate FROM flagged WHERE error IS NULL AND verdict IN ('TOP PICK', 'STRONG')")
def strong_rows(s, sf):
    return cat.strong_rows(_flagged(s, sf), CONFIG).select("path", "is_duplicate")


@query(f", {FLAGGED} SELECT path FROM flagged WHERE verdict IN ('TOP PICK', 'STRONG') AND dup_of IS NULL")
def shortlist(s, sf):
    return cat.shortlist(_flagged(s, sf), CONFIG).select("path")


@query(f", {REACH} SELECT n AS h, g AS root FROM roots")
def arriving_hashes(s, sf):
    """Groups of hashes, a part of which came later."""
    rows = dedup.hashed_rows(d.raw_catalog(s, sf)).withColumn("late", d.number() % 50 == 7)
    old = stored(rows.where("not late").select("h").distinct())
    masks = dedup.band_masks(CONFIG.hamming, max(2, old.count()))
    return dedup.extended_roots(dedup.hash_roots(old, CONFIG.hamming), dedup.probes(old, masks), rows.where("late").select("h"), CONFIG.hamming, masks)


for name in ("dup_groups", "flag_duplicates", "strong_rows", "shortlist", "arriving_hashes"):
    ORACLE[name] = ORACLE[name].replace("WITH", R, 1)


def _at(x: str, q: str, n: str) -> str:
    return f"list_sort(list({x}) FILTER ({x} IS NOT NULL))[1 + CAST(round_even({q} * ((SELECT {n} FROM n) - 1), 0) AS BIGINT)]"


FIT = f"""
n AS (SELECT count(*) AS n, count(nima_raw) AS m FROM cat WHERE measured),
rng AS (SELECT {_at("aesthetic_raw", "0.02e0", "n")} AS a_low, {_at("aesthetic_raw", "0.99e0", "n")} AS a_high, {_at("nima_raw", "0.02e0", "m")} AS n_low, {_at("nima_raw", "0.99e0", "m")} AS n_high FROM cat WHERE measured),
refit AS (SELECT cat.*, CAST(greatest(0.0, least(100.0, greatest(0.0, least(100.0, (aesthetic_raw - a_low) / (a_high - a_low) * 1e2)) * 0.6e0
  + CASE WHEN nima_raw IS NULL THEN greatest(0.0, least(100.0, ln(1 + sharpness) / ln(801.0) * 100.0)) ELSE greatest(0.0, least(100.0, (nima_raw - n_low) / (n_high - n_low) * 1e2)) END * 0.25e0
  + subject_score * 0.15e0 - pen - CASE WHEN source_type = 'video_frame' THEN 6.0 ELSE 0.0 END)) AS DOUBLE) AS fitted FROM cat, rng WHERE measured),
b AS (SELECT {_at("fitted", "0.95e0", "n")} AS b1, {_at("fitted", "0.80e0", "n")} AS b2, {_at("fitted", "0.50e0", "n")} AS b3 FROM refit)"""


@query(f", {FIT} SELECT a_low, a_high, n_low, n_high, round(b1, 6) AS top, round(b2, 6) AS strong, round(b3, 6) AS maybe, n AS keeper_count FROM rng, b, n")
def calibration(s, sf):
    rows = d.catalog(s, sf)
    c = calibrate.calibrate(rows, CONFIG) or CONFIG
    limits = [b for b, _ in c.bands]
    one = s.range(1).select(*(F.lit(float(v)).alias(k) for k, v in zip(("a_low", "a_high", "n_low", "n_high"), (*c.aesthetic_range, *c.nima_range), strict=True)), *(F.round(F.lit(float(v)), 6).alias(k) for k, v in zip(("top", "strong", "maybe"), limits, strict=False)), F.lit(c.keeper_count).cast("long").alias("keeper_count"))
    return one


@query(f", {FIT} SELECT path, round(fitted, 6) AS composite, CASE WHEN fitted >= b1 THEN 'TOP PICK' WHEN fitted >= b2 THEN 'STRONG' WHEN fitted >= b3 THEN 'MAYBE' ELSE 'PASS' END AS verdict FROM refit, b")
def recompute(s, sf):
    rows = d.catalog(s, sf)
    fitted = calibrate.calibrate(rows, CONFIG) or CONFIG
    return scoring.recompute(rows, fitted).where("error is null and aesthetic_raw is not null").select("path", _r("composite"), "verdict")


@query("SELECT min(aesthetic_raw) AS aesthetic_min, max(aesthetic_raw) AS aesthetic_max, count(aesthetic_raw) AS aesthetic_n, min(nima_raw) AS nima_min, max(nima_raw) AS nima_max, count(nima_raw) AS nima_n FROM cat WHERE measured")
def observed_range(s, sf):
    return calibrate.observed_range(d.catalog(s, sf))


BEST = "best AS (SELECT path, source_video, timestamp_s, composite, row_number() OVER (PARTITION BY source_video ORDER BY composite DESC, path) AS rank FROM cat WHERE source_type = 'video_frame' AND error IS NULL AND composite >= 66)"


@query(f", {BEST} SELECT path, source_video, timestamp_s, round(composite, 6) AS composite, CAST(rank AS INT) AS rank, stem || '/' || stem || '_' || lpad(printf('%.2f', timestamp_s), 8, '0') || 's_' || printf('%.0f', composite) || '.jpg' AS dest FROM (SELECT *, regexp_extract(source_video, '([^/]*)[.][^.]*$', 1) AS stem FROM best) WHERE rank <= 12")
def extraction_plan(s, sf):
    return video.extraction_plan(d.catalog(s, sf), CONFIG).withColumn("composite", F.round("composite", 6))


@query(f", {d.LISTING_SQL} SELECT l.path, l.kind FROM listing l WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.path = l.path AND abs(c.mtime - l.mtime) < 1.0 AND c.size = l.size AND error IS NULL) AND NOT EXISTS (SELECT 1 FROM cat c WHERE c.source_video = l.path AND error IS NULL)")
def resume_todo(s, sf):
    return cat.resume_todo(d.listing(s, sf), d.catalog(s, sf)).select("path", "kind")


NEW = "new AS (SELECT path, 'renamed' AS filename, size + 7 AS size, CASE WHEN k % 2 = 0 THEN 'bad' END AS error, 'lost.jpg' AS extracted_path FROM cat WHERE k % 3 = 0 UNION ALL SELECT path || '.new', filename, size, NULL, NULL FROM cat WHERE k % 50 = 0)"


@query(f", {NEW} SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NOT NULL THEN o.filename ELSE n.filename END AS filename, CASE WHEN n.path IS NOT NULL THEN n.size ELSE o.size END AS size, CASE WHEN n.path IS NOT NULL THEN n.error ELSE o.error END AS error, CASE WHEN o.path IS NOT NULL THEN o.extracted_path ELSE n.extracted_path END AS extracted_path FROM cat o FULL JOIN new n ON n.path = o.path")
def upsert_catalog(s, sf):
    old = d.catalog(s, sf)
    k = F.regexp_extract("path", "IMG_([0-9]+)", 1).try_cast("long")
    again = old.where(k % 3 == 0).withColumns({"filename": F.lit("renamed"), "size": F.col("size") + 7, "error": F.when(k % 2 == 0, "bad"), "extracted_path": F.lit("lost.jpg")})
    fresh = old.where(k % 50 == 0).withColumns({"path": F.concat("path", F.lit(".new")), "error": F.lit(None).cast("string"), "extracted_path": F.lit(None).cast("string")})
    return cat.upsert(old, again.unionByName(fresh)).select("path", "filename", "size", "error", "extracted_path")


@query("SELECT path FROM cat WHERE NOT (k % 4 = 0) AND NOT coalesce(source_video IN (SELECT DISTINCT source_video FROM cat WHERE k % 35 = 0), FALSE)")
def forget_rows(s, sf):
    rows = d.catalog(s, sf)
    k = F.regexp_extract("path", "IMG_([0-9]+)", 1).try_cast("long")
    clips = rows.where(k % 35 == 0).select(F.col("source_video").alias("path"))
    return cat.forget_video(cat.forget(rows, rows.where(k % 4 == 0)), clips).select("path")


@query(f", {d.LISTING_SQL} SELECT path FROM cat WHERE coalesce(source_video, path) IN (SELECT path FROM listing)")
def existing_only(s, sf):
    return cat.existing_only(d.catalog(s, sf), d.listing(s, sf)).select("path")


@query(f", {d.LISTING_SQL} SELECT path, CASE WHEN folder LIKE '%/_hidden' THEN 'hidden' WHEN least(width, height) < 500 AND width IS NOT NULL THEN 'too_small' WHEN coalesce(source_video, path) NOT IN (SELECT path FROM listing) THEN 'missing' END AS dropped FROM cat")
def report_rows(s, sf):
    return cat.report_rows(d.catalog(s, sf), CONFIG, d.listing(s, sf)).select("path", "dropped")


@query("SELECT path FROM cat WHERE list_contains(list_transform(string_split(rel_path, '/'), lambda x: lower(trim(x))), '_hidden')")
def hidden_paths(s, sf):
    return d.catalog(s, sf).where(paths.is_hidden(F.col("rel_path"), CONFIG.hide_folder)).select("path")


@query("SELECT path, coalesce(least(width, height) < 500 AND width IS NOT NULL, FALSE) AS too_small FROM cat")
def size_floor(s, sf):
    rows = d.catalog(s, sf)
    return cat.admit(rows.select("path"), rows.select("path", "width", "height"), CONFIG.min_edge).select("path", "too_small")


#: Folders are a date, ' - ' and a name here, which RE2 can take apart without lookarounds.
GALLERY = "CASE WHEN folder = '(root)' THEN 'Unfiled' ELSE regexp_replace(string_split(folder, '/')[1], '^[0-9]{4}-[0-9]{2}-[0-9]{2} - ', '') END"


@query(f"SELECT DISTINCT folder, string_split(folder, '/')[1] AS top, {GALLERY} AS gallery, regexp_replace(folder, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} - ', '') AS shown FROM cat")
def folder_groups(s, sf):
    f = F.col("folder")
    return d.catalog(s, sf).select("folder").distinct().select("folder", paths.top_folder(f).alias("top"), paths.folder_group(f).alias("gallery"), paths.strip_folder_date(f).alias("shown"))


@query("SELECT top AS folder, CASE WHEN top IS NOT NULL THEN regexp_replace(top, '^[0-9]{4}-[0-9]{2}-[0-9]{2} - ', '') END AS shown, count(*) AS images FROM (SELECT string_split(folder, '/')[1] AS top FROM cat WHERE error IS NULL) GROUP BY ROLLUP (top)")
def folder_counts(s, sf):
    return report.folder_counts(d.catalog(s, sf))


COVERS = f"g AS (SELECT *, {GALLERY} AS gallery FROM cat), cov AS (SELECT gallery, path, CAST(row_number() OVER (PARTITION BY gallery ORDER BY composite DESC NULLS LAST, path) AS INT) AS rank FROM g)"
IDS = "substr(sha256(lower(rel_path)), 1, 16)"


@query(f", {COVERS} SELECT gallery, path, rank FROM cov WHERE rank <= 4")
def top4_covers(s, sf):
    return report.covers(d.catalog(s, sf)).select("gallery", "path", "rank")


@query(f", {COVERS}, t AS (SELECT gallery, count(*) AS images, min(substr(taken_at, 1, 10)) AS oldest, max(substr(taken_at, 1, 10)) AS newest, CAST(sum(k % 3) AS BIGINT) AS likes, round(max(composite), 6) AS best FROM g GROUP BY gallery) SELECT t.*, (SELECT string_agg(path, '|' ORDER BY rank) FROM cov WHERE cov.gallery = t.gallery AND rank <= 4) AS covers, CASE WHEN oldest IS NULL THEN '' WHEN substr(oldest, 1, 4) = substr(newest, 1, 4) THEN substr(oldest, 1, 4) ELSE substr(oldest, 1, 4) || '–' || substr(newest, 1, 4) END AS years FROM t")
def folder_tiles(s, sf):
    rows = d.catalog(s, sf).withColumn("photo_id", paths.photo_id(F.col("rel_path")))
    likes = rows.select("photo_id", (F.regexp_extract("path", "IMG_([0-9]+)", 1).try_cast("long") % 3).alias("hearts"))
    return report.folder_tiles(rows, likes).withColumns({"covers": F.array_join("covers", "|"), "best": F.round("best", 6)})


@query(f", {d.TAGS_SQL}, x AS (SELECT key, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM tags) SELECT arg_min(tag, (key, pos)) AS tag, count(DISTINCT key) AS photos FROM x GROUP BY lower(tag)")
def tag_counts(s, sf):
    return report.tag_counts(d.tags(s, sf))


@query(f", {d.TAGS_SQL} SELECT path FROM cat JOIN tags ON key = path WHERE error IS NULL AND list_has_any(list_transform(tags, lambda x: lower(x)), ['the', 'de', 'der'])")
def tag_filter(s, sf):
    rows = report.attach_tags(d.catalog(s, sf), d.tags(s, sf))
    return rows.where(report.card_filter(tags=("The", "DE", "der"))).select("path")


@query(f"{DUP} SELECT path FROM dup WHERE error IS NULL AND NOT is_dup AND k % 3 > 0 AND verdict = 'MAYBE'")
def liked_only(s, sf):
    rows = _with_dups(s, sf).withColumn("hearts", d.number() % 3)
    return rows.where(report.card_filter(verdict="MAYBE", liked=True)).select("path")


@query(f", {d.TAGS_SQL} SELECT path, CASE WHEN tags IS NOT NULL THEN array_to_string(tags, '|') WHEN source_video IS NOT NULL THEN 'clip|' || source_video ELSE '' END AS tags FROM cat LEFT JOIN tags ON key = path")
def clip_tags(s, sf):
    rows = d.catalog(s, sf)
    clips = rows.where("source_video is not null").select(F.col("source_video").alias("key")).distinct().withColumn("tags", F.array(F.lit("clip"), F.col("key")))
    return report.attach_tags(rows, d.tags(s, sf).unionByName(clips)).select("path", F.array_join("tags", "|").alias("tags"))


@query(f", {d.TAGS_SQL} SELECT path FROM cat LEFT JOIN tags ON key = path WHERE error IS NULL AND source_type = 'photo' AND verdict = 'MAYBE' AND (contains(lower(folder), 'urgent') OR contains('|' || lower(coalesce(array_to_string(tags, '|'), '')) || '|', 'urgent'))")
def text_search(s, sf):
    cards = d.catalog(s, sf).select("path", "folder", "filename", "taken_at", "verdict", "width", "height", "note", "error", "dup_of", "source_type", "source_video")
    rows = stored(report.attach_tags(cards, d.tags(s, sf)))
    index = _folder(s, "search")
    search.write_index(rows, index)
    return search.search_cards(rows, index, "URGENT", report.card_filter(verdict="MAYBE", kind="photo", duplicates=True)).select("path")


SORT = "row_number() OVER (ORDER BY {c} IS NULL, {c} {o}, composite DESC NULLS LAST, path)"


@query(f"SELECT path, {SORT.format(c='taken_at', o='ASC')} AS place FROM cat WHERE verdict = 'TOP PICK'")
def sort_cards(s, sf):
    rows = d.catalog(s, sf).where("verdict = 'TOP PICK'").select("path", "composite", "taken_at", "folder", "filename")
    return _placed(report.sort_cards(rows, "date", False)).select("path", "place")


@query("SELECT path, row_number() OVER (ORDER BY k % 5 DESC, composite DESC NULLS LAST, path) AS place FROM cat WHERE verdict = 'STRONG'")
def sort_cards_by_hearts(s, sf):
    rows = d.catalog(s, sf).where("verdict = 'STRONG'").select("path", "composite", "taken_at", "folder", "filename", (d.number() % 5).alias("hearts"))
    return _placed(report.sort_cards(rows, "hearts")).select("path", "place")


@query("SELECT path, row_number() OVER (ORDER BY composite DESC NULLS LAST, path) AS place FROM cat")
def catalog_order(s, sf):
    return _placed(report.catalog_order(d.catalog(s, sf).select("path", "composite"))).select("path", "place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey % 2, p_partkey) AS place FROM part", "")
def natural_order(s, sf):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "Sh\u00f6ot ").otherwise("shoot "), F.when(k % 2 == 0, F.lit("0")).otherwise(F.lit("1")), F.lit("-"), F.when(k % 5 == 0, F.concat(F.lit("000"), k.cast("string"))).otherwise(k.cast("string")), F.lit("0" * 25))
    rows = d.read(s, sf, "part").select("p_partkey", name.alias("name"))
    return _placed(rows.orderBy(report.natural_key(F.col("name")))).select("p_partkey", "place")


@query(f"SELECT path, {IDS} AS photo_id, substr(sha1(path), 1, 20) || '.jpg' AS thumb, 'psc-' || {IDS} || '-t.jpg' AS upload FROM cat")
def photo_ids(s, sf):
    i = paths.photo_id(F.col("rel_path"))
    return d.catalog(s, sf).select("path", i.alias("photo_id"), paths.thumb_name(F.col("path")).alias("thumb"), paths.upload_filename(i, F.lit("thumb")).alias("upload"))


SHORT = f"short AS (SELECT *, {IDS} AS photo_id, {GALLERY} AS gallery FROM cat WHERE verdict IN ('TOP PICK', 'STRONG'))"
FILES = f"{SHORT}, files AS (SELECT photo_id, kind, CASE WHEN k % 13 <> 0 THEN sha256(kind || CAST(k % 7 AS VARCHAR)) END AS local_sha, k % 900 AS bytes FROM short, (VALUES ('thumb'), ('preview')) v(kind)), manifest AS (SELECT photo_id, kind, sha256(kind || CAST(k % 14 AS VARCHAR)) AS local_sha, '/u' AS url_path, 'f' AS filename, CAST(1 AS BIGINT) AS uploaded_at FROM (SELECT * FROM short WHERE k % 3 <> 0 UNION ALL SELECT *, {IDS}, {GALLERY} FROM cat WHERE verdict = 'MAYBE' AND k % 100 = 1), (VALUES ('thumb'), ('preview')) v(kind))"


def _files(s, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = d.catalog(s, sf)
    items = publish.gallery_items(rows, CONFIG)
    k = d.number()
    kinds = F.explode(F.array(F.lit("thumb"), F.lit("preview")))
    files = items.withColumn("k", k).withColumn("kind", kinds).select("photo_id", "kind", F.when(F.col("k") % 13 != 0, F.sha2(F.concat("kind", (F.col("k") % 7).cast("string")), 256)).alias("local_sha"), (F.col("k") % 900).alias("bytes"))
    old = items.where(k % 3 != 0).select("mtime", "photo_id").unionByName(rows.where((F.col("verdict") == "MAYBE") & (k % 100 == 1)).select("mtime", paths.photo_id(F.col("rel_path")).alias("photo_id")))
    manifest = old.withColumn("k", k).withColumn("kind", kinds).select("photo_id", "kind", F.sha2(F.concat("kind", (F.col("k") % 14).cast("string")), 256).alias("local_sha"), F.lit("/u").alias("url_path"), F.lit("f").alias("filename"), F.lit(1).cast("long").alias("uploaded_at"))
    return items, files, manifest


@query(f", {FILES} SELECT f.photo_id, f.kind, CASE WHEN f.local_sha IS NULL THEN 'missing' WHEN m.local_sha = f.local_sha THEN 'reused' ELSE 'upload' END AS status, 'psc-' || f.photo_id || CASE f.kind WHEN 'thumb' THEN '-t.jpg' ELSE '-p.jpg' END AS filename, bytes FROM files f LEFT JOIN manifest m ON m.photo_id = f.photo_id AND m.kind = f.kind")
def upload_plan(s, sf):
    _, files, manifest = _files(s, sf)
    return publish.upload_plan(files, manifest)


@query(f", {FILES} SELECT photo_id, kind FROM manifest WHERE photo_id NOT IN (SELECT photo_id FROM short)")
def orphans(s, sf):
    items, _, manifest = _files(s, sf)
    return publish.orphan_uploads(manifest, items).select("photo_id", "kind")


@query(f", {FILES} SELECT coalesce(f.photo_id, m.photo_id) AS photo_id, coalesce(f.kind, m.kind) AS kind, CASE WHEN f.photo_id IS NOT NULL THEN f.local_sha ELSE m.local_sha END AS local_sha FROM manifest m FULL JOIN (SELECT * FROM files WHERE local_sha IS NOT NULL) f ON m.photo_id = f.photo_id AND m.kind = f.kind")
def manifest_put(s, sf):
    _, files, manifest = _files(s, sf)
    new = files.where("local_sha is not null").select("photo_id", "kind", "local_sha", F.lit("/n").alias("url_path"), F.lit("g").alias("filename"), F.lit(2).cast("long").alias("uploaded_at"))
    return publish.manifest_put(manifest, new).select("photo_id", "kind", "local_sha")


@query(f", {SHORT}, {d.TAGS_SQL} SELECT photo_id, array_to_string(list_sort(list_distinct(tags)), '|') AS tags FROM tags JOIN short ON path = key")
def resolve_tags(s, sf):
    items = publish.gallery_items(d.catalog(s, sf), CONFIG)
    return publish.resolve_tags(d.tags(s, sf), items).select("photo_id", F.array_join("tags", "|").alias("tags"))


WEB = "web AS (SELECT photo_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(CASE WHEN k % 2 = 0 THEN ['b!', ' a', 'b', '', 'n' || k] ELSE ['!!'] END, lambda x: trim(regexp_replace(x, '[^A-Za-z0-9 _-]', '', 'g'))), lambda x: x <> ''))), '|') AS clean FROM short WHERE k % 5 = 1)"


@query(f", {SHORT}, {d.TAGS_SQL}, {WEB}, own AS (SELECT photo_id, array_to_string(list_sort(list_distinct(tags)), '|') AS tags, k FROM tags JOIN short ON path = key) SELECT coalesce(o.photo_id, w.photo_id) AS photo_id, CASE WHEN w.photo_id IS NOT NULL THEN w.clean ELSE o.tags END AS tags FROM own o FULL JOIN web w ON w.photo_id = o.photo_id WHERE w.photo_id IS NULL OR w.clean <> ''")
def merge_web_tags(s, sf):
    items = publish.gallery_items(d.catalog(s, sf), CONFIG)
    own = publish.resolve_tags(d.tags(s, sf), items)
    k = d.number()
    lists = F.when(k % 2 == 0, F.array(*map(F.lit, ("b!", " a", "b", "")), F.concat(F.lit("n"), k.cast("string")))).otherwise(F.array(F.lit("!!")))
    web = items.where(k % 5 == 1).select("photo_id", lists.alias("tags"))
    return publish.merge_web_tags(own, web, items).select("photo_id", F.array_join("tags", "|").alias("tags"))


SHOWN = "regexp_replace(folder, '^[0-9]{4}-[0-9]{2}-[0-9]{2} - ', '')"
SIZE = "CASE WHEN width IS NULL THEN '' ELSE width || ' × ' || height || ' · ' || printf('%.1f', width * height / 1e6) || ' MP' END"
IDX = "idx AS (SELECT gallery, CAST(row_number() OVER (ORDER BY lower(gallery), gallery) - 1 AS INT) AS idx FROM (SELECT DISTINCT gallery FROM short))"
FACTS = "CASE WHEN fault IS NULL THEN note ELSE substr(note, 1, length(note) - length(fault) - 3) END"


@query(f""", {SHORT}, {IDX}, {d.TAGS_SQL}, own AS (SELECT key, array_to_string(list_sort(list_distinct(tags)), '|') AS t FROM tags)
SELECT photo_id AS id, verdict AS v, round(composite, 1) AS s, filename AS n, {SHOWN} AS f, idx AS g, coalesce(taken_at, '') AS d, {SIZE} AS r, {FACTS} AS note, fault AS w, CASE WHEN k % 2 = 0 THEN '/t/' || photo_id WHEN k % 3 = 0 THEN '/p/' || photo_id END AS th, CASE WHEN k % 3 = 0 THEN '/p/' || photo_id WHEN k % 2 = 0 THEN '/t/' || photo_id END AS pv,
CASE WHEN {SHOWN} <> folder THEN folder END AS fr, nullif(t, '') AS t FROM short JOIN idx USING (gallery) LEFT JOIN own ON key = path""")
def payload(s, sf):
    items = publish.gallery_items(d.catalog(s, sf), CONFIG)
    k = d.number()
    urls = items.select("photo_id", F.when(k % 2 == 0, F.concat(F.lit("/t/"), "photo_id")).alias("thumb_url"), F.when(k % 3 == 0, F.concat(F.lit("/p/"), "photo_id")).alias("preview_url"))
    e = publish.payload_entries(items, publish.gallery_index(items), CONFIG, publish.resolve_tags(d.tags(s, sf), items), urls)
    return e.select(*(F.col(f"entry.{c}").alias(c) for c in ("id", "v", "s", "n", "f", "g", "d", "r", "note", "w", "th", "pv", "fr")), F.nullif(F.array_join("entry.t", "|"), F.lit("")).alias("t"))


@query(f", {SHORT} SELECT path, photo_id FROM short ORDER BY composite DESC NULLS LAST, path LIMIT 100")
def publish_limit(s, sf):
    return publish.gallery_items(d.catalog(s, sf), CONFIG, limit=100).select("path", "photo_id")


#: Names whose slugs collide with each other and with numbered ones.
NAMES = "names AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'Set ' || (p_partkey % 11) WHEN 1 THEN 'sét  ' || (p_partkey % 11) || '!' ELSE 'SET-' || (p_partkey % 11) || ' ' || (p_partkey % 4) END AS gallery FROM part)"


@query(f"""WITH RECURSIVE {NAMES}, g AS (SELECT gallery, CAST(row_number() OVER (ORDER BY lower(gallery), gallery) - 1 AS INT) AS idx, trim(regexp_replace(lower(strip_accents(gallery)), '[^a-z0-9]+', '-', 'g'), '-') AS plain FROM names),
step AS (SELECT gallery, idx, plain AS slug, [plain] AS taken FROM g WHERE idx = 0
 UNION ALL SELECT gallery, idx, slug, list_append(taken, slug) FROM (SELECT g.gallery, g.idx, taken, CASE WHEN NOT list_contains(taken, plain) THEN plain ELSE list_filter(list_transform(range(2, 200), lambda n: plain || '-' || n), lambda x: NOT list_contains(taken, x))[1] END AS slug FROM step JOIN g ON g.idx = step.idx + 1))
SELECT gallery, idx, slug FROM step""", "")
def slugs(s, sf):
    k = F.col("p_partkey")
    text = lambda n: (k % n).cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("Set "), text(11))).when(k % 3 == 1, F.concat(F.lit("sét  "), text(11), F.lit("!"))).otherwise(F.concat(F.lit("SET-"), text(11), F.lit(" "), text(4)))
    return publish.gallery_slugs(publish.gallery_index(d.read(s, sf, "part").select(name.alias("gallery"))))


BEST_OF = "best_of AS (SELECT gallery, arg_min(photo_id, (-composite, path)) AS photo_id, CASE count(*) WHEN 1 THEN '1 photograph' ELSE count(*) || ' photographs' END AS description, trim(regexp_replace(lower(gallery), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM short GROUP BY gallery)"


@query(f", {SHORT}, {BEST_OF} SELECT 'https://x.example/g?photo=' || upper(photo_id) AS url, 'photo' AS kind, photo_id, filename AS title FROM short UNION ALL SELECT 'https://x.example/g?photo=&folder=' || upper(slug), 'folder', photo_id, gallery FROM best_of")
def resolve_links(s, sf):
    items = publish.gallery_items(d.catalog(s, sf), CONFIG)
    names = publish.gallery_slugs(publish.gallery_index(items))
    photos = items.select(F.concat(F.lit("https://x.example/g?photo="), F.upper("photo_id")).alias("url"))
    folders = names.select(F.concat(F.lit("https://x.example/g?photo=&folder="), F.upper("slug")).alias("url"))
    urls = photos.unionByName(folders).unionByName(d.read(s, sf, "pages").select("url"))
    return publish.resolve_links(urls, items, names).select("url", "kind", "photo_id", "title")


@query(f", {SHORT}, {BEST_OF} SELECT gallery, photo_id, description FROM best_of")
def folder_preview(s, sf):
    return publish.folder_preview(publish.gallery_items(d.catalog(s, sf), CONFIG))


H = d.REQUESTS_SQL


@query("SELECT seq, reject_reason FROM val", H)
def hearts_valid(s, sf):
    return hearts.validate(d.requests(s, sf), d.allowed(s, sf)).select("seq", "reject_reason")


def _good(s, sf) -> DataFrame:
    ok = hearts.validate(d.requests(s, sf), d.allowed(s, sf)).where("reject_reason is null").drop("reject_reason")
    return hearts.with_voters(ok, "salt")


@query("SELECT photo_id, voter FROM hearts", H)
def heart_state(s, sf):
    return hearts.fold(_good(s, sf)).select("photo_id", "voter")


@query("SELECT photo_id, hearts FROM counts", H)
def heart_counts(s, sf):
    return hearts.heart_counts(hearts.fold(_good(s, sf)))


@query("SELECT photo_id, hearts, coalesce(rel_path, '') AS rel_path FROM (SELECT * FROM counts ORDER BY hearts DESC, photo_id LIMIT 20) JOIN allowed USING (photo_id)", H)
def top_hearts(s, sf):
    return hearts.top_hearts(hearts.heart_counts(hearts.fold(_good(s, sf))), d.allowed(s, sf), 20)


@query("""SELECT photo_id FROM hearts WHERE voter = sha256('salt' || 'token-' || md5('7'))""", H)
def hearts_mine(s, sf):
    voter = s.range(1).select(F.sha2(F.concat(F.lit("salttoken-"), F.md5(F.lit("7"))), 256)).first()[0]
    return hearts.hearts_of(hearts.fold(_good(s, sf)), voter)


@query(""", w AS (SELECT voter, ts, seq, row_number() OVER (PARTITION BY voter ORDER BY ts, seq) AS n FROM good),
step AS (SELECT voter, n, seq, [ts] AS times, TRUE AS accepted FROM w WHERE n = 1
 UNION ALL SELECT voter, n, seq, CASE WHEN len(kept) < 3 THEN list_append(kept, ts) ELSE kept END, len(kept) < 3 FROM (SELECT w.*, list_filter(times, lambda x: x >= w.ts - 86400) AS kept FROM step JOIN w ON w.voter = step.voter AND w.n = step.n + 1))
SELECT seq, accepted FROM step""", H)
def rate_limit(s, sf):
    return hearts.rate_limit(_good(s, sf), Config(heart_limit=3, heart_window=86_400)).select("seq", "accepted")


ORACLE["rate_limit"] = ORACLE["rate_limit"].replace("WITH", R, 1)

CLIPS = "clips AS (SELECT source_video AS path, CAST(count(*) * 7.25 AS DOUBLE) AS duration FROM cat WHERE source_video IS NOT NULL GROUP BY source_video)"


@query(f", {CLIPS}, c AS (SELECT *, CAST(least(round_even(duration / 3.0, 0), 400) AS INT) AS n FROM clips), f AS (SELECT path, duration, n, unnest(range(n)) * 3.0 AS t FROM c WHERE n > 0 UNION ALL SELECT path, duration, n, duration / 2 FROM c WHERE n = 0 UNION ALL SELECT path, duration, n, duration - least(0.5, duration * 0.02) FROM c WHERE n > 0 AND n < 400 AND duration - (n - 1) * 3.0 >= 3.0) SELECT path || '#t=' || printf('%.3f', CAST(t AS DOUBLE)) AS path, path AS source_video, CAST(t AS DOUBLE) AS timestamp_s FROM f")
def sample_plan(s, sf):
    clips = d.catalog(s, sf).where("source_video is not null").groupBy(F.col("source_video").alias("path")).agg((F.count(F.lit(1)) * F.lit(7.25)).alias("duration"))
    return video.sample_plan(clips, CONFIG)


@query("SELECT path, CASE WHEN source_type = 'video_frame' AND taken_at IS NULL AND error IS NULL THEN strftime(CAST('2019-12-31 23:59:00' AS TIMESTAMP) + to_seconds(CAST(timestamp_s AS BIGINT)), '%Y-%m-%d %H:%M:%S') ELSE taken_at END AS taken_at FROM cat")
def frame_dates(s, sf):
    rows = d.catalog(s, sf)
    clips = rows.where("source_video is not null").select(F.col("source_video").alias("path")).distinct().withColumn("created", F.lit("2019-12-31 23:59:00"))
    return video.backfill_dates(rows, clips).select("path", "taken_at")


STAMPS = "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS raw FROM events"


@query(f"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE replace(raw, 'T', ' ') END AS created, CASE WHEN event_id % 5 = 0 THEN NULL ELSE replace(raw, 'T', ' ') END AS camera FROM ({STAMPS})", "")
def video_dates(s, sf):
    e = d.read(s, sf, "events")
    raw, i = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id")
    first = F.when(i % 2 == 0, "1904-01-01 00:00:00").otherwise("soon")
    camera = F.replace(F.replace(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.lit("x")), F.lit("y"))
    return e.select("event_id", dates.video_created(first, F.when(i % 7 != 0, F.concat(raw, F.lit("+0600")))).alias("created"), dates.camera_time(F.lit(""), F.when(i % 5 != 0, camera).otherwise("2011:13:01"), F.lit("2001:01:01")).alias("camera"))


PRETTY = """SELECT path, CASE WHEN taken_at IS NULL THEN '' ELSE ['January','February','March','April','May','June','July','August','September','October','November','December'][CAST(substr(taken_at, 6, 2) AS INT)] || ' ' || CAST(CAST(substr(taken_at, 9, 2) AS INT) AS VARCHAR) || ', ' || substr(taken_at, 1, 4) END AS day,
 CASE WHEN length(taken_at) >= 16 THEN substr(taken_at, 12, 5) ELSE '' END AS clock, CASE WHEN width IS NULL THEN '' ELSE printf('%.1f', width * height / 1e6) END AS megapixels FROM cat"""


@query(PRETTY)
def pretty_fields(s, sf):
    t = F.col("taken_at")
    return d.catalog(s, sf).select("path", dates.pretty_date(t).alias("day"), dates.pretty_time(t).alias("clock"), dates.megapixels(F.col("width"), F.col("height")).alias("megapixels"))


ESC = "'file:///' || replace(replace(replace(replace(ltrim(replace({x}, '\\', '/'), '/'), '%', '%25'), ' ', '%20'), '#', '%23'), '?', '%3F')"


@query(f"SELECT page_id, {ESC.format(x='url')} AS file_url, {ESC.format(x='array_to_string(string_split(url, chr(47))[:-2], chr(47))')} AS folder_url, CASE WHEN len(string_split(plain, '/')) > 3 THEN '/' || array_to_string(string_split(plain, '/')[4:], '/') ELSE '' END AS site FROM (SELECT *, string_split(string_split(url, '#')[1], '?')[1] AS plain FROM pages)", "")
def urls(s, sf):
    u = F.col("url")
    return d.read(s, sf, "pages").select("page_id", paths.file_url(u).alias("file_url"), paths.folder_url(u).alias("folder_url"), paths.site_relative(u).alias("site"))


@query("SELECT doc_id, trim(substr(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\\n\\r\\x0b\\f\\x{85}\\x{a0}\\x{2028}\\x{2029}\\x{3000}]+', ' ', 'g'), '[^A-Za-z0-9 _-]', '', 'g'), ' +', ' ', 'g'), ' -_'), 1, 40), ' -_') AS tag FROM documents", "")
def sanitize_tags(s, sf):
    return d.read(s, sf, "documents").select("doc_id", tag_functions.sanitize_tag(F.col("text")).alias("tag"))


DIMS = 64


@query("""SELECT vec_id, round(100 * least(1, (p1 + 0.8 * p2) / greatest(p1 + 0.8 * p2 + dd, 1e-6)), 4) AS subject_score, CASE WHEN 0.8 * p2 > p1 THEN l2 ELSE l1 END AS subject_label, CASE WHEN 0.8 * p2 > p1 THEN 'secondary' ELSE 'primary' END AS subject_tier
FROM (SELECT vec_id, max(prob) FILTER (pid < 9) AS p1, max(prob) FILTER (pid >= 9 AND pid < 17) AS p2, sum(prob) FILTER (pid >= 17) AS dd, arg_max('s' || pid, prob) FILTER (pid < 9) AS l1, arg_max('s' || pid, prob) FILTER (pid >= 9 AND pid < 17) AS l2
 FROM (SELECT vec_id, pid, exp(z - max(z) OVER (PARTITION BY vec_id)) / sum(exp(z - mz)) OVER (PARTITION BY vec_id) AS prob FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS mz FROM (SELECT e.vec_id, p.vec_id AS pid, 100 * list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS z FROM embeddings e, embeddings p WHERE p.vec_id < 25))) GROUP BY vec_id)""", "")
def subject_match(s, sf):
    e = d.read(s, sf, "embeddings").select("vec_id", "embedding")
    i = F.col("vec_id")
    prompts = e.where(i < 25).select(i.alias("prompt_id"), F.when(i < 9, "primary").when(i < 17, "secondary").otherwise("distractor").alias("tier"), F.concat(F.lit("s"), i.cast("string")).alias("label"), "embedding")
    return measure.subject_match(e, prompts, CONFIG, DIMS).select("vec_id", F.round("subject_score", 4).alias("subject_score"), "subject_label", "subject_tier")


@query("SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), list_transform(range(64), lambda i: (i % 7 - 3) / 8.0)) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * 2 + 5, 6) AS aesthetic_raw FROM embeddings", "")
def aesthetic_head(s, sf):
    w = np.array([[(i % 7 - 3) / 8.0 for i in range(DIMS)]])
    weights, bias = measure.fold_layers([(w, np.array([2.0])), (np.array([[2.0]]), np.array([1.0]))])
    e = d.read(s, sf, "embeddings")
    return e.select("vec_id", F.round(measure.affine(measure.checked(F.col("embedding"), DIMS), weights, bias), 6).alias("aesthetic_raw"))


@query("SELECT vec_id, string_agg(lower(printf('%x', CAST(v AS INT))), '' ORDER BY q) AS dhash FROM (SELECT vec_id, q, sum(CASE WHEN b > a THEN (8 >> CAST(p % 4 AS INT)) ELSE 0 END) AS v FROM (SELECT vec_id, p, p // 4 AS q, embedding[1 + (p // 8 * 7 + p % 8) % 64] AS a, embedding[1 + (p // 8 * 7 + p % 8 + 1) % 64] AS b FROM embeddings, range(64) r(p)) GROUP BY ALL) GROUP BY vec_id", "")
def dhash_array(s, sf):
    rows = F.array(*(F.array(*(F.get("embedding", F.lit((7 * r + c) % 64)) for c in range(9))) for r in range(8)))
    return d.read(s, sf, "embeddings").select("vec_id", measure.dhash_of_rows(rows).alias("dhash"))


@query("WITH a AS (SELECT doc_id, n_chars, sha256(text) AS sha FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 5 <> 0) SELECT CAST(coalesce(a.doc_id, b.doc_id) AS VARCHAR) AS rel_path, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.sha <> b.sha", "")
def library_diff(s, sf):
    t = d.read(s, sf, "documents")
    sha = F.sha2("text", 256)
    base = t.select(F.col("doc_id").cast("string").alias("rel_path"), F.col("n_chars").alias("size"), F.lit(0).alias("mtime"), sha.alias("sha256"), F.col("doc_id"), "text")
    before = base.where("doc_id % 3 <> 0")
    after = base.where("doc_id % 5 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("sha256")))
    return cat.library_diff(before, after)


@query("SELECT doc_id, sha256(text) AS digest FROM documents", "")
def content_digest(s, sf):
    return d.read(s, sf, "documents").select("doc_id", files.content_digest(F.col("text")).alias("digest"))



@query("SELECT path FROM cat WHERE source_type = 'video_frame' AND taken_at IS NULL AND error IS NULL")
def undated_frames(s, sf):
    return cat.undated_frames(d.catalog(s, sf)).select("path")


@query(f", {BEST} SELECT source_video, count(*) - 2 AS capped FROM best GROUP BY source_video HAVING count(*) > 2")
def extraction_capped(s, sf):
    return video.extraction_capped(d.catalog(s, sf), Config(extract_per_clip=2))


TODO = f"{d.LISTING_SQL}, todo AS (SELECT l.path FROM listing l WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.path = l.path AND abs(c.mtime - l.mtime) < 1.0 AND c.size = l.size AND error IS NULL) AND NOT EXISTS (SELECT 1 FROM cat c WHERE c.source_video = l.path AND error IS NULL))"


@query(f", {TODO} SELECT count(*) FILTER (kind = 'photo') AS stills, count(*) FILTER (kind = 'video') AS videos, count(*) FILTER (t.path IS NULL) AS done, count(t.path) AS todo, count(*) FILTER (l.size < 1500) AS too_small, count(*) FILTER (contains(rel_path, '/_hidden/')) AS hidden FROM listing l LEFT JOIN todo t ON t.path = l.path")
def scan_stats(s, sf):
    listing = d.listing(s, sf).withColumns({"too_small": F.col("size") < 1500, "hidden": paths.is_hidden(F.col("rel_path"), CONFIG.hide_folder)})
    return report.scan_stats(listing, cat.resume_todo(listing, d.catalog(s, sf)))


@query(f", {d.LISTING_SQL} SELECT kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM listing GROUP BY kind")
def output_inventory(s, sf):
    return report.output_inventory(d.listing(s, sf).withColumnRenamed("size", "length"))


@query(f", {d.TAGS_SQL}, x AS (SELECT key, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM tags), c AS (SELECT arg_min(tag, (key, pos)) AS tag, count(DISTINCT key) AS photos, lower(tag) AS low FROM x GROUP BY lower(tag)) SELECT tag, photos FROM c WHERE contains(low, 'e') AND low <> 'the' ORDER BY low LIMIT 40")
def tag_menu(s, sf):
    return report.tag_menu(d.tags(s, sf), "E", ["The"])


@query(f", {d.TAGS_SQL} SELECT key, array_to_string(list_filter(tags, lambda x: lower(x) <> 'the'), '|') AS tags FROM tags WHERE len(list_filter(tags, lambda x: lower(x) <> 'the')) > 0")
def remove_tag(s, sf):
    left, _ = report.remove_tag(d.tags(s, sf), "THE")
    return left.select("key", F.array_join("tags", "|").alias("tags"))


@query(f", {d.TAGS_SQL} SELECT count(*) FILTER (list_contains(list_transform(tags, lambda x: lower(x)), 'the')) AS hits FROM tags")
def remove_tag_hits(s, sf):
    return report.remove_tag(d.tags(s, sf), "THE")[1]


@query(f", {d.TAGS_SQL}, x AS (SELECT key, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM tags) SELECT key, CAST(min(pos) - 1 AS INT) AS pos, arg_min(tag, pos) AS tag FROM x GROUP BY key, lower(tag)")
def first_spellings(s, sf):
    return report.distinct_spellings(d.tags(s, sf)).select("key", "pos", "tag")


@query(f", {d.TAGS_SQL} SELECT key FROM tags WHERE key IN (SELECT path FROM cat WHERE verdict = 'PASS' UNION SELECT source_video FROM cat WHERE verdict = 'PASS')")
def tags_of_report(s, sf):
    return report.tags_of_report(d.tags(s, sf), d.catalog(s, sf).where("verdict = 'PASS'")).select("key")


@query(f", {FILES} SELECT CASE WHEN f.local_sha IS NULL THEN 'missing' WHEN m.local_sha = f.local_sha THEN 'reused' ELSE 'upload' END AS status, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM files f LEFT JOIN manifest m ON m.photo_id = f.photo_id AND m.kind = f.kind GROUP BY 1")
def upload_totals(s, sf):
    _, files, manifest = _files(s, sf)
    return publish.upload_totals(publish.upload_plan(files, manifest))


@query(f", {SHORT} SELECT photo_id, filename AS title, array_to_string(list_filter([regexp_replace(folder, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} - ', ''), substr(taken_at, 1, 10), CASE WHEN width IS NOT NULL THEN width || ' × ' || height || ' · ' || printf('%.1f', width * height / 1e6) || ' MP' END], lambda x: x IS NOT NULL), ' · ') AS description FROM short")
def photo_preview(s, sf):
    return publish.photo_preview(publish.gallery_items(d.catalog(s, sf), CONFIG))


@query(f", {SHORT}, g AS (SELECT DISTINCT gallery FROM short) SELECT gallery, CAST(row_number() OVER (ORDER BY lower(gallery), gallery) - 1 AS INT) AS idx FROM g")
def gallery_index(s, sf):
    return publish.gallery_index(publish.gallery_items(d.catalog(s, sf), CONFIG))


@query("SELECT photo_id, hearts, coalesce(rel_path, '') AS rel_path FROM counts JOIN allowed USING (photo_id)", H)
def hearts_with_paths(s, sf):
    return hearts.hearts_with_paths(hearts.heart_counts(hearts.fold(_good(s, sf))), d.allowed(s, sf))


@query("SELECT seq FROM req WHERE photo_id IN (SELECT photo_id FROM allowed)", H)
def known_requests(s, sf):
    return hearts.known_only(d.requests(s, sf), d.allowed(s, sf)).select("seq")


@query(", new AS (SELECT photo_id, 'n/' || CAST(seq AS VARCHAR) AS rel_path, seq AS pos FROM req WHERE seq % 3 = 0), latest AS (SELECT photo_id, arg_max(rel_path, pos) AS p FROM new WHERE regexp_full_match(photo_id, '[0-9a-f]{16}') GROUP BY photo_id) SELECT coalesce(a.photo_id, l.photo_id) AS photo_id, coalesce(p, rel_path) AS rel_path, coalesce(added_at, 7) AS added_at FROM allowed a FULL JOIN latest l ON a.photo_id = l.photo_id", H)
def register_photos(s, sf):
    new = d.requests(s, sf).where("seq % 3 = 0").select("photo_id", F.concat(F.lit("n/"), F.col("seq").cast("string")).alias("rel_path"), F.col("seq").alias("pos"))
    return hearts.register_photos(d.allowed(s, sf), new, 7)[0]


@query(", new AS (SELECT photo_id FROM req WHERE seq % 3 = 0) SELECT (SELECT count(*) FROM new WHERE regexp_full_match(photo_id, '[0-9a-f]{16}')) AS registered, (SELECT count(*) FROM new WHERE NOT regexp_full_match(photo_id, '[0-9a-f]{16}')) AS rejected, (SELECT count(*) FROM (SELECT photo_id FROM allowed UNION SELECT photo_id FROM new WHERE regexp_full_match(photo_id, '[0-9a-f]{16}'))) AS known", H)
def register_counts(s, sf):
    new = d.requests(s, sf).where("seq % 3 = 0").select("photo_id", F.lit("n").alias("rel_path"), F.col("seq").alias("pos"))
    return hearts.register_photos(d.allowed(s, sf), new, 7)[1]


@query("SELECT path || '#t=' || printf('%.3f', timestamp_s) AS virtual, path AS file, timestamp_s AS seconds, CASE WHEN timestamp_s >= 3600 THEN '1:' ELSE '' END || CAST(CAST(timestamp_s AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(timestamp_s AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM cat WHERE timestamp_s IS NOT NULL")
def virtual_paths(s, sf):
    rows = d.catalog(s, sf).where("timestamp_s is not null").select(paths.virtual_path(F.col("path"), F.col("timestamp_s")).alias("virtual"))
    file, seconds = paths.split_virtual(F.col("virtual"))
    return rows.select("virtual", file.alias("file"), seconds.alias("seconds"), paths.hhmmss(seconds).alias("clock"))


@query(f"""SELECT path, lower(array_to_string(list_filter([folder, {SHOWN}, filename, substr(taken_at, 1, 10), day, clock, verdict, dims, note], lambda x: x IS NOT NULL), ' ')) AS blob
FROM (SELECT *, {SIZE} AS dims FROM cat) JOIN ({PRETTY}) AS p USING (path)""")
def search_blob(s, sf):
    return d.catalog(s, sf).select("path", tag_functions.search_blob().alias("blob"))


@query(f", {COVERS} SELECT gallery, row_number() OVER (ORDER BY gallery = 'Unfiled', max(composite) DESC, gallery) AS place FROM g GROUP BY gallery")
def sort_tiles(s, sf):
    return _placed(report.sort_tiles(report.folder_tiles(d.catalog(s, sf)), "score", True)).select("gallery", "place")


@query("SELECT n >= 30 AS unfitted, FALSE AS same, n >= 30 AS halved FROM (SELECT count(*) AS n FROM cat WHERE measured)")
def should_recalibrate(s, sf):
    rows = d.catalog(s, sf)
    n = cat.keepers(rows).count()
    found = (calibrate.should_recalibrate(rows, CONFIG.with_values({"keeper_count": was})) for was in (0, n, 2 * n))
    return s.range(1).select(*(F.lit(x).alias(c) for x, c in zip(found, ("unfitted", "same", "halved"), strict=True)))


@query("SELECT path, source_type, source_video, timestamp_s FROM cat")
def union_of_kinds(s, sf):
    rows = d.catalog(s, sf)
    stills, frames = rows.where("source_type = 'photo'").drop("source_video", "timestamp_s"), rows.where("source_type = 'video_frame'")
    return cat.union_all(stills, frames).select("path", "source_type", "source_video", "timestamp_s")


@query("SELECT path, 'photo' AS source_type, verdict, TRUE AS no_width, CAST(height AS DOUBLE) AS height FROM cat")
def catalog_file(s, sf):
    """An old catalog without some columns, written and read."""
    path = _folder(s, "catalog")
    files.write_catalog(d.catalog(s, sf).drop("source_type", "width"), path)
    return files.read_catalog(s, path).select("path", "source_type", "verdict", F.col("width").isNull().alias("no_width"), F.col("height").cast("double").alias("height"))


@query(f"SELECT filename, verdict, coalesce(day, '') AS taken_date, note FROM cat JOIN ({PRETTY}) AS p USING (path) WHERE verdict IN ('TOP PICK', 'STRONG')")
def shortlist_file(s, sf):
    path = _folder(s, "shortlist")
    files.write_shortlist(d.catalog(s, sf), CONFIG, path)
    got = s.read.option("header", True).option("escape", '"').csv(path)
    return got.select("filename", "verdict", F.coalesce("taken_date", F.lit("")).alias("taken_date"), "note")


@query(f", {SHORT}, {IDX} SELECT photo_id AS id, verdict AS v, CAST(idx AS BIGINT) AS g FROM short JOIN idx USING (gallery)")
def payload_file(s, sf):
    path = _folder(s, "payload")
    items = publish.gallery_items(d.catalog(s, sf), CONFIG)
    files.write_payload(publish.payload_entries(items, publish.gallery_index(items), CONFIG), path)
    return s.read.schema("id string, v string, g long").json(path)


@query("SELECT photo_id, token, action, seq FROM req", H)
def heart_log_file(s, sf):
    path = _folder(s, "hearts")
    d.requests(s, sf).write.json(path)
    return files.read_heart_log(s, path).select("photo_id", "token", "action", "seq")


@query(f", {FILES} SELECT coalesce(f.photo_id, m.photo_id) AS photo_id, coalesce(f.kind, m.kind) AS kind, CASE WHEN f.photo_id IS NOT NULL THEN f.local_sha ELSE m.local_sha END AS local_sha FROM manifest m FULL JOIN (SELECT * FROM files WHERE local_sha IS NOT NULL) f ON m.photo_id = f.photo_id AND m.kind = f.kind")
def manifest_file(s, sf):
    path = _folder(s, "manifest")
    _, new, manifest = _files(s, sf)
    files.append_manifest(manifest, path)
    files.append_manifest(new.where("local_sha is not null").select("photo_id", "kind", "local_sha", F.lit("/n").alias("url_path"), F.lit("g").alias("filename"), F.lit(2).cast("long").alias("uploaded_at")), path)
    return files.read_manifest(s, path).select("photo_id", "kind", "local_sha")


#: Files in folders that scans leave out, and beside them.
PLACED = "placed AS (SELECT CASE k % 7 WHEN 0 THEN 'Thumbs/' WHEN 1 THEN 'a/previews/b/' WHEN 2 THEN 'thumbs.jpg/' WHEN 3 THEN '_extracted\\' WHEN 4 THEN '' ELSE folder || '/' END || CASE WHEN k % 11 = 0 THEN 'thumbs' ELSE filename END AS rel_path FROM cat)"


@query(f", {PLACED} SELECT rel_path, len(list_filter(list_transform(string_split(replace(rel_path, '\\', '/'), '/')[:-2], lambda x: lower(x)), lambda x: list_contains(['thumbs', 'previews', '_extracted', '.trash'], x))) > 0 AS skipped FROM placed")
def skipped_folders(s, sf):
    k = d.number()
    folder = F.when(k % 7 == 0, "Thumbs/").when(k % 7 == 1, "a/previews/b/").when(k % 7 == 2, "thumbs.jpg/").when(k % 7 == 3, "_extracted\\").when(k % 7 == 4, "").otherwise(F.concat("folder", F.lit("/")))
    rows = d.raw_catalog(s, sf).select(F.concat(folder, F.when(k % 11 == 0, "thumbs").otherwise(F.col("filename"))).alias("rel_path"))
    return rows.select("rel_path", cat.skipped(CONFIG).alias("skipped"))


#: Homes of programs among folders of pictures; some hold the marker.
HOMES = "homes AS (SELECT 'h' || (k % 90) || CASE WHEN k % 4 = 0 THEN '/in' ELSE '' END AS home, k, filename FROM cat), tree AS (SELECT home, CASE WHEN k % 30 = 0 AND k % 9 < 4 THEN home || '/pyvenv.cfg' ELSE home || CASE k % 3 WHEN 0 THEN '/Lib/' WHEN 1 THEN '/photos/lib/' ELSE '/' END || filename END AS rel_path FROM homes), marked AS (SELECT DISTINCT home FROM tree WHERE rel_path LIKE '%/pyvenv.cfg')"


@query(f", {HOMES} SELECT DISTINCT rel_path FROM tree WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE starts_with(rel_path, m.home || '/Lib/') OR starts_with(rel_path, m.home || '/lib/'))")
def pruned_environments(s, sf):
    k = d.number()
    home = F.concat(F.lit("h"), (k % 90).cast("string"), F.when(k % 4 == 0, "/in").otherwise(""))
    inner = F.when(k % 3 == 0, "/Lib/").when(k % 3 == 1, "/photos/lib/").otherwise("/")
    rel = F.when((k % 30 == 0) & (k % 9 < 4), F.concat(home, F.lit("/pyvenv.cfg"))).otherwise(F.concat(home, inner, "filename"))
    return cat.outside_environments(d.raw_catalog(s, sf).select(rel.alias("rel_path")).distinct())


@query(f", {d.LISTING_SQL} SELECT l.path, l.kind FROM listing l WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.path = l.path AND abs(c.mtime - l.mtime) < 1.0 AND c.size = l.size AND error IS NULL) AND NOT EXISTS (SELECT 1 FROM cat c WHERE c.source_video = l.path AND error IS NULL) ORDER BY l.path LIMIT 200")
def resume_limit(s, sf):
    return cat.resume_todo(d.listing(s, sf), d.catalog(s, sf), limit=200).select("path", "kind")


@query(f", {FIT} SELECT a_low, a_high, n_low, n_high, round(b1, 6) AS top, n AS keeper_count FROM rng, b, n")
def calibration_file(s, sf):
    """A calibration, written and read."""
    path = _folder(s, "calibration")
    files.write_calibration(s, calibrate.calibrate(d.catalog(s, sf), CONFIG) or CONFIG, path)
    c = files.read_calibration(s, path, Config())
    values = {"a_low": c.aesthetic_range[0], "a_high": c.aesthetic_range[1], "n_low": c.nima_range[0], "n_high": c.nima_range[1], "top": round(c.bands[0][0], 6)}
    return s.createDataFrame([(*map(float, values.values()), c.keeper_count)], ", ".join(f"{k} double" for k in values) + ", keeper_count long")


#: One JSON object of lists by customer, with values that are none, elements that are no text, and keys that are no ids.
TAG_FILE = "entries AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 1 THEN 'no id ' || c_custkey WHEN c_custkey % 4 = 2 THEN upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 16)) ELSE substr(md5(CAST(c_custkey AS VARCHAR)), 1, 16) END AS key, c_name, c_mktsegment FROM customer)"
TAG_LISTS = "CASE k % 6 WHEN 0 THEN c_name || '|' || c_mktsegment WHEN 1 THEN c_name WHEN 2 THEN 'a\"],b\\|' || c_mktsegment ELSE '' END"


def _tag_file(s, sf) -> str:
    c = d.read(s, sf, "customer")
    k = F.col("c_custkey")
    ident = F.substring(F.md5(k.cast("string")), 1, 16)
    key = F.when(k % 4 == 1, F.concat(F.lit("no id "), k.cast("string"))).when(k % 4 == 2, F.upper(ident)).otherwise(ident)
    text = lambda *x: F.to_json(F.array(*x))
    lists = F.when(k % 6 == 0, text(F.col("c_name"), F.col("c_mktsegment"))).when(k % 6 == 1, F.concat(F.lit('[1, null, {"a": ["b"]}, '), F.substr(text(F.col("c_name")), F.lit(2)))).when(k % 6 == 2, text(F.lit('a"],b\\'), F.col("c_mktsegment"))).when(k % 6 == 3, "[]").when(k % 6 == 4, '"text"').otherwise('{"x": ["y"]}')
    entry = F.concat(F.regexp_extract(F.to_json(F.array(key)), r"^\[(.*)\]$", 1), F.lit(": "), lists)
    lines = c.select(k.alias("at"), F.concat(F.when(k == 0, "").otherwise(", "), entry).alias("value"))
    # one file, in order: the object's first entry has no comma before it
    first = lines.agg(F.min("at")).first()[0]
    lines = lines.withColumn("value", F.when(F.col("at") == first, F.concat(F.lit("{"), F.regexp_replace("value", "^, ", ""))).otherwise(F.col("value")))
    end = s.createDataFrame([(1 << 62, "}")], "at long, value string")
    path = _folder(s, "tags")
    lines.unionByName(end).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return path


@query(f"WITH {TAG_FILE} SELECT key, {TAG_LISTS} AS tags FROM entries WHERE k % 6 < 4", "")
def tag_file(s, sf):
    """A tag file with malformed values, read."""
    return files.read_tags(s, _tag_file(s, sf))[0].select("key", F.array_join("tags", "|").alias("tags"))


@query(f"WITH {TAG_FILE} SELECT lower(key) AS photo_id, {TAG_LISTS} AS tags FROM entries WHERE k % 6 < 4 AND k % 4 <> 1", "")
def web_tag_file(s, sf):
    return files.read_web_tags(s, _tag_file(s, sf))[0].select("photo_id", F.array_join("tags", "|").alias("tags"))


@query("SELECT count(*) FILTER (c_custkey % 6 > 3) AS dropped_values, 3 * count(*) FILTER (c_custkey % 6 = 1) AS dropped_elements, count(*) FILTER (c_custkey % 6 < 4 AND c_custkey % 4 = 1) AS dropped_keys FROM customer", "")
def web_tag_file_drops(s, sf):
    return files.read_web_tags(s, _tag_file(s, sf))[1]
