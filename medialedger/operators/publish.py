"""From the shortlist to a gallery: ids, uploads, tags, slugs, the payload, previews of links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Config
from ..functions.dates import pretty_resolution
from ..functions.paths import folder_group, photo_id, slashed, slug, strip_folder_date, upload_filename
from ..functions.scoring import blank, split_note
from ..functions.tags import clean_web_tags
from .catalog import shortlist
from .components import stored
from .order import numbered
from .skew import hot_join


def gallery_items(catalog: DataFrame, config: Config, limit: int | None = None) -> DataFrame:
    """The shortlist with photo_id and gallery, best first."""
    rows = shortlist(catalog, config).withColumns({"photo_id": photo_id(F.col("rel_path")), "gallery": folder_group(F.col("folder"))})
    return rows if limit is None else rows.orderBy(F.desc_nulls_last("composite"), "path").limit(limit)


def upload_plan(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(photo_id, kind, status, filename, bytes) for files (photo_id, kind, local_sha, bytes): missing, reused or upload."""
    have = manifest.select("photo_id", "kind", F.col("local_sha").alias("_sha"))
    status = F.when(F.col("local_sha").isNull(), "missing").when(F.col("_sha") == F.col("local_sha"), "reused").otherwise("upload")
    return files.join(have, ["photo_id", "kind"], "left").select("photo_id", "kind", status.alias("status"), upload_filename(F.col("photo_id"), F.col("kind")).alias("filename"), "bytes")


def upload_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))


def both_kinds(items: DataFrame) -> DataFrame:
    return items.select("photo_id", F.explode(F.array(F.lit("thumb"), F.lit("preview"))).alias("kind"))


def orphan_uploads(manifest: DataFrame, items: DataFrame) -> DataFrame:
    return manifest.join(items.select("photo_id").distinct(), "photo_id", "left_anti")


def manifest_put(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """The latest entry of each (photo_id, kind); new ones win ties."""
    both = manifest.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    cols = [c for c in manifest.columns if c not in ("photo_id", "kind")]
    latest = both.groupBy("photo_id", "kind").agg(F.max_by(F.struct(*cols), F.struct("_new", "uploaded_at")).alias("x"))
    return latest.select("photo_id", "kind", *(f"x.{c}" for c in cols)).select(*manifest.columns)


def path_endings(keys: DataFrame, heads: DataFrame) -> DataFrame:
    """(key, ending): the endings of keys (key, norm) that begin with one of the heads (head), which are first components of paths.

    An ending may begin within a component, so each distinct component is taken apart once, and the heads that end it are looked
    up; a key then has one row for each such head of each of its components, usually none or one.
    """
    parts = F.split("norm", "/")
    each = keys.select("key", parts.alias("parts"), F.posexplode(parts).alias("at", "part"))
    left = F.slice("parts", F.col("at") + 2, F.size("parts"))
    each = stored(each.select("key", "part", F.when(F.size(left) > 0, F.concat(F.lit("/"), F.array_join(left, "/"))).otherwise("").alias("left")))
    tails = each.select("part").distinct().select("part", F.explode(F.expr("transform(sequence(0, length(part)), n -> right(part, n))")).alias("head"))
    ended = hot_join(tails, heads.select("head").distinct(), "head").groupBy("part").agg(F.collect_set("head").alias("heads"))
    return hot_join(each, ended, "part").select("key", F.explode("heads").alias("head"), "left").select("key", F.concat("head", "left").alias("ending"))


def resolve_tags(tags: DataFrame, items: DataFrame) -> DataFrame:
    """(photo_id, tags) for tags (key, tags): by the key's own id, else by the best photo whose rel_path ends the key.

    Endings are joined with paths by equality, so neither a file name nor a suffix that all keys share makes pairs. Where keys
    meet in one photo, the last key in order wins.
    """
    t = tags.withColumns({"norm": F.lower(slashed(F.col("key"))), "_id": photo_id(F.col("key"))})
    rel = F.lower(slashed(F.col("rel_path")))
    order = F.struct(F.col("composite").isNull(), -F.col("composite"), F.col("path"))
    best = items.where(rel != "").groupBy(rel.alias("ending")).agg(F.min_by("photo_id", order).alias("photo_id"), F.min(order).alias("order"))
    direct = t.join(items.select("photo_id").distinct(), F.col("_id") == F.col("photo_id"), "left_semi").select("key", F.col("_id").alias("photo_id"))
    rest = t.select("key", "norm").join(direct.select("key").distinct(), "key", "left_anti")
    ended = hot_join(path_endings(rest, best.select(F.substring_index("ending", "/", 1).alias("head"))), best, "ending")
    found = direct.unionByName(ended.groupBy("key").agg(F.min_by("photo_id", "order").alias("photo_id")))
    return t.select("key", "tags").join(found, "key").groupBy("photo_id").agg(F.max_by(F.array_sort(F.array_distinct("tags")), "key").alias("tags"))


def merge_web_tags(own: DataFrame, web: DataFrame, known: DataFrame) -> DataFrame:
    """Web tags replace those of known photos; a list that cleaning empties removes them."""
    w = web.join(known.select("photo_id").distinct(), "photo_id", "left_semi").select("photo_id", clean_web_tags(F.col("tags")).alias("_web"))
    both = own.join(w, "photo_id", "full").withColumn("tags", F.when(F.col("_web").isNotNull(), F.col("_web")).otherwise(F.col("tags")))
    return both.where(F.size("tags") > 0).select("photo_id", "tags")


def unknown_web_tags(web: DataFrame, known: DataFrame) -> DataFrame:
    return web.join(known.select("photo_id").distinct(), "photo_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))


def gallery_index(items: DataFrame) -> DataFrame:
    """(gallery, idx) from 0, by lower-cased name, then name."""
    names = numbered(items.select("gallery").distinct(), "idx", F.lower("gallery"), F.col("gallery"))
    return names.withColumn("idx", F.col("idx").cast("int"))


def _free_slugs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slugs for galleries that come by family, then in order: the plain one, or the first number from 2 on that is free."""
    family, given, tried = None, set(), {}
    for b in batches:
        out = []
        for f, plain in zip(b["family"], b["plain"], strict=True):
            if f != family:
                family, given, tried = f, set(), {}
            number, found = tried.get(plain, 1), plain
            while found.lower() in given:
                number += 1
                found = f"{plain}-{number}"
            tried[plain] = number
            given.add(found.lower())
            out.append(found)
        yield b.assign(slug=out)[["gallery", "idx", "slug"]]


def contested(bases: DataFrame) -> DataFrame:
    """base of those of the plain slugs (base, k of galleries) that can meet another's numbers, or whose numbers can meet another.

    A slug `x-n` is met by the n-th gallery of `x` at the earliest, and later by as many as `x` has slugs of others below n; so most
    numbered names are met by nobody.
    """
    parts = r"^(.*)-([1-9][0-9]{0,8})$"
    numbers = bases.select("base", F.regexp_extract("base", parts, 1).alias("over"), F.regexp_extract("base", parts, 2).try_cast("long").alias("n")).where("n >= 2")
    taken = numbers.join(bases.select(F.col("base").alias("over")), "over", "left_semi").select("base", F.lit(1).alias("own"))
    # a slug that may be gone when its first gallery comes needs a number more
    reach = bases.join(taken, "base", "left").select(F.col("base").alias("over"), (F.col("k") + F.coalesce("own", F.lit(0))).alias("reach")).where("reach > 1")
    nth = F.row_number().over(W.partitionBy("over").orderBy("n"))
    met = numbers.join(reach, "over").withColumn("_nth", nth).where(F.col("n") < F.col("reach") + F.col("_nth"))
    return met.select(F.explode(F.array("base", "over")).alias("base")).distinct()


def gallery_slugs(index: DataFrame) -> DataFrame:
    """(gallery, idx, slug): slugs that collide are numbered in order, past taken ones.

    Galleries of one plain slug are numbered by their place among them, in ranges of the order. Only where a number can meet
    another gallery's plain slug do names depend on each other; these come in order, by family (names that agree but for
    numbers at their ends).
    """
    plain = slug(F.col("gallery"))
    named = numbered(index.select("gallery", "idx", plain.alias("plain")).withColumn("base", F.lower("plain")), "at", F.col("base"), F.col("idx"))
    named = stored(named)
    bases = stored(named.groupBy("base").agg(F.count(F.lit(1)).alias("k"), F.min("at").alias("first")))
    flags = bases.join(contested(bases).withColumn("met", F.lit(True)), "base", "left")
    ranked = hot_join(named, flags, "base").withColumn("number", F.col("at") - F.col("first") + 1)
    own = F.when(F.col("number") == 1, F.col("plain")).otherwise(F.concat("plain", F.lit("-"), F.col("number").cast("string")))
    alone = ranked.where("met is null").select("gallery", "idx", own.alias("slug"))
    rest = ranked.where("met").select("gallery", "idx", "plain", F.regexp_replace("base", "(-[0-9]+)+$", "").alias("family"))
    return alone.unionByName(rest.repartition("family").sortWithinPartitions("family", "idx").mapInPandas(_free_slugs, "gallery string, idx int, slug string"))


def payload_entries(items: DataFrame, index: DataFrame, config: Config, tags: DataFrame | None = None, urls: DataFrame | None = None) -> DataFrame:
    """One struct for each photo of the gallery, fields without content left out when written as JSON."""
    facts, fault = split_note(F.col("note"), config)
    rows = items.join(index, "gallery")
    rows = rows.join(tags, "photo_id", "left") if tags is not None else rows.withColumn("tags", F.lit(None).cast("array<string>"))
    rows = rows.join(urls, "photo_id", "left") if urls is not None else rows.withColumns({"thumb_url": F.lit(None).cast("string"), "preview_url": F.lit(None).cast("string")})
    shown = strip_folder_date(F.col("folder"))
    entry = F.struct(
        F.col("photo_id").alias("id"),
        F.col("verdict").alias("v"),
        # as SQL rounds: the scaled number, half away from zero
        (F.round(F.col("composite") * 10) / 10).alias("s"),
        F.col("filename").alias("n"),
        shown.alias("f"),
        F.col("idx").alias("g"),
        F.coalesce("taken_at", F.lit("")).alias("d"),
        pretty_resolution(F.col("width"), F.col("height")).alias("r"),
        facts.alias("note"),
        blank(fault).alias("w"),
        F.coalesce("thumb_url", "preview_url").alias("th"),
        F.coalesce("preview_url", "thumb_url").alias("pv"),
        F.when(shown != F.col("folder"), F.col("folder")).alias("fr"),
        F.when(F.size("tags") > 0, F.col("tags")).alias("t"),
    )
    return rows.select("photo_id", "composite", entry.alias("entry"))


def entry_json(entry: Column) -> Column:
    """Compact JSON that may stand inside a script element."""
    text = F.to_json(entry)
    return F.replace(F.replace(text, F.lit("</"), F.lit("<\\/")), F.lit("<!--"), F.lit("<\\u0021--"))


def payload(entries: DataFrame, index: DataFrame) -> DataFrame:
    """The whole payload in one row, for shortlists that a page can hold; larger ones are written as JSON lines of entries."""
    g = index.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "gallery"))), lambda x: x["gallery"]).alias("g"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("composite")).alias("o"), "photo_id", "entry"))), lambda x: x["entry"])
    p = entries.agg(ordered.alias("p"))
    both = g.withColumn("_k", F.lit(1)).join(p.withColumn("_k", F.lit(1)), "_k")
    return both.select(entry_json(F.struct("g", "p")).alias("payload"))


def photo_preview(items: DataFrame) -> DataFrame:
    """(photo_id, title, description) of single photos."""
    parts = [blank(strip_folder_date(F.col("folder"))), blank(F.substring("taken_at", 1, 10)), blank(pretty_resolution(F.col("width"), F.col("height")))]
    return items.select(F.lower("photo_id").alias("photo_id"), F.coalesce(blank(F.col("filename")), F.lit("Photograph")).alias("title"), F.concat_ws(" · ", *parts).alias("description"))


def folder_preview(items: DataFrame) -> DataFrame:
    """(gallery, photo_id, description): the best photo stands for its gallery, the first on ties."""
    best = items.groupBy("gallery").agg(F.count(F.lit(1)).alias("n"), F.min_by("photo_id", F.struct((-F.coalesce("composite", F.lit(0.0))).alias("s"), "path")).alias("photo_id"))
    words = F.when(F.col("n") == 1, F.lit("1 photograph")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" photographs")))
    return best.select("gallery", "photo_id", words.alias("description"))


def link_target(url: Column) -> tuple[Column, Column]:
    """(kind, key): a photo before a folder, empty values skipped; the key decoded and lower-cased."""
    value = lambda k: blank(F.parse_url(url, F.lit("QUERY"), F.lit(k)))
    photo, folder = value("photo"), value("folder")
    kind = F.when(photo.isNotNull(), "photo").when(folder.isNotNull(), "folder")
    return kind, F.lower(F.try_url_decode(F.coalesce(photo, folder)))


def resolve_links(urls: DataFrame, items: DataFrame, slugs: DataFrame) -> DataFrame:
    """(url, kind, photo_id, title, description) of the links that name something."""
    kind, key = link_target(F.col("url"))
    u = urls.select("url", kind.alias("kind"), key.alias("key")).where("kind is not null")
    p = photo_preview(items)
    photos = u.where("kind = 'photo'").join(p, F.col("key") == p["photo_id"]).select("url", "kind", "photo_id", "title", "description")
    f = folder_preview(items).join(slugs, "gallery")
    folders = u.where("kind = 'folder'").join(f, F.col("key") == F.lower(f["slug"])).select("url", "kind", "photo_id", F.col("gallery").alias("title"), "description")
    return photos.unionByName(folders)
