"""Operators on small fixtures, against plain versions."""

import json
import random
import shutil
import struct
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from medialedger.config import Config
from medialedger.functions.paths import slug, slugify
from medialedger.operators import blocks, calibrate, catalog, components, dedup, hearts, measure, publish, report, search, video
from medialedger.schema import CATALOG
from medialedger.sources import files, large_json
from medialedger.streaming import jobs

C = Config()


def rows(spark, items):
    """Catalog rows from dictionaries."""
    names = CATALOG.fieldNames()
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in items], CATALOG)


def test_chains_are_closed(spark):
    pairs = [(i, i + 1) for i in range(100)] + [(500, 505), (505, 501), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {500: 500, 501: 500, 505: 500}


@pytest.mark.parametrize(("distance", "block"), [(0, 1024), (2, 1024), (5, 8)])
def test_pairs_are_brute_force(spark, monkeypatch, distance, block):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(20)]
    hashes = set()
    for _ in range(300):
        h = rng.choice(base)
        for _ in range(rng.randrange(4)):
            h ^= 1 << rng.randrange(64)
        hashes.add(h - (1 << 64) if h >> 63 else h)
    hashes = sorted(hashes)
    df = spark.createDataFrame([(h,) for h in hashes], "h long")
    monkeypatch.setattr(dedup, "BLOCK_ROWS", block)
    got = sorted((r["a"], r["b"]) for r in dedup.near_pairs(df, distance).collect())
    want = sorted((a, b) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= distance)
    assert got == want


def test_masks_lose_no_pair():
    rng = random.Random(1)
    for distance in (*range(1, 12), 20, 40):
        masks = dedup.band_masks(distance, 10**6)
        for _ in range(200):
            x = sum(1 << b for b in rng.sample(range(64), distance))
            assert any(not x & m for m in masks)
    assert len(dedup.band_masks(5, 10**9)) < 60


def test_equal_frames_and_bursts(spark):
    chain = [0, 0b11111, 0b1111111111]  # first and last are ten bits apart
    items = [{"path": f"/same{i:05d}", "phash": "00000000ffff0000", "composite": float(i % 7)} for i in range(10_000)]
    items += [{"path": f"/burst{i}", "phash": f"{h << 32 | 0xF000000000000000:016x}", "composite": 5.0} for i, h in enumerate(chain)]
    items += [{"path": "/alone", "phash": "0123456789abcdef", "composite": 1.0}, {"path": "/bad", "phash": "00000000ffff0000", "error": "x"}, {"path": "/none"}]
    df = rows(spark, items)
    groups = dedup.duplicate_groups(df, C.hamming)
    sizes = {r["group_size"]: r["keeper"] for r in dedup.pick_keepers(groups).collect()}
    assert sizes == {10_000: "/same00006", 3: "/burst0"}
    flagged = dedup.flag_duplicates(df, groups)
    assert flagged.where("dup_of is not null").count() == 9_999 + 2
    assert flagged.columns == df.columns


def test_order_statistics_are_brute_force(spark):
    """Of all sizes, signs and magnitudes, of values that differ in their last bit, of ties, nulls and numbers that are none."""
    rng = random.Random(2)
    qs = (0.0, 0.02, 0.5, 0.8, 0.95, 0.99, 1.0)
    want = lambda x: [sorted(x)[min(len(x) - 1, int(round(q * (len(x) - 1))))] for q in qs]
    columns = [[(i * 37 % n) / 10 for i in range(n)] for n in (1, 2, 5, 40, 101)]
    columns += [
        [rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(300)],
        [1 + k * 2.0**-52 for k in range(200)],
        [-1 - k * 2.0**-52 for k in range(200)],
        [0.0, -0.0, 5e-324, -5e-324, float("inf"), float("-inf"), 1e308] * 20,
        [7.25] * 50 + [7.5],
    ]
    most = max(map(len, columns))
    table = [tuple(c[k] if k < len(c) else None for c in columns) for k in range(most)]
    names = [f"v{i}" for i in range(len(columns))]
    df = spark.createDataFrame(table, ", ".join(f"{c} double" for c in names)).repartition(3)
    got = calibrate.order_statistics(df, dict.fromkeys(names, qs))
    for c, values in zip(names, columns, strict=True):
        assert got[c].n == len(values)
        assert got[c].values == want(values), c
    none = calibrate.order_statistics(df.limit(0), {"v0": (0.5,), "v1": ()})
    assert none == {"v0": (0, [None]), "v1": (0, [])}
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    first, last = calibrate.order_statistics(odd, {"v": (0.0, 1.0)})["v"].values
    assert first == 1.0
    assert last != last


def test_calibration(spark):
    items = [{"path": f"/{i}", "aesthetic_raw": 4 + i / 100, "nima_raw": 4 + i / 200, "subject_score": 50.0, "sharpness": 200.0, "clip_hi": 0.0, "clip_lo": 0.0, "source_type": "photo"} for i in range(101)]
    df = rows(spark, items)
    got = calibrate.calibrate(df, C)
    assert got.aesthetic_range == (4.02, 4.99)
    assert got.nima_range == pytest.approx((4.01, 4.495))
    assert got.keeper_count == 101
    limits = [b for b, _ in got.bands]
    assert limits == sorted(limits, reverse=True)
    assert not calibrate.should_recalibrate(df, got)
    assert calibrate.should_recalibrate(df, C)
    assert calibrate.calibrate(df.limit(10), C) is None
    flat = df.withColumns({"aesthetic_raw": F.lit(5.0), "nima_raw": F.lit(None).cast("double")})
    tied = calibrate.calibrate(flat, C)
    assert tied.aesthetic_range == (4.875, 5.125)
    assert [round(b, 6) for b, _ in tied.bands][0] == round(tied.bands[1][0] + 0.1, 6)


def test_resume_and_upsert(spark):
    old = rows(spark, [{"path": "/a", "mtime": 10.0, "size": 5, "filename": "a"}, {"path": "/b", "mtime": 10.0, "size": 5, "error": "x"}, {"path": "/c#t=0.000", "source_video": "/c"}, {"path": "/d#t=0.000", "source_video": "/d", "error": "x"}])
    now = spark.createDataFrame([("/a", 10.9, 5), ("/b", 10.0, 5), ("/c", 99.0, 9), ("/d", 1.0, 1), ("/e", 1.0, 1)], "path string, mtime double, size long")
    todo = lambda **k: sorted(r["path"] for r in catalog.resume_todo(now, old, **k).collect())
    assert todo() == ["/b", "/d", "/e"]
    assert todo(limit=2) == ["/b", "/d"]
    assert todo(force=True) == ["/a", "/b", "/c", "/d", "/e"]
    assert [r["path"] for r in catalog.resume_todo(now.withColumn("mtime", F.col("mtime") + 1), old).where("path = '/a'").collect()] == ["/a"]
    new = rows(spark, [{"path": "/a", "filename": "other", "size": 6}, {"path": "/z", "filename": "z"}])
    got = {r["path"]: r for r in catalog.upsert(old, new).collect()}
    assert (got["/a"]["filename"], got["/a"]["size"]) == ("a", 6)
    assert got["/z"]["filename"] == "z"
    assert len(got) == 5
    assert {r["path"] for r in catalog.forget_video(old, spark.createDataFrame([("/c",)], "path string")).collect()} == {"/a", "/b", "/d#t=0.000"}
    assert catalog.existing_only(old, None).count() == 4
    assert {r["path"] for r in catalog.existing_only(old, now.where("path in ('/a', '/c')")).collect()} == {"/a", "/c#t=0.000"}


def test_environments(spark):
    paths = ["env/pyvenv.cfg", "env/lib/x.jpg", "env/Lib64/y.jpg", "env/photos/z.jpg", "lib/w.jpg", "a/env/pyvenv.cfg", "a/env/bin/v.jpg"]
    df = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    assert {r[0] for r in catalog.outside_environments(df).collect()} == set(paths) - {"env/lib/x.jpg", "env/Lib64/y.jpg", "a/env/bin/v.jpg"}


def test_old_catalogs(spark, tmp_path):
    spark.createDataFrame([("/a", 1.0)], "path string, composite double").write.parquet(str(tmp_path / "c"))
    got = files.read_catalog(spark, str(tmp_path / "c"))
    assert got.columns == CATALOG.fieldNames()
    assert got.first()["source_type"] == "photo"
    assert files.read_catalog(spark, str(tmp_path / "none")).count() == 0


def test_samples(spark):
    clips = spark.createDataFrame([("/a.mp4", 25.0), ("/b.mp4", 12.0), ("/c.mp4", 1.0), ("/d.mp4", 0.0), ("/e.mp4", 5000.0)], "path string, duration double")
    got = {}
    for r in video.sample_plan(clips, C).collect():
        got.setdefault(r["source_video"], []).append(r["timestamp_s"])
    assert sorted(got["/a.mp4"]) == [0, 3, 6, 9, 12, 15, 18, 21, 24.5]
    assert sorted(got["/b.mp4"]) == [0, 3, 6, 9, 11.76]
    assert got["/c.mp4"] == [0.5]
    assert "/d.mp4" not in got
    assert len(got["/e.mp4"]) == 400
    assert video.sample_plan(clips.limit(1), C).where("path = '/a.mp4#t=24.500'").count() == 1


def test_extraction(spark):
    items = [{"path": f"/c.mp4#t={i}", "source_video": "/x/my.clip.mp4", "source_type": "video_frame", "timestamp_s": float(i), "composite": 60.0 + i} for i in range(30)]
    got = video.extraction_plan(rows(spark, items), C).orderBy("rank").collect()
    assert [r["composite"] for r in got] == [float(89 - k) for k in range(12)]
    assert got[0]["dest"] == "my.clip/my.clip_00029.00s_89.jpg"
    assert video.extraction_capped(rows(spark, items), C).first()["capped"] == 12


def test_orders(spark):
    items = [{"path": f"/{n}", "filename": n, "composite": s, "taken_at": t} for n, s, t in (("img10", 1.0, "2020-01-01"), ("IMG9", 2.0, ""), ("ímg9b", 3.0, None), ("", 4.0, "2020-01-01 05:00:00"))]
    df = rows(spark, items)
    names = lambda *a: [r["filename"] for r in report.sort_cards(df, *a).collect()]
    assert names("name", False) == ["IMG9", "ímg9b", "img10", ""]
    assert names("name", True) == ["img10", "ímg9b", "IMG9", ""]
    assert names("date", False) == ["img10", "", "ímg9b", "IMG9"]
    assert names("date", True) == ["", "img10", "ímg9b", "IMG9"]


def test_tiles_and_filters(spark):
    items = [{"path": f"/{g}{i}", "folder": g, "composite": float(i), "taken_at": f"20{10 + i}-01-01", "verdict": "STRONG", "source_type": "photo"} for g in ("2010-03-12 - Arches", "2010-03-12 - Arches/Publish", "(root)") for i in range(3)]
    df = rows(spark, items)
    tiles = report.sort_tiles(report.folder_tiles(df), "score", True).collect()
    assert [(t["gallery"], t["images"], t["years"]) for t in tiles] == [("Arches", 6, "2010–2012"), ("Unfiled", 3, "2010–2012")]
    assert len(tiles[0]["covers"]) == 4
    tagged = report.attach_tags(df, spark.createDataFrame([("/(root)1", ["Red Rock", "x"])], "key string, tags array<string>"))
    assert tagged.where(report.card_filter(tags=["red rock"])).count() == 1
    assert tagged.where(report.card_filter(text="ROCK|")).count() == 1
    assert tagged.where(report.card_filter(gallery="Arches", verdict="STRONG", kind="photo")).count() == 6
    counts = {r["folder"]: r["images"] for r in report.folder_counts(df).collect()}
    assert counts == {None: 9, "2010-03-12 - Arches": 6, "(root)": 3}


def test_tag_lists(spark):
    t = spark.createDataFrame([("/a", ["Lake", "sea"]), ("/b", ["LAKE", "lake"]), ("/c", ["sea"])], "key string, tags array<string>")
    assert [tuple(r) for r in report.tag_counts(t).collect()] == [("Lake", 2), ("sea", 2)]
    assert [r["tag"] for r in report.tag_menu(t, "s", ["lake"]).collect()] == ["sea"]
    left, hits = report.remove_tag(t, "SEA")
    assert {r["key"]: r["tags"] for r in left.collect()} == {"/a": ["Lake"], "/b": ["LAKE", "lake"]}
    assert hits.first()[0] == 2
    assert [r["tag"] for r in report.distinct_spellings(t).where("key = '/b'").collect()] == ["LAKE"]


def test_tag_files(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"/a": ["x", 5, "y"], "/b": "no", "/c": []}')
    got, dropped = files.read_tags(spark, str(tmp_path / "t.json"))
    assert {r["key"]: r["tags"] for r in got.collect()} == {"/a": ["x", "y"], "/c": []}
    assert tuple(dropped.first()) == (1, 1)
    (tmp_path / "bad.json").write_text("[1")
    assert files.read_tags(spark, str(tmp_path / "bad.json"))[0].count() == 0


def test_tags_find_photos(spark):
    items = rows(spark, [{"path": "/l/A/x.jpg", "rel_path": "A/x.jpg", "composite": 90.0, "verdict": "STRONG"}, {"path": "/l/x.jpg", "rel_path": "x.jpg", "composite": 80.0, "verdict": "STRONG"}])
    g = publish.gallery_items(items, C)
    ids = {r["rel_path"]: r["photo_id"] for r in g.collect()}
    t = spark.createDataFrame([("D:\\lib\\a\\X.jpg", ["b", "a", "b"]), ("x.jpg", ["own"]), ("/q/nox.jpg", ["z"]), ("/none", ["n"])], "key string, tags array<string>")
    got = {r["photo_id"]: r["tags"] for r in publish.resolve_tags(t, g).collect()}
    assert got == {ids["A/x.jpg"]: ["a", "b"], ids["x.jpg"]: ["own"]}
    web = spark.createDataFrame([(ids["A/x.jpg"], ["!!"]), ("f" * 16, ["u"])], "photo_id string, tags array<string>")
    own = publish.resolve_tags(t, g)
    assert {r["photo_id"] for r in publish.merge_web_tags(own, web, g).collect()} == {ids["x.jpg"]}
    assert publish.unknown_web_tags(web, g).first()[0] == 1


def test_slugs_payload_links(spark):
    items = rows(spark, [{"path": f"/{i}", "rel_path": f"{f}/{i}.jpg", "folder": f, "filename": f"{i}.jpg", "composite": 70.25 + i, "verdict": "STRONG", "note": "Aesthetic 1 · Technical 2 · </x> · out of focus", "taken_at": "2020-02-03 04:05:06", "width": 6000, "height": 4000} for i, f in enumerate(("A b", "a  B", "2020-01-01 Zoo", "(root)"))])
    g = publish.gallery_items(items, C)
    index = publish.gallery_index(g)
    slugs = publish.gallery_slugs(index)
    assert {r["gallery"]: r["slug"] for r in slugs.collect()} == {"A b": "a-b-2", "a  B": "a-b", "Unfiled": "unfiled", "Zoo": "zoo"}
    entries = publish.payload_entries(g, index, C)
    text = publish.payload(entries, index).first()[0]
    assert "</x>" not in text
    assert '"w":"out of focus"' in text
    assert '"fr":"2020-01-01 Zoo"' in text
    pid = g.where("gallery = 'Zoo'").first()["photo_id"]
    urls = spark.createDataFrame([(f"https://x/?photo={pid.upper()}&folder=zoo",), ("https://x/?photo=&folder=A-B-2",), ("https://x/?photo=constructor",), ("https://x/",)], "url string")
    got = {r["kind"]: r for r in publish.resolve_links(urls, g, slugs).collect()}
    assert got["photo"]["description"] == "Zoo · 2020-02-03 · 6000 × 4000 · 24.0 MP"
    assert (got["folder"]["title"], got["folder"]["description"]) == ("A b", "1 photograph")


def test_uploads(spark):
    f = spark.createDataFrame([("p", "thumb", "s1", 10), ("p", "preview", "s2", 20), ("q", "thumb", None, None)], "photo_id string, kind string, local_sha string, bytes long")
    m = spark.createDataFrame([("p", "thumb", "s1", "/u", "f", 1), ("p", "preview", "old", "/u", "f", 1), ("gone", "thumb", "x", "/u", "f", 1)], "photo_id string, kind string, local_sha string, url_path string, filename string, uploaded_at long")
    plan = publish.upload_plan(f, m)
    assert {(r["photo_id"], r["kind"]): r["status"] for r in plan.collect()} == {("p", "thumb"): "reused", ("p", "preview"): "upload", ("q", "thumb"): "missing"}
    assert {r["status"]: r["bytes"] for r in publish.upload_totals(plan).collect()} == {"reused": 10, "upload": 20, "missing": 0}
    assert [r["photo_id"] for r in publish.orphan_uploads(m, f).collect()] == ["gone"]
    new = m.limit(1).withColumns({"local_sha": F.lit("s9"), "uploaded_at": F.lit(2).cast("long")})
    assert publish.manifest_put(m, new).where("local_sha = 's9'").count() == 1
    assert publish.manifest_put(m, new).count() == 3


def requests(spark, n=400, seed=0):
    rng = random.Random(seed)
    data = [(f"{rng.randrange(6):016x}", f"v{rng.randrange(4)}", rng.choice(["add", "add", "remove"]), rng.randrange(4000), i) for i in range(n)]
    return data, spark.createDataFrame(data, jobs.REQUESTS)


def plain_accepted(data, limit, window):
    out, state = {}, {}
    for _, v, _, t, s in sorted(data, key=lambda r: (r[3], r[4])):
        q = state.setdefault(v, deque())
        while q and q[0] < t - window:
            q.popleft()
        out[s] = len(q) < limit
        if out[s]:
            q.append(t)
    return out


def test_limits_and_hearts(spark):
    data, df = requests(spark)
    small = Config(heart_limit=5, heart_window=300)
    got = {r["seq"]: r["accepted"] for r in hearts.rate_limit(df, small).collect()}
    assert got == plain_accepted(data, 5, 300)
    assert 0 < sum(got.values()) < len(got)
    state = {}
    for p, v, a, t, s in sorted(data, key=lambda r: (r[3], r[4])):
        if a == "add":
            state.setdefault((p, v), t)
        else:
            state.pop((p, v), None)
    assert {(r["photo_id"], r["voter"]): r["created_at"] for r in hearts.fold(df).collect()} == state
    top = hearts.top_hearts(hearts.heart_counts(hearts.fold(df)), spark.createDataFrame([(f"{1:016x}", "a/b")], "photo_id string, rel_path string"), 0)
    assert top.count() == 1


@pytest.mark.parametrize(("limit", "window"), [(3, 50), (1, 7), (5, 1)])
def test_one_voter_has_all_writes(spark, limit, window):
    """With pauses of all lengths around the window, many writes in a second, and rows that repeat or have no voter or time."""
    rng, t, data = random.Random(limit), 1000, []
    for k in range(1500):
        t += rng.choice((0, 0, 1, window - 1, window, window + 1, 2 * window, rng.randrange(4 * window)))
        data.append(("p", rng.choice(("v", "v", None)), "add", t, k))
    data += [("p", "v", "add", None, 9000), *data[:5]]
    df = spark.createDataFrame(data, jobs.REQUESTS)
    out = hearts.rate_limit(df, Config(heart_limit=limit, heart_window=window)).collect()
    want = []
    for voter in ("v", None):
        state = deque()
        own = sorted((r[3], r[4]) for r in data if r[1] == voter and r[3] is not None)
        flags = hearts.accept_in_order([x for x, _ in own], limit, window, state)
        want += [(str(voter), *x, f) for x, f in zip(own, flags, strict=True)]
    assert sorted((str(r["voter"]), r["ts"], r["seq"], r["accepted"]) for r in out if r["ts"] is not None) == sorted(want)
    assert [r["accepted"] for r in out if r["ts"] is None] == [False]


def test_pieces_of_a_voter_go_to_many_tasks(spark):
    small = Config(heart_limit=2, heart_window=60)
    df = spark.range(400).select(F.lit("p").alias("photo_id"), F.lit("v").alias("voter"), F.lit("add").alias("action"), (F.col("id") * 1000).alias("ts"), F.col("id").alias("seq"))
    seconds = df.groupBy("voter", "ts").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small tasks are joined
    used = hearts.limited_seconds(seconds, 2, 60).select(F.spark_partition_id().alias("task")).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert used > 1
    assert hearts.rate_limit(df, small).where("accepted").count() == 400


def test_requests_are_checked(spark):
    token = "a" * 16
    data = [("0" * 16, token), ("0" * 15, token), ("0" * 16, "short"), ("f" * 16, token), (None, None), ("0" * 15, "short")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "seq long, photo_id string, token string")
    allowed = spark.createDataFrame([("0" * 16, "a", 1)], "photo_id string, rel_path string, added_at long")
    got = [r["reject_reason"] for r in hearts.validate(df, allowed).orderBy("seq").collect()]
    assert got == [None, "malformed photo_id", "missing token", "unknown photo_id", "malformed photo_id", "malformed photo_id"]
    assert "token" not in hearts.with_voters(df, "salt").columns
    new = spark.createDataFrame([("0" * 16, "z", 1), ("1" * 16, "p" * 600, 2), ("1" * 16, "q", 3), ("bad", "r", 4)], "photo_id string, rel_path string, pos int")
    both, counts = hearts.register_photos(allowed, new, 9)
    assert {r["photo_id"]: (r["rel_path"], r["added_at"]) for r in both.collect()} == {"0" * 16: ("z", 1), "1" * 16: ("q", 9)}
    assert tuple(counts.first()) == (3, 1, 2)


END = [("f" * 16, "nobody", "remove", 10**9, 10**9)]


def stream_of(spark, folder):
    return spark.readStream.schema(jobs.REQUESTS).option("recursiveFileLookup", True).parquet(folder)


def put_batch(spark, folder, k, rows):
    spark.createDataFrame(rows, jobs.REQUESTS).coalesce(1).write.parquet(f"{folder}/{k}")


def test_stream_is_batch(spark, tmp_path):
    """Writes come out of order, within the time allowed; the log goes between batches and counts don't need it; a batch runs twice."""
    data, df = requests(spark, 300, 3)
    small = Config(heart_limit=5, heart_window=300)
    rng = random.Random(7)
    late = sorted(data, key=lambda r: r[3] + rng.randrange(400))
    where = {k: str(tmp_path / k) for k in ("in", "log", "cp", "counts", "kept")}

    def run():
        jobs.heart_log(stream_of(spark, where["in"]), small, where["log"], where["cp"], where["counts"], "400 seconds", roll=2).awaitTermination()

    for k in range(3):
        put_batch(spark, where["in"], k, late[100 * k : 100 * (k + 1)])
        run()
        jobs.logged(spark, where["log"]).write.parquet(f"{where['kept']}/{k}")
        shutil.rmtree(where["log"])
    put_batch(spark, where["in"], 3, END)
    run()
    jobs.logged(spark, where["log"]).write.parquet(f"{where['kept']}/3")
    want = hearts.rate_limit(df, small).where("accepted")
    kept = jobs.logged(spark, where["kept"]).where("voter <> 'nobody'")
    assert sorted(r["seq"] for r in kept.collect()) == sorted(r["seq"] for r in want.collect())
    counts = {r["photo_id"]: r["hearts"] for r in hearts.heart_counts(hearts.fold(want)).collect()}
    assert {r["photo_id"]: r["hearts"] for r in jobs.running_counts(spark, where["counts"]).collect()} == counts
    assert {r["photo_id"]: r["hearts"] for r in jobs.counts_from_log(spark, where["kept"]).collect()} == counts
    assert (tmp_path / "counts/sums").exists()
    last = max(int(p.name) for p in (tmp_path / "cp/commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "cp/commits").glob(f"*{last}*"):
        p.unlink()
    run()
    assert {r["photo_id"]: r["hearts"] for r in jobs.running_counts(spark, where["counts"]).collect()} == counts


def test_idle_voters_are_forgotten(spark, tmp_path):
    """After the window, a voter has no state and no timer left."""
    small = Config(heart_limit=2, heart_window=100)
    for k, at in enumerate((1000, 1050, 5000, 9000)):
        put_batch(spark, str(tmp_path / "in"), k, [("p", f"v{k}", "add", at, k)])
        out = jobs.limited_stream(stream_of(spark, str(tmp_path / "in")), small, "10 seconds")
        seen = []
        out.writeStream.foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start().awaitTermination()  # noqa: B023
    states = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "times").load()
    assert states.count() <= 1


def test_many_writes_of_one_voter(spark, tmp_path):
    """They are kept in chunks and read one by one."""
    n = 60_000
    df = spark.range(n).select(F.lit("p").alias("photo_id"), F.lit("v").alias("voter"), F.lit("add").alias("action"), (F.col("id") * 7919 % n + 1).alias("ts"), F.col("id").alias("seq"))
    df.write.parquet(str(tmp_path / "in/0"))
    put_batch(spark, str(tmp_path / "in"), 1, END)
    small = Config(heart_limit=5, heart_window=300)
    out = jobs.limited_stream(stream_of(spark, str(tmp_path / "in")), small)
    put = lambda b, k: b.write.parquet(str(tmp_path / f"out/{k}"))
    out.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).where("voter = 'v'")
    assert got.count() == n
    assert {r["seq"] for r in got.where("accepted").collect()} == {r["seq"] for r in hearts.rate_limit(df, small).where("accepted").collect()}


def png(path, gray):
    h, w = gray.shape
    raw = b"".join(b"\0" + np.repeat(r, 3).astype(np.uint8).tobytes() for r in gray)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_pictures(spark, tmp_path):
    rng = np.random.default_rng(0)
    # smooth, so that half the pixels hold the same picture
    y, x = np.mgrid[0:240, 0:320]
    smooth = sum(30 * np.sin(x / w + a) * np.cos(y / v + b) for w, v, a, b in rng.uniform(4, 12, (4, 4))) + 128
    png(tmp_path / "a.png", smooth)
    png(tmp_path / "b.png", (smooth[::2, ::2] + smooth[1::2, ::2] + smooth[::2, 1::2] + smooth[1::2, 1::2]) / 4)
    png(tmp_path / "flat.png", np.full((50, 80), 255))
    (tmp_path / "bad.png").write_bytes(b"no")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in measure.measure_images(files.read_images(spark, str(tmp_path))).collect()}
    assert (got["a.png"]["width"], got["a.png"]["height"]) == (320, 240)
    assert got["a.png"]["sharpness"] > 1
    assert abs(got["a.png"]["sharpness"] / got["b.png"]["sharpness"] - 1) < 0.5
    assert (int(got["a.png"]["phash"], 16) ^ int(got["b.png"]["phash"], 16)).bit_count() <= 2
    assert (got["flat.png"]["sharpness"], got["flat.png"]["clip_hi"]) == (0.0, 1.0)
    assert got["bad.png"]["error"]
    listed = files.list_media(spark, str(tmp_path))
    assert {r["rel_path"] for r in listed.collect()} == {"a.png", "b.png", "flat.png", "bad.png"}


def test_incremental_scan(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    lib, cat = str(tmp_path / "lib"), str(tmp_path / "cat")

    def run(checkpoint):
        measure = lambda b: catalog.evolve(b.select("path", F.col("length").alias("size"), F.concat(F.lit("n"), F.col("length").cast("string")).alias("filename")))
        jobs.incremental_scan(jobs.scan_files(spark, lib), measure, cat, str(tmp_path / checkpoint)).awaitTermination()
        return sorted((r["size"], r["filename"]) for r in jobs.current_catalog(spark, cat).collect())

    assert jobs.current_catalog(spark, cat).count() == 0
    (tmp_path / "lib/a.jpg").write_bytes(b"1")
    assert run("cp") == [(1, "n1")]
    (tmp_path / "lib/b.jpg").write_bytes(b"22")
    assert run("cp") == [(1, "n1"), (2, "n2")]
    # a fresh checkpoint sees all files again and loses none; names stay as first written
    (tmp_path / "lib/c.jpg").write_bytes(b"333")
    assert run("fresh") == [(1, "n1"), (2, "n2"), (3, "n3")]
    (tmp_path / "lib/a.jpg").write_bytes(b"4444")
    assert run("third") == [(2, "n2"), (3, "n3"), (4, "n1")]
    jobs.compact(spark, cat, str(tmp_path / "small"))
    assert jobs.current_catalog(spark, str(tmp_path / "small")).count() == 3


def test_hearts_as_keyed_state(spark, tmp_path):
    batches = [[("p", "v", "add", 5, 1), ("p", "w", "add", 6, 2)], [("p", "v", "remove", 4, 0), ("p", "w", "remove", 7, 3)], [("p", "w", "add", 7, 2), ("p", "v", "add", 9, 9)]]
    seen = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, jobs.REQUESTS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        source = spark.readStream.schema(jobs.REQUESTS).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        put = lambda b, n: seen.extend(tuple(r) for r in b.where("change <> 0").select("photo_id", "voter", "change").collect())
        jobs.heart_changes(source).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    assert sorted(seen) == [("p", "v", 1), ("p", "w", -1), ("p", "w", 1)]


def test_logs_and_manifests(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"photo_id": "p", "token": "t", "action": "add", "ts": 3, "seq": 1}\n{"photo_id": "q"}\n')
    assert [tuple(r) for r in files.read_heart_log(spark, str(tmp_path / "log")).orderBy("photo_id").collect()] == [("p", "t", "add", 3, 1), ("q", None, None, None, None)]
    assert files.stream_heart_log(spark, str(tmp_path / "log")).isStreaming
    path = str(tmp_path / "m")
    assert files.read_manifest(spark, path).count() == 0
    for sha, at in (("a", 1), ("b", 2)):
        files.append_manifest(spark.createDataFrame([("p", "thumb", sha, "/u", "f", at)], files.MANIFEST), path)
    assert [r["local_sha"] for r in files.read_manifest(spark, path).collect()] == ["b"]
    (tmp_path / "web.json").write_text('{"00112233445566FF": ["a", 1], "no id": ["b"]}')
    tags, dropped = files.read_web_tags(spark, str(tmp_path / "web.json"))
    assert [tuple(r) for r in tags.collect()] == [("00112233445566ff", ["a"])]
    assert dropped.first()["dropped_keys"] == 1
    df = rows(spark, [{"path": "/a", "composite": 80.0, "verdict": "TOP PICK"}, {"path": "/b", "verdict": "PASS"}])
    files.write_shortlist(df, C, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 1


def test_slugs_skip_taken_ones(spark):
    names = ["a", "A!", "a 2", "b", "a-2", "a", "ä", "日本", "日本 "]
    df = spark.createDataFrame([(f"{n}", i) for i, n in enumerate(names)], "gallery string, idx int")
    got = [r["slug"] for r in publish.gallery_slugs(df).orderBy("idx").collect()]
    assert got[:7] == ["a", "a-2", "a-2-2", "b", "a-2-3", "a-3", "a-4"]
    assert len({g.lower() for g in got}) == len(names)


def test_order_numbers(spark):
    from medialedger.operators.order import numbered

    values = [random.Random(4).random() for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    got = {r["v"]: r["n"] for r in numbered(df, "n", F.col("v")).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}


def test_embeddings(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])], "id int, embedding array<float>")
    p = spark.createDataFrame([(0, "primary", "lake", [1.0, 0.0, 0.0]), (1, "secondary", "dog", [0.0, 1.0, 0.0]), (2, "distractor", "text", [0.0, 0.0, 1.0])], "prompt_id int, tier string, label string, embedding array<float>")
    got = {r["id"]: (round(r["subject_score"], 3), r["subject_label"], r["subject_tier"]) for r in measure.subject_match(e, p, C, 3).collect()}
    assert got[1] == (100.0, "lake", "primary")
    assert got[2] == (100.0, "dog", "secondary")
    assert got[3][0] == 0.0
    w, b = measure.fold_layers([(np.array([[1.0, 2.0, 3.0], [0.0, 1.0, 0.0]]), np.array([1.0, 1.0])), (np.array([[2.0, 1.0]]), np.array([0.5]))])
    assert [r[0] for r in e.select(measure.affine(F.col("embedding"), w, b)).collect()] == pytest.approx([5.5, 8.5, 9.5])
    with pytest.raises(Exception, match="embedding of 4 values"):
        e.select(measure.checked(F.col("embedding"), 4)).collect()


def test_calibration_files(spark, tmp_path):
    fitted = C.with_values({"aesthetic_range": (1.0, 2.0), "keeper_count": 7, "unknown": 1})
    files.write_calibration(spark, fitted, str(tmp_path / "c"))
    assert files.read_calibration(spark, str(tmp_path / "c"), C) == fitted
    assert files.read_calibration(spark, str(tmp_path / "none"), C) == C


def test_reports(spark, tmp_path):
    df = rows(spark, [{"path": "/a", "composite": 1.0, "taken_at": "2011-06-28 07:00:00", "width": 6000, "height": 4000}, {"path": "/b", "error": "x"}]).withColumn("tags", F.array(F.lit("p"), F.lit("q")))
    files.write_report(df, str(tmp_path / "r"))
    got = spark.read.option("header", True).csv(str(tmp_path / "r")).collect()
    assert len(got) == 2
    assert got[0]["taken_date"] == "June 28, 2011"
    assert got[0]["tags"] == "p; q"


def plain_tags(tags, items):
    """Every key against every photo, as text."""
    order = sorted(items, key=lambda r: (r["composite"] is None, -(r["composite"] or 0), r["path"]))
    norm = lambda x: x.replace("\\", "/").lower()
    ids = {r["photo_id"] for r in items}
    own = {r["key"]: r["_id"] for r in tags}
    out = {}
    for r in sorted(tags, key=lambda r: r["key"]):
        hit = own[r["key"]] if own[r["key"]] in ids else next((i["photo_id"] for i in order if i["rel_path"] and norm(r["key"]).endswith(norm(i["rel_path"]))), None)
        if hit:
            out[hit] = sorted(set(r["tags"]))
    return out


def test_endings_of_paths_are_brute_force(spark):
    rng = random.Random(8)
    names = ["a", "ba", "cba", "IMG_1.jpg", "xIMG_1.jpg", "b", "", "é"]
    path = lambda n: rng.choice(("/", "\\", "/")).join(rng.choice(names) for _ in range(rng.randint(1, n)))
    rels = sorted({path(3) for _ in range(120)})
    items = spark.createDataFrame([(f"/lib/{r}", r, rng.choice((None, 1.0, 2.0, 3.0))) for r in rels], "path string, rel_path string, composite double").withColumn("photo_id", publish.photo_id(F.col("rel_path")))
    tags = spark.createDataFrame([(k, [f"t{n}", "x"]) for n, k in enumerate(sorted({path(5) for _ in range(400)}))], "key string, tags array<string>")
    got = {r["photo_id"]: r["tags"] for r in publish.resolve_tags(tags, items).collect()}
    assert got == plain_tags(tags.withColumn("_id", publish.photo_id(F.col("key"))).collect(), items.collect())


def test_shared_file_names_make_no_pairs(spark):
    """One name in as many folders, and photos without a folder: rows grow with the keys, not with keys times photos."""
    n = 20_000
    keys = spark.range(n).select(F.concat(F.lit("/old/f"), F.col("id").cast("string"), F.lit("/IMG_0001.jpg")).alias("key"), F.array(F.col("id").cast("string")).alias("tags"))
    nested = spark.range(n).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit("/IMG_0001.jpg")).alias("rel_path"))
    root = spark.range(2000).select(F.concat(F.lit("R"), F.col("id").cast("string"), F.lit(".jpg")).alias("rel_path"))
    items = nested.unionByName(root).select(F.concat(F.lit("/lib/"), "rel_path").alias("path"), "rel_path", F.lit(1.0).alias("composite"), publish.photo_id(F.col("rel_path")).alias("photo_id"))
    heads = items.select(F.substring_index(F.lower("rel_path"), "/", 1).alias("head"))
    assert publish.path_endings(keys.select("key", F.lower("key").alias("norm")), heads).count() == n
    got = publish.resolve_tags(keys, items)
    assert got.count() == n
    assert got.where(F.col("photo_id") == publish.photo_id(F.concat(F.lit("f"), F.col("tags")[0], F.lit("/IMG_0001.jpg")))).count() == n


def test_search_is_brute_force(spark, tmp_path):
    """Terms within texts and tags, over their borders, with repeated letters, short ones and none."""
    rng = random.Random(11)
    words = ["ana", "banana", "an", "Größe", "a", "nan", "x y", "2019 - Trip", "_"]
    df = rows(spark, [{"path": f"/{k}", "folder": rng.choice(words), "filename": f"{rng.choice(words)}{k}.jpg", "verdict": "STRONG", "composite": 70.0, "aesthetic_raw": 5.0} for k in range(300)])
    df = df.withColumn("tags", F.when(F.length("folder") > 2, F.array(F.col("filename"), F.lit("banana"))).otherwise(F.array().cast("array<string>")))
    df = df.unionByName(df.limit(3))
    index = str(tmp_path / "index")
    search.write_index(df, index)
    everything = report.card_filter(duplicates=True)
    for term in ("banana", "nanan", "ana", "ANA|B", "ÖSSE", "größe1", "größe", "an", "", "2019 - trip", "nothing like it", "a2", "jpg|ban"):
        got = sorted(r["path"] for r in search.search_cards(df, index, term, everything).collect())
        assert got == sorted(r["path"] for r in df.where(report.card_filter(duplicates=True, text=term)).collect()), term
    with pytest.raises(ValueError, match="no posting list"):
        search.find(spark, index, "ab")


def test_search_reads_posted_rows(spark, tmp_path):
    """Of many posting lists only the row groups of the term's are read, and no card is."""
    df = rows(spark, [{"path": f"/{k}", "folder": "some folder of many", "filename": f"{k * 7919 % 100_000:06d}.jpg"} for k in range(4000)]).withColumn("tags", F.array(F.lit("one"), F.lit("two")))
    index = str(tmp_path / "index")
    spark.sparkContext._jsc.hadoopConfiguration().setInt("parquet.block.size", 1 << 16)
    search.write_index(df, index)
    spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    found = search.find(spark, index, "007919")
    assert [r["path"] for r in found.collect()] == ["/1"]
    leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
    read = sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()) if "Scan" in leaves.apply(k).nodeName() and "parquet" in leaves.apply(k).nodeName())
    spark.conf.unset("spark.sql.adaptive.enabled")
    total = spark.read.parquet(index).count()
    assert 0 < read < total / 5


def test_slugs_are_those_of_one_pass(spark):
    """Names of few letters and numbers, so that plain and numbered slugs meet in all ways."""
    rng = random.Random(13)
    for size in (60, 400):
        names = [" ".join(rng.choice(("a", "A!", "2", "3", "4", "02", "é", "日")) for _ in range(rng.randint(1, 3))) for _ in range(size)]
        df = spark.createDataFrame(list(zip(names, range(size), strict=True)), "gallery string, idx int").repartition(3)
        got = {r["idx"]: r["slug"] for r in publish.gallery_slugs(df).collect()}
        given = set()
        for k, name in enumerate(names):
            plain, number = slugify(name), 1
            found = plain
            while found.lower() in given:
                number += 1
                found = f"{plain}-{number}"
            given.add(found.lower())
            assert got[k] == found, (k, name)


def test_numbered_names_are_not_one_family(spark):
    """`Set`, `Set 2` ... and many galleries of one name: nothing is decided in one task but where numbers meet."""
    n = 5000
    sets = spark.range(1, n + 1).select(F.concat(F.lit("Set "), F.col("id").cast("string")).alias("gallery"), F.col("id").cast("int").alias("idx"))
    more = spark.createDataFrame([("Set", 0), *((f"Trip{'!' * k}", n + 1 + k) for k in range(50))], "gallery string, idx int")
    bases = sets.unionByName(more).select(slug(F.col("gallery")).alias("base")).groupBy("base").agg(F.count(F.lit(1)).alias("k"))
    assert publish.contested(bases).count() == 0
    got = {r["idx"]: r["slug"] for r in publish.gallery_slugs(sets.unionByName(more)).collect()}
    assert got == {0: "set"} | {k: f"set-{k}" for k in range(1, n + 1)} | {n + 1 + k: "trip" if not k else f"trip-{k + 1}" for k in range(50)}


def shuffled_sides(df, marker):
    """Exchanges of a plan with a scan of the marked table below."""
    found = []

    def walk(node, above):
        name = node.nodeName()
        if "Scan" in name and marker in name:
            found.append([x for x in above if "Exchange" in x])
        for k in range(node.children().size()):
            walk(node.children().apply(k), [*above, name])

    walk(df._jdf.queryExecution().executedPlan(), [])
    return found


def test_keyed_snapshot_is_not_shuffled(spark, tmp_path):
    """Resuming, existence and upserts by file give what plain catalogs give, and shuffle the other side only."""
    items = [{"path": f"/lib/{k}.jpg", "filename": f"{k}.jpg", "mtime": float(k), "size": k, "aesthetic_raw": 5.0} for k in range(200)]
    items += [{"path": f"/lib/c{k}.mp4#{t}", "source_video": f"/lib/c{k}.mp4", "timestamp_s": float(t), "size": 1, "error": "x" if k % 3 == 0 else None} for k in range(20) for t in range(4)]
    cat = rows(spark, items)
    where = str(tmp_path / "dealt_by_file")
    files.write_keyed(cat, where, 6)
    stored = files.read_keyed(spark, where)
    assert stored.count() == len(items)
    listing = spark.createDataFrame([(f"/lib/{k}.jpg", float(k) + (k % 5), k + (k % 7 == 0)) for k in range(0, 300, 2)] + [(f"/lib/c{k}.mp4", 0.0, 0) for k in range(0, 40, 2)], "path string, mtime double, size long")
    listing.write.parquet(str(tmp_path / "listing"))
    listing = spark.read.parquet(str(tmp_path / "listing"))
    new = rows(spark, [{"path": f"/lib/{k}.jpg", "filename": "new", "size": 1000 + k} for k in range(100, 260)] + [{"path": "/lib/c1.mp4#2", "source_video": "/lib/c1.mp4", "size": 9}])
    pairs = [
        lambda c: catalog.resume_todo(listing, c).select("path"),
        lambda c: catalog.existing_only(c, listing).select("path"),
        lambda c: catalog.upsert(c, new if c is cat else catalog.keyed(new)).select("path", "filename", "size", "error"),
    ]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    for f in pairs:
        plain, own = f(cat), f(stored)
        sides = shuffled_sides(own, "keyed_")
        assert sides
        assert not any(sides), sides
        assert sorted(map(str, own.collect())) == sorted(map(str, plain.collect()))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_large_objects_are_read_by_many_tasks(spark, tmp_path):
    """Against the standard library, with splits of a few bytes: brackets, quotes and commas in keys and values, equal keys."""
    rng = random.Random(17)
    texts = ["a", "]", "[x]", 'say "hi"', "b,c", "{", "}", "\\", "\\\\", "é日", "line\nline", "", " "]

    def thing(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind == 4:
            return [thing(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 5:
            return {rng.choice(texts): thing(depth - 1) for _ in range(rng.randrange(3))}
        return (rng.choice(texts), rng.randrange(9), None, True)[kind]

    whole = {}
    for k in range(6):
        entries = [(rng.choice(texts) + str(rng.randrange(30)), [thing(2) for _ in range(rng.randrange(4))] if rng.random() < 0.7 else thing(2)) for _ in range(40 * (k > 0))]
        space = rng.choice(("", " ", "\n  "))
        body = f",{space}".join(f"{json.dumps(a, ensure_ascii=k % 2 == 0)}:{space}{json.dumps(b, ensure_ascii=k % 2 == 0)}" for a, b in entries)
        (tmp_path / f"{k}.json").write_text(f"{space}{{{space}{body}{space}}}\n")
        whole[f"{k}.json"] = dict(entries)
    for k, text in enumerate(('{"a": [1], "b": [2', '{"a": [1],}', '[{"a": [1]}]', '{"a": ["x]}', "", '{"a": [1,]}', "nothing", '{"a": [1]} {"b": [2]}')):
        (tmp_path / f"bad{k}.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    got = {}
    for r in large_json.object_entries(spark, str(tmp_path / "*.json")).select("file", "key", F.to_json("value").alias("value")).collect():
        got.setdefault(r["file"].rsplit("/", 1)[-1], {})[r["key"]] = json.loads(r["value"])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {k: v for k, v in whole.items() if v}


def test_arriving_hashes_are_those_of_a_full_run(spark):
    """Chains that new hashes close, old ones that come again, and hashes that meet nothing."""
    rng = random.Random(23)
    hashes = set()
    for _ in range(60):
        h = rng.getrandbits(64)
        for _ in range(rng.choice((1, 1, 4, 12))):
            hashes.add(h)
            for _ in range(rng.randint(1, 4)):
                h ^= 1 << rng.randrange(64)
    signed = [h - (1 << 64) if h >> 63 else h for h in sorted(hashes)]
    late = rng.sample(signed, len(signed) // 4)
    old = [h for h in signed if h not in set(late)]
    frame = lambda x: spark.createDataFrame([(h,) for h in x], "h long")
    masks = dedup.band_masks(4, len(old))
    roots = dedup.hash_roots(frame(old), 4)
    got = {r["h"]: r["root"] for r in dedup.extended_roots(roots, dedup.probes(frame(old), masks), frame([*late, *old[:5], late[0]]), 4, masks).collect()}
    assert got == {r["h"]: r["root"] for r in dedup.hash_roots(frame(signed), 4).collect()}
    assert len(set(got.values())) < len(got)
    same = dedup.extended_roots(roots, dedup.probes(frame(old), masks), frame([]), 4, masks)
    assert {tuple(r) for r in same.collect()} == {tuple(r) for r in roots.collect()}


def test_scores_round_as_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    scores = [67.85, 67.25, 70.35, 66.05, 88.15, 66.84999999999999, 70.04999999999998, 99.95]
    items = rows(spark, [{"path": f"/{i}", "rel_path": f"{i}.jpg", "folder": "A", "filename": f"{i}.jpg", "composite": x, "verdict": "STRONG", "note": ""} for i, x in enumerate(scores)])
    g = publish.gallery_items(items, C)
    got = {r["composite"]: r["s"] for r in publish.payload_entries(g, publish.gallery_index(g), C).select("composite", "entry.s").collect()}
    assert got == {x: duckdb.sql(f"select round(cast('{x!r}' as double), 1)").fetchall()[0][0] for x in scores}


def test_index_has_no_row_for_each_letter(spark, tmp_path):
    df = rows(spark, [{"path": f"/{k}", "folder": "f", "filename": f"{k}.jpg"} for k in range(40)]).withColumn("tags", F.array(F.lit("ab cd, " * 500), F.col("path")))
    index = str(tmp_path / "index")
    search.write_index(df.repartition(2), index)
    assert spark.read.parquet(index).count() < 2000 < 40 * 3500
    assert {r["path"] for r in search.search_cards(df, index, "|/17", report.card_filter(duplicates=True)).collect()} == {"/17"}


def test_posted_grams_are_brute_force(monkeypatch):
    rng = random.Random(5)
    texts = ["", "ab", "日本", *("".join(rng.choice("ab é日|\0") for _ in range(rng.randint(0, 60))) for _ in range(200)), "", "x"]
    want = {(int.from_bytes(t[k : k + 3], "big"), n) for n, t in enumerate(x.encode() for x in texts) for k in range(len(t) - 2)}
    for size in (10, 200, 1 << 22):
        monkeypatch.setattr(search, "BYTES", size)
        for at in (0, 7):
            gram, card = search.posted(pa.array(["before"] * at + texts, pa.string()).slice(at))
            assert list(zip(gram.tolist(), card.tolist(), strict=True)) == sorted(want)


def test_hashes_are_shuffled_once(spark):
    """Probes go to their blocks in one exchange; groups are counted from a part of them."""
    rng = random.Random(3)
    h = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(500)], "h long")
    plan = blocks.dealt(dedup.probes(h, dedup.band_masks(5)), "key", "h", 64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_large_group_is_dealt(spark):
    df = spark.range(4000).select(F.lit(1).alias("key"), F.col("id").alias("h"))
    got = blocks.dealt(df, "key", "h", 500).groupBy("key", "lo", "hi").count().collect()
    assert len(got) > 20
    assert max(r["count"] for r in got) < 2000
