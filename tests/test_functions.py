"""Tables of cases for the column functions."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from medialedger.config import Config
from medialedger.functions import dates, paths, scoring, tags

C = Config()


def values(spark, cases, build):
    """build(column) over the cases' first items, as a list."""
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"))).collect()]


def check(spark, table, build):
    assert values(spark, [k for k, _ in table], build) == [v for _, v in table]


def dated(year, month, day, sep, name, first):
    """A component with a date at one end, as people write it."""
    date = sep.join(x for x in (year, month, day) if x)
    return f"{date} {name}" if first else f"{name} {date}"


def test_folder_dates(spark):
    cases = [(dated(y, m, d, sep, "Harbour", first), "Harbour") for y in ("1987", "2024") for m, d in (("01", "31"), ("12", "09"), ("10", "")) for sep in ("-", ".", "_", " ", "") for first in (True, False)]
    # a month or a day that can't be, a year of another century, a year alone, numbers that aren't dates
    cases += [(x, x) for x in ("2024-00-10 Harbour", "2024-10-32 Harbour", "Harbour 2024-19", "1887-10-10 Harbour", "2199 Harbour", "Harbour 1999", "2024101112 Harbour", "Harbour 12", "3 Piers", "1999 640 Piers")]
    # nothing but a date stays, and so do separators and what lies between
    cases += [("2024-10-11", "2024-10-11"), ("2024-10-11 / 2024-10-12", "2024-10-11/2024-10-12"), ("2024-10-11 Harbour\\Quay 2024-10", "Harbour\\Quay"), ("Quay/2024.1.2_Boats/x", "Quay/Boats/x"), ("2024-10-11 Fog 2024-10-12", "Fog"), ("2024-1-5, Fog", "Fog"), ("2024 1011 Fog", "Fog"), ("2024-10-11-12 Fog", "12 Fog"), (None, ""), ("  ", "")]
    check(spark, cases, paths.strip_folder_date)


def test_galleries(spark):
    named = [(dated(str(y), "05", "17", sep, f"Pier {y}", first) + tail, f"Pier {y}") for y in (1996, 2008) for sep in "-. " for first in (True, False) for tail in ("", "/Selects", "\\raw\\x")]
    check(spark, [*named, (None, "Unfiled"), ("", "Unfiled"), ("(root)", "Unfiled"), ("1996-05-17/x", "1996-05-17"), ("Quay\\x/y", "Quay")], paths.folder_group)


def moments(rng, n):
    start = datetime.datetime(1971, 1, 1)
    return [start + datetime.timedelta(seconds=rng.randrange(80 * 365 * 86400)) for _ in range(n)]


def test_pretty_dates(spark):
    """Against the calendar of the standard library; what is no date or no time of day is an empty text."""
    rng = random.Random(21)
    some = moments(rng, 40)
    day = [(f"{m:%Y-%m-%d}{tail}", f"{m:%B} {m.day}, {m.year}") for m in some for tail in ("", f" {m:%H:%M:%S}")]
    wrong = [(x, "") for x in (None, "", "soon", "1988", "1988-07", "1988-00-17", "1988-19-17", "88-07-17", "17.07.1988")]
    check(spark, [*day, *wrong], dates.pretty_date)
    clock = [(f"{m:%Y-%m-%d %H:%M:%S}", f"{m:%H:%M}") for m in some]
    wrong = [(x, "") for x in (None, "1988-07-17", "1988-07-17 31:10:10", "1988-07-17 10:71:10", "1988-07-17 x:y:z")]
    check(spark, [*clock, *wrong], dates.pretty_time)
    both = [(f"{m:%Y-%m-%d %H:%M:%S}", f"{m:%B} {m.day}, {m.year} · {m:%H:%M}") for m in some]
    check(spark, [*both, ("1988-07-17", "July 17, 1988"), (None, "")], dates.pretty_taken)


def test_camera_times(spark):
    """Colons between all parts; a clock that can't be leaves the day; the second tag stands in only where the first is missing."""
    other = "1990:10:20 11:12:13"
    build = lambda c: dates.camera_time(c, F.lit(other), F.lit(None).cast("string"))
    some = moments(random.Random(22), 40)
    whole = [(f"{m:%Y:%m:%d %H:%M:%S}", f"{m:%Y-%m-%d %H:%M:%S}") for m in some]
    days = [(f"{m:%Y:%m:%d}{tail}", f"{m:%Y-%m-%d}") for m in some for tail in ("", " 61:61:61", f" 25:{m:%M:%S}")]
    short = [(f"{m:%Y:%m:%d} {m.hour}:{m.minute}", f"{m:%Y-%m-%d %H:%M}:00") for m in some]
    check(spark, [*whole, *days, *short, ("1988:19:17 10:10:10", None), ("soon", None), ("", "1990-10-20 11:12:13"), (None, "1990-10-20 11:12:13")], build)


def test_video_dates(spark):
    check(spark, [("2019-07-04T18:23:11.000000Z", "2019-07-04 18:23:11"), ("2019:07:04 18:23:11-0600", "2019-07-04 18:23:11"), ("1904-01-01 00:00:00", None), ("1970-05-05 00:00:00", None), ("soon", None), (None, None), ("2019-07-04T24:00:00", None)], dates.video_date)
    build = lambda c: dates.frame_taken_at(c, F.lit(61.9))
    check(spark, [("2019-12-31 23:59:00", "2020-01-01 00:00:01"), ("2019-02-31 00:00:00", None), (None, None)], build)


def plain_tag(raw):
    """Rule by rule: white space becomes a blank, other signs go, blanks are single, ends are bare, forty characters stay."""
    kept = [" " if c.isspace() else c for c in raw or "" if c.isspace() or c in "_-" or c.isascii() and c.isalnum()]
    text = " ".join("".join(kept).split(" ")).strip()
    while "  " in text:
        text = text.replace("  ", " ")
    return text.strip(" _-")[:40].strip(" _-")


def test_tags(spark):
    rng = random.Random(3)
    signs = "ab Z9_-  \t\n\u00a0\u2003é?&;:()/|'"
    typed = [None, "", "_-_", "one" * 20, " -x- "] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 70))) for _ in range(60)]
    check(spark, [(t, plain_tag(t)) for t in typed], tags.sanitize_tag)
    df = spark.createDataFrame([(["b!", " a", "b", "", None, "a  c"],)], "t array<string>")
    assert df.select(tags.clean_web_tags(F.col("t"))).first()[0] == ["a", "a  c", "b"]
    df = spark.createDataFrame([(["Lake", "sea", "LAKE", "Sea", "x"],)], "t array<string>")
    assert df.select(tags.first_spellings(F.col("t"))).first()[0] == ["Lake", "sea", "x"]
    assert df.select(tags.without_tag(F.col("t"), "lake")).first()[0] == ["sea", "Sea", "x"]


def test_hidden(spark):
    check(spark, [("a/_Hidden/x.jpg", True), ("_hidden", True), ("a\\ _hidden \\x", True), ("a/my_hidden/x", False), ("", False), (None, False), ("a/b/_hiddenx", False)], lambda c: paths.is_hidden(c, "_hidden"))
    check(spark, [("a/thumbs/x.jpg", True), ("a/THUMBS/x.jpg", True), ("a/x/thumbs", False), ("thumbs", False)], lambda c: paths.in_folders(c, ("thumbs",)))


def test_floor(spark):
    df = spark.createDataFrame([(499, 4000, True), (500, 500, False), (None, 10, False), (4000, 499, True)], "w int, h int, want boolean")
    assert df.where(~paths.below_floor(F.col("w"), F.col("h"), 500).eqNullSafe(F.col("want"))).count() == 0
    assert df.where(paths.below_floor(F.col("w"), F.col("h"), 0)).count() == 0


def test_ids_and_links(spark):
    same = values(spark, ["A/b.JPG", "a\\B.jpg", "/a/b.jpg/"], paths.photo_id)
    assert len(set(same)) == 1
    assert len(same[0]) == 16
    check(spark, [("D:\\a b\\c#1?.jpg", "file:///D:/a%20b/c%231%3F.jpg"), ("/x/100%.jpg", "file:///x/100%25.jpg"), ("a'b\"c<d>`", "file:///a%27b%22c%3Cd%3E%60")], paths.file_url)
    check(spark, [("D:\\a b\\c.jpg", "file:///D:/a%20b"), ("x", "file:///x")], paths.folder_url)
    check(spark, [("https://h.example/c/i/x.jpg?a=1", "/c/i/x.jpg"), ("/c/x.jpg", "/c/x.jpg"), ("https://h.example", "")], paths.site_relative)
    check(spark, [("clip.mp4#t=12.000", 12.0), ("a#t=1#t=2.5", 2.5), ("a#t=x", None), ("plain", None)], lambda c: paths.split_virtual(c)[1])
    check(spark, [("clip.mp4#t=12.000", "clip.mp4"), ("a#t=1#t=2.5", "a#t=1"), ("a#t=x", "a#t=x"), ("plain", "plain")], lambda c: paths.split_virtual(c)[0])
    check(spark, [("59.9", "0:59"), ("61", "1:01"), ("3725.2", "1:02:05")], lambda c: paths.hhmmss(c.cast("double")))
    assert [paths.slugify(x) for x in ("Café  Zürich!", "--", "日本", "A & B")] == ["cafe-zurich", "--", "%E6%97%A5%E6%9C%AC", "a-b"]


def row(**k):
    base = {"aesthetic_raw": 5.5, "nima_raw": 5.0, "subject_score": 50.0, "subject_label": "lake", "sharpness": 300.0, "clip_hi": 0.0, "clip_lo": 0.0, "source_type": "photo"}
    return base | k


def plain_score(r):
    def scale(v, lo, hi):
        return max(0.0, min(100.0, (v - lo) / (hi - lo) * 100))

    tech = scale(r["nima_raw"], *C.nima_range) if r["nima_raw"] is not None else max(0.0, min(100.0, math.log1p(r["sharpness"]) / math.log1p(800) * 100))
    s = scale(r["aesthetic_raw"], *C.aesthetic_range) * 0.6 + tech * 0.25 + r["subject_score"] * 0.15
    s -= (18 if r["sharpness"] < 60 else 0) + (6 if r["clip_hi"] > 0.12 else 0) + (4 if r["clip_lo"] > 0.35 else 0) + (6 if r["source_type"] == "video_frame" else 0)
    return max(0.0, min(100.0, s))


def test_scores(spark):
    rows = [row(), row(nima_raw=None), row(sharpness=10.0), row(clip_hi=0.13, clip_lo=0.4), row(source_type="video_frame"), row(aesthetic_raw=1.0, subject_score=0.0, nima_raw=1.0, sharpness=1.0), row(aesthetic_raw=9.0, nima_raw=9.0, subject_score=100.0), row(sharpness=60.0, clip_hi=0.12, clip_lo=0.35)]
    schema = "aesthetic_raw double, nima_raw double, subject_score double, subject_label string, sharpness double, clip_hi double, clip_lo double, source_type string"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = [r[0] for r in df.select(scoring.composite(C)).collect()]
    assert got == pytest.approx([plain_score(r) for r in rows])
    notes = [r[0] for r in df.select(scoring.note(C)).collect()]
    assert notes[0] == "Aesthetic 43 · Technical 50 · Lake"
    assert notes[2].endswith(" · out of focus")
    assert notes[3].endswith(" · bright areas clipped")
    assert df.withColumn("subject_label", F.lit("")).select(scoring.note(C)).first()[0].endswith("no clear subject")


def test_note_parts(spark):
    build = lambda k: lambda c: scoring.split_note(c, C)[k]
    cases = ["A · B · out of focus", "A · B", None, "out of focus"]
    assert values(spark, cases, build(0)) == ["A · B", "A · B", "", "out of focus"]
    assert values(spark, cases, build(1)) == ["out of focus", "", "", ""]


def test_verdicts_and_rounding(spark):
    check(spark, [("78", "TOP PICK"), ("77.99", "STRONG"), ("66", "STRONG"), ("54", "MAYBE"), ("53.9", "PASS"), ("0", "PASS")], lambda c: scoring.verdict_for(c.cast("double"), C))
    check(spark, [("72.5", "72"), ("73.5", "74"), ("1234.4", "1234")], lambda c: scoring.rounded(c.cast("double")))
    assert values(spark, ["1"], lambda c: scoring.rescale(c.cast("double"), 2.0, 2.0)) == [50.0]
    df = spark.createDataFrame([(6000, 4000), (None, 3), (0, 3)], "w int, h int")
    assert [r[0] for r in df.select(dates.pretty_resolution(F.col("w"), F.col("h"))).collect()] == ["6000 × 4000 · 24.0 MP", "", ""]
    assert df.select(dates.spec_atoms(F.lit("2011-06-28 07:00:00"), F.col("w"), F.col("h"))).first()[0] == ["June 28, 2011", "07:00", "6000 × 4000", "24.0 MP"]
