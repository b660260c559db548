"""The catalog's columns."""

from pyspark.sql import types as T

CATALOG = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("path", T.StringType()),
            ("rel_path", T.StringType()),
            ("folder", T.StringType()),
            ("filename", T.StringType()),
            ("mtime", T.DoubleType()),
            ("size", T.LongType()),
            ("phash", T.StringType()),
            ("aesthetic_raw", T.DoubleType()),
            ("nima_raw", T.DoubleType()),
            ("subject_score", T.DoubleType()),
            ("subject_label", T.StringType()),
            ("subject_tier", T.StringType()),
            ("sharpness", T.DoubleType()),
            ("clip_hi", T.DoubleType()),
            ("clip_lo", T.DoubleType()),
            ("composite", T.DoubleType()),
            ("verdict", T.StringType()),
            ("note", T.StringType()),
            ("dup_of", T.StringType()),
            ("error", T.StringType()),
            ("scored_at", T.DoubleType()),
            ("source_type", T.StringType()),
            ("source_video", T.StringType()),
            ("timestamp_s", T.DoubleType()),
            ("extracted_path", T.StringType()),
            ("taken_at", T.StringType()),
            ("width", T.IntegerType()),
            ("height", T.IntegerType()),
        )
    ]
)
#: Kept from the old row when a row is written again.
KEPT_ON_UPSERT = ("rel_path", "folder", "filename", "extracted_path")
REPORT_COLUMNS = ("verdict", "composite", "filename", "folder", "note", "subject_label", "subject_tier", "aesthetic_raw", "nima_raw", "subject_score", "sharpness", "clip_hi", "clip_lo", "width", "height", "dup_of", "source_type", "source_video", "timestamp_s", "error")
