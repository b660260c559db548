import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, blank and repeated rows, clashing names."""
    rows = [
        (1, "one two three four five six", "en", "a", 27),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \n\t ", "fr", "b", 4),
        (5, "one two three four five six", "en", "b", 27),
        (5, "one two three four five six", "en", "b", 27),
        (None, "one two three four five seven", None, "c", 29),
        (7, "12 34 !!", "de", "c", 8),
        (8, "word " * 3000, "en", "a", 15000),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
