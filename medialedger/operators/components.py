"""Connected components over links between 64-bit numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster; a new local one only where none is set and all runs on one machine."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that no lineage and no executor is needed again."""
    path = f"{scratch(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def connected(pairs: DataFrame) -> DataFrame:
    """(node, root) from pairs (a, b): root is the smallest node that a node reaches.

    Each round links what lies above a node to the smallest of its neighbours, then what is left to the smallest below, and
    is written once. The number of rounds grows with the logarithm of a chain's length, so long bursts close soon.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    links = stored(pairs.where("a <> b").select(high, low).distinct())
    seen = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            roots = links.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        seen = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        above = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = above.groupBy("a").agg(F.min("b").alias("least"))
        rest = above.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        links = stored(rest.unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct())
