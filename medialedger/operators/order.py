"""Numbers in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import stored


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with `name`, their number from 0 in the given order (ascending columns; the last should tell rows apart).

    Rows are dealt into ranges of the order; ranges are counted, and each numbers its own rows.
    """
    keys = {f"_o{k}": c for k, c in enumerate(order)}
    ranged = rows.withColumns(keys).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(W.orderBy("_range")) - F.col("_size")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*keys))
    out = ranged.join(before, "_range").withColumn(name, F.col("_before") + own - 1)
    return out.select(*rows.columns, name)
