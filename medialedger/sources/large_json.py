"""One large JSON object, read by many tasks.

The file is read in pieces that end at a closing bracket. Whether a piece begins within a string, and how deep, follows from sums
over the pieces before it, of quotes first and of brackets then; each piece is then cut at the commas of the object itself,
and what lies between two of them, maybe over several pieces, is one entry. Sums are taken by blocks of the file, the blocks' sums
are few and are added up first. Only an entry has to fit into memory, not the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import stored

SIGN = re.compile(r'\\.|["\[\]{},]', re.S)
#: Where a piece stands.
PLACE = ["file", "block", "at"]


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes of each piece, and by how much it goes deeper if it begins outside of a string, and within one."""
    for batch in batches:
        quotes, outside, inside = [], [], []
        for text in batch.column("value").to_pylist():
            within, deeper = 0, [0, 0]
            for sign in SIGN.findall(text):
                if sign == '"':
                    within ^= 1
                elif sign in "[{":
                    deeper[within] += 1
                elif sign in "]}":
                    deeper[within] -= 1
            quotes.append(within)
            outside.append(deeper[0])
            inside.append(deeper[1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(quotes, pa.int64()), pa.array(outside, pa.int64()), pa.array(inside, pa.int64())], [*batch.schema.names, "quotes", "outside", "inside"])


def _cut(text: str, within: bool, depth: int) -> tuple[list[str], int, bool]:
    """Parts of a piece between the object's own commas, how many objects begin in it, and whether it has more than white space
    outside of them.
    """
    parts, start, begun, odd = [], 0, 0, False
    if not depth:
        start = text.find("{")
        odd = bool(text[: start if start >= 0 else None].strip(" \t\r\n]"))
        if start < 0:
            return [""], 0, odd
    for m in SIGN.finditer(text, start):
        sign = m[0]
        if sign == '"':
            within = not within
        elif within or sign[0] == "\\":
            continue
        elif sign in "[{":
            if not depth:
                start, begun = m.end(), 1
            depth += 1
        elif sign in "]}":
            depth -= 1
            if not depth:
                parts.append(text[start : m.start()])
                return parts, begun, odd or bool(text[m.end() :].strip(" \t\r\n]"))
        elif depth == 1:
            parts.append(text[start : m.start()])
            start = m.end()
    parts.append(text[start:])
    return parts, begun, odd


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("value", "quotes_before", "depth_before")), strict=True)
        cut = [_cut(text, bool(q % 2), d) for text, q, d in rows]
        more = [pa.array([c[0] for c in cut], pa.list_(pa.string())), pa.array([len(c[0]) - 1 for c in cut], pa.int64()), pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.bool_())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PLACE), *more], [*PLACE, "parts", "commas", "begun", "odd"])


def _summed(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with `name`, the sum of `value` over the pieces before in their file."""
    blocks = rows.groupBy("file", "block").agg(F.sum(value).alias("_of_block"))
    over = F.sum("_of_block").over(W.partitionBy("file").orderBy("block")) - F.col("_of_block")
    before = blocks.select("file", "block", over.alias("_before"))
    own = F.sum(value).over(W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0)) - F.col(value)
    return rows.withColumn("_own", own).join(before, ["file", "block"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_before", "_own")


def object_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, key, value): the entries of the JSON object in each file, in order; value is a variant.

    A file that isn't one well-formed object has none. Of equal keys the last counts.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    pieces = spark.read.option("lineSep", "]").text(path).select(*where, F.concat("value", F.lit("]")).alias("value"))
    # written once, as numbers of rows have to stay
    changed = stored(pieces.mapInArrow(_changes, "file string, block long, at long, value string, quotes long, outside long, inside long"))
    placed = _summed(changed, "quotes", "quotes_before")
    placed = placed.withColumn("deeper", F.when(F.col("quotes_before") % 2 == 0, F.col("outside")).otherwise(F.col("inside")))
    placed = stored(_summed(placed, "deeper", "depth_before").select(*PLACE, "value", "quotes", "deeper", "quotes_before", "depth_before"))
    cut = stored(_summed(placed.mapInArrow(_parts, "file string, block long, at long, parts array<string>, commas long, begun long, odd boolean"), "commas", "entry"))
    # the bracket added after a file's last piece takes it one below its end
    ended = placed.groupBy("file").agg((F.sum("quotes") % 2).alias("quotes"), F.sum("deeper").alias("deeper")).where("quotes = 0 and deeper = -1")
    whole = cut.groupBy("file").agg(F.sum("begun").alias("begun"), F.count_if("odd").alias("odd")).where("begun = 1 and odd = 0").join(ended, "file", "left_semi")
    each = cut.select("file", "block", "at", "entry", F.posexplode("parts").alias("k", "part")).withColumn("entry", F.col("entry") + F.col("k"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "part"))), lambda x: x["part"]), "")
    entries = each.groupBy("file", "entry").agg(texts.alias("text"))
    found = stored(entries.withColumn("v", F.try_parse_json(F.concat(F.lit("{"), "text", F.lit("}")))).select("file", "entry", "text", "v"))
    blank = ~F.col("text").rlike(r"\S")
    bad = found.groupBy("file").agg((F.count_if(F.col("v").isNull()) + F.when(F.count(F.lit(1)) > 1, F.count_if(blank)).otherwise(0)).alias("bad")).where("bad = 0")
    good = found.where(~blank).join(bad, "file", "left_semi").join(whole, "file", "left_semi")
    pairs = spark.sql("select g.file, g.entry, e.key, e.value from {good} g, lateral variant_explode(g.v) e", good=good)
    return pairs.groupBy("file", "key").agg(F.max("entry").alias("entry"), F.max_by(F.to_json("value"), "entry").alias("value")).select("file", "entry", "key", F.parse_json("value").alias("value"))
