"""Pieces that several operators share: saved tables, running sums, groups in sorted partitions, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: ASCII white space. It is what bytes.split() splits at.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: SQL for the unsigned CRC-32 of an integer's decimal digits.
CRC32_SQL = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),"
    " lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"
)
#: Tasks hand their rows on in pieces of about so many bytes of text.
PIECE_BYTES = 2_000_000
#: Most places that `marked` has; 64 of them are a row of the table that goes to all tasks.
MARKS = 1 << 24
#: Paths of the tables saved within each `passing_tables` that is open, the innermost last.
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a fresh local one only where none is set, as in tests."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def saved(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """df as a written table in the shared folder: it cuts the lineage, and lost executors don't matter for it. Within
    `passing_tables` it is deleted at the end of that; if `lasting`, at the end of the next outer one, if any.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    owners = _passing.get()[:-1] if lasting else _passing.get()
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables saved within go at its end, so no result that is still to be computed may read one."""
    paths: list[str] = []
    token = _passing.set((*_passing.get(), paths))
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that has been read to its end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pieces(sizes: Iterable[int], most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so many bytes together; a longer row stands alone."""
    start = total = 0
    i = -1
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n + 1
    if i >= start:
        yield start, i + 1


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns `own`, and all others as fields of one column `rest`, so that none of their names can meet an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, (F.struct(*others) if others else F.struct(F.lit(True).alias("\x01"))).alias("rest"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns again, in their order, from rows that `packed` made."""
    packed_names = set(rows.schema["rest"].dataType.fieldNames())
    return rows.select(*(F.col(f"rest.`{c}`").alias(c) if c in packed_names else F.col(f"`{c}`") for c in columns))


def set_apart(docs: DataFrame, *results: str) -> DataFrame:
    """docs with the columns renamed that have the name of a result: `_in` is added until the name is free. Case is ignored."""
    taken = {c.lower() for c in docs.columns} | {r.lower() for r in results}
    names = []
    for c in docs.columns:
        new = c
        if c.lower() in {r.lower() for r in results}:
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
        names.append(new)
    return docs.toDF(*names)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def byte_batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Smaller batches, each with the bytes of one column."""
    for batch in batches:
        raw = texts(batch.column(column))
        for a, b in pieces(0 if t is None else len(t) for t in raw):
            yield batch.slice(a, b - a), raw[a:b]


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 1) -> Iterator[pa.Table]:
    """Whole groups of a partition that is sorted by keys, in tables of several groups."""
    left: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        left.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.Table.from_batches(left).combine_chunks()
        last = [np.asarray(table.column(k)) for k in keys]
        same = np.logical_and.reduce([c == c[-1] for c in last])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
        left, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if left:
        yield pa.Table.from_batches(left).combine_chunks()


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n rows reaches over the links (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
    return root


def spanning_pairs(n: int, i: np.ndarray, j: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which of the links (i, j) of n rows join all that all of them join, those of least cost first."""
    root, picked = np.arange(n), [np.zeros(0, np.int64)]
    for c in np.unique(cost):
        at = np.flatnonzero(cost == c)
        while True:
            a, b = root[i[at]], root[j[at]]
            at = at[a != b]
            if not len(at):
                break
            low, high = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            order = np.lexsort((low, high))
            first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
            picked.append(at[first])
            root[high[first]] = low[first]
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return np.concatenate(picked)


def same_group_pairs(group: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same group (groups stand together), by their distance in the order."""
    at = np.arange(len(group))
    for d in range(1, longest):
        at = at[at < len(group) - d]
        at = at[group[at] == group[at + d]]
        if not len(at):
            return
        yield at, at + d


def dealt_blocks(rows: DataFrame, key: str, ident: str, most: int) -> DataFrame:
    """Rows whose key others have too, with `lo`, `hi`, `part`: a key with over `most` rows is dealt into parts, and each
    pair of parts gets a block (key, lo, hi) of its own, so no task needs to hold an unbounded group.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / most).cast("int")
    return (
        rows.join(counts, key)
        .withColumn("part", F.pmod(F.xxhash64(ident), parts).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumns({"lo": F.least("part", "_other"), "hi": F.greatest("part", "_other")})
        .drop("_n", "_other")
    )


def marked(rows: DataFrame, keys: DataFrame, key: str, out: str) -> DataFrame:
    """rows with `out`, which is false only where the key, a 64-bit hash, is not among `keys`, and seldom true there: what is
    false needs no join with them. Each key marks a place. There are eight or more for each, MARKS at most, so the
    table of places is bounded; where it is full, `out` is true.
    """
    places = min(MARKS, max(64, 1 << (8 * keys.count()).bit_length()))
    own, bit = F.pmod(F.col(key), F.lit(places)), F.expr("shiftleft(1L, cast(_place & 63 as int))")
    words = keys.select(own.alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    found = rows.withColumn("_place", own).join(F.broadcast(words), F.shiftright("_place", 6) == F.col("_word"), "left")
    is_set = F.getbit("_bits", F.col("_place").bitwiseAND(63).cast("int")) == 1
    return found.withColumn(out, F.coalesce(is_set, F.lit(False))).drop("_place", "_word", "_bits")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the links (a, b), the smallest node that it reaches.

    Alternating large and small stars: each round is two groupings with partial sums and two joins; the number of rounds
    grows as the logarithm of a component's size. Self-links and null ends are ignored; no links give an empty table.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = saved(e, "links"), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = saved(small, "links")


def running_sums(rows: DataFrame, group: list[str], order: list[str], value: str, bins: int, out: str) -> DataFrame:
    """Adds `out`, the sum of `value` up to and with each row of its group, in the order given.

    The first column of `order` must be a 32-hex-digit hash. Its leading digits deal each group into bins; the sums of
    the bins are few and are added up first, so that even one group with most rows is summed by many tasks.
    """
    from pyspark.sql import Window as W

    digits = max(1, min(8, -(-(bins - 1).bit_length() // 4)))
    rows = rows.withColumn("_bin", F.substring(order[0], 1, digits))
    sums = rows.groupBy(*group, "_bin").agg(F.sum(value).alias("_sum"))
    before = sums.select(*group, "_bin", (F.sum("_sum").over(W.partitionBy(*group).orderBy("_bin")) - F.col("_sum")).alias("_before"))
    joined = rows.alias("r").join(before.alias("b"), [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_bin"]]).select("r.*", "b._before")
    own = F.sum(value).over(W.partitionBy(*group, "_bin").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return joined.withColumn(out, F.col("_before") + own).drop("_bin", "_before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
