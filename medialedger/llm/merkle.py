"""A manifest of a dataset as Merkle trees, kept as logs in postorder.

Each row is a leaf; the leaves of a group, in order, make a tree of eight children a node; the groups' roots make another. All
leaves of a tree have the same depth, and only the last node of a level can be incomplete, so a tree's shape follows from its
number of leaves: where a node stands in postorder, and where its siblings do, has a closed form.

Builders are aligned: each has BUILD leaves from a multiple of BUILD on, which are whole subtrees, and appends its nodes as they
are completed, children before their parent. The builders' roots are the leaves of the next tier, and so on up to one root, so
no task holds more than BUILD leaves, whatever a group's size. Proofs are taken from the logs from the top down: a builder's
log is joined with the way up from its root, its own siblings are addressed by their positions, and each leaf gets its proof.
Leaves are numbered in ranges of their order, counted and summed, so a group with most rows is dealt to many tasks.

Defined cases: a null value is written `-`; rows with equal ids are leaves each, in the order of their digests; ids that are null
come first; a null group is a group of its own and the first; an empty table has no tree; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CRC32_SQL, LOWER, UPPER, saved, table

FAN = 8
#: Levels of a builder, and its leaves.
LEVELS = 3
BUILD = FAN**LEVELS
#: Characters of a digest.
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sizes_of(leaves: int, levels: int) -> list[int]:
    """Nodes of each level, from the leaves up."""
    out = [leaves]
    for _ in range(levels):
        out.append(-(-out[-1] // FAN))
    return out


def height(leaves: int) -> int:
    h = 0
    while FAN**h < leaves:
        h += 1
    return h


def position(level: int, index: np.ndarray, leaves: int, levels: int) -> np.ndarray:
    """Where node `index` of a level stands in postorder: what is complete before its subtree begins, and its subtree."""
    first = index * FAN**level
    end = np.minimum(first + FAN**level, leaves)
    at = np.full(len(index), -1, np.int64)
    for m in range(levels + 1):
        at += -(-end // FAN**m) if m <= level else first // FAN**m
    return at


def joined_hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def appended(leaves: list[str], levels: int) -> list[str]:
    """The log of a builder: digests in the order in which nodes are completed."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(levels + 1)]

    def complete(level: int, digest: str) -> None:
        log.append(digest)
        open_[level].append(digest)
        if level < levels and len(open_[level]) == FAN:
            close(level)

    def close(level: int) -> None:
        children, open_[level] = open_[level], []
        complete(level + 1, joined_hash(children))

    for leaf in leaves:
        complete(0, leaf)
    for level in range(levels):
        if open_[level]:
            close(level)
    return log


def ways(log: list[str], leaves: int, levels: int) -> list[list[tuple[str, str]]]:
    """For each leaf, the joined digests of its siblings to the left and to the right, level by level."""
    sizes = sizes_of(leaves, levels)
    sides: list[list[tuple[str, str]]] = []
    for level in range(levels):
        at = position(level, np.arange(sizes[level]), leaves, levels).tolist()
        runs = ["".join(log[a] for a in at[k : k + FAN]) for k in range(0, len(at), FAN)]
        sides.append([(runs[j // FAN][: WIDTH * (j % FAN)], runs[j // FAN][WIDTH * (j % FAN + 1) :]) for j in range(sizes[level])])
    return [[sides[level][i // FAN**level] for level in range(levels)] for i in range(leaves)]


def digests_of(log: str) -> list[str]:
    return [log[k : k + WIDTH] for k in range(0, len(log), WIDTH)]


def value(column: Column) -> Column:
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(value, columns)).cast("binary"), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with `idx`, their number from 0 within their group in the given order (nulls first). Ranges of the order are counted,
    and their counts summed: a row for each range and group.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    id_ = F.monotonically_increasing_id()
    ranged = saved(ranged.withColumns({"_range": F.shiftright(id_, 33).cast("int"), "_at": id_}), "ranged")
    counts = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_range")) - F.col("_n")
    counts = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), (before - F.col("_first")).alias("_shift"))
    out = ranged.join(counts, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return out.withColumn("idx", F.col("_at") + F.col("_shift")).select(*rows.columns, "idx")


def built(nodes: DataFrame, tier: int) -> DataFrame:
    """(grp, total, n, tier, block, levels, log, rows): one row for each builder over nodes (grp, idx, digest, total, n, row), where
    total counts the group's leaves, n its nodes in this tier, and `row` goes along. A log's last digest is the builder's root.
    """
    rows = F.array_sort(F.collect_list(F.struct("idx", "digest", "row")))  # at most BUILD
    by = F.floor(F.col("idx") / BUILD).cast("long")
    blocks = nodes.withColumn("block", by).groupBy("grp", "block").agg(F.max("total").alias("total"), F.max("n").alias("n"), rows.alias("rows"))
    blocks = blocks.select("grp", "total", "n", F.lit(tier).alias("tier"), "block", "rows")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels, logs = [], []
            digests, at = batch.column("rows").flatten().field("digest").to_pylist(), 0
            for n, size in zip(batch.column("n").to_pylist(), pc.list_value_length(batch.column("rows")).to_pylist(), strict=True):
                levels.append(LEVELS if n > BUILD else height(n))
                logs.append("".join(appended(digests[at : at + size], levels[-1])))
                at += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(levels, pa.int32()), pa.array(logs, pa.string())], [*batch.schema.names, "levels", "log"])

    more = [T.StructField("levels", T.IntegerType()), T.StructField("log", T.StringType())]
    return blocks.mapInArrow(go, T.StructType([*blocks.schema.fields, *more]))


def trees(leaves: DataFrame) -> list[DataFrame]:
    """The builders of each tier over leaves (grp, idx, digest, row). A group whose nodes fit into one builder ends there."""
    counts = leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("total"))
    most = counts.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
    nodes = leaves.alias("l").join(counts.alias("c"), F.col("l.grp").eqNullSafe(F.col("c.grp"))).select("l.*", "c.total", F.col("c.total").alias("n"))
    tiers = [saved(built(nodes, 0), "log")]
    while most > BUILD:
        most = -(-most // BUILD)
        root = F.substring("log", F.length("log") - WIDTH + 1, F.lit(WIDTH))
        up = F.ceil(F.col("n") / BUILD).cast("long")
        nodes = tiers[-1].where(F.col("n") > BUILD).select("grp", F.col("block").alias("idx"), root.alias("digest"), "total", up.alias("n"), F.lit(0).alias("row"))
        tiers.append(saved(built(nodes, len(tiers)), "log"))
    return tiers


def subroots(tiers: list[DataFrame]) -> DataFrame:
    """(grp, digest): the root of each group."""
    root = F.substring("log", F.length("log") - WIDTH + 1, F.lit(WIDTH)).alias("digest")
    tops = [t.where(F.col("n") <= BUILD).select("grp", root) for t in tiers]
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return out


def postorder(tiers: list[DataFrame]) -> DataFrame:
    """(grp, position, level, digest): the whole log of each group, in which every node follows those below it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, b in enumerate(batch.select(["total", "tier", "block", "levels", "log"]).to_pylist()):
                log, whole = np.array(digests_of(b["log"]), object), height(b["total"])
                n = 1
                while sum(sizes_of(n, b["levels"])) < len(log):
                    n += 1
                for level in range(1 if b["tier"] else 0, b["levels"] + 1):  # a tier's leaves are the roots of the one below
                    index = np.arange(sizes_of(n, level)[level])
                    up = b["tier"] * LEVELS + level
                    at = position(up, b["block"] * FAN ** (LEVELS - level) + index, b["total"], whole)
                    grp = batch.column("grp").slice(k, 1).take(pa.array(np.zeros(len(at), np.int32)))
                    digest = log[position(level, index, n, b["levels"])]
                    yield pa.RecordBatch.from_arrays([grp, pa.array(at), pa.array(np.full(len(at), up, np.int32)), pa.array(digest, pa.string())], ["grp", "position", "level", "digest"])

    logs = tiers[0].drop("rows")
    for t in tiers[1:]:
        logs = logs.unionByName(t.drop("rows"))
    kind = logs.schema["grp"].dataType.simpleString()
    return logs.select("grp", "total", "tier", "block", "levels", "log").mapInArrow(go, f"grp {kind}, position long, level int, digest string")


WAY = "array<struct<left:string,right:string>>"


def led(builders: DataFrame) -> DataFrame:
    """(grp, subroot, root, idx, digest, row, way) for each leaf of builders that have the way from their root: `way` has the
    joined digests of a node's siblings to its left and right, level by level up to the root of all.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                rows = one.column("rows").flatten()
                n = len(rows)
                own = ways(digests_of(one.column("log")[0].as_py()), n, one.column("levels")[0].as_py())
                above = [(w["left"], w["right"]) for w in one.column("way")[0].as_py()]
                sides = [s for w in own for s in [*w, *above]]
                flat = pa.StructArray.from_arrays([pa.array([s[0] for s in sides], pa.string()), pa.array([s[1] for s in sides], pa.string())], ["left", "right"])
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * (len(sides) // n))
                again = pa.array(np.zeros(n, np.int32))
                same = [one.column(c).take(again) for c in ("grp", "subroot", "root")]
                yield pa.RecordBatch.from_arrays([*same, *(rows.field(c) for c in ("idx", "digest", "row")), pa.ListArray.from_arrays(ends, flat)], names)

    names = ["grp", "subroot", "root", "idx", "digest", "row", "way"]
    kinds = {c: builders.schema[c].dataType.simpleString() for c in ("grp", "rows")}
    row = builders.schema["rows"].dataType.elementType["row"].dataType.simpleString()
    return builders.select("grp", "levels", "log", "rows", "subroot", "root", "way").mapInArrow(go, f"grp {kinds['grp']}, subroot string, root string, idx long, digest string, row {row}, way {WAY}")


def proved(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """(grp, subroot, root, idx, digest, row, way) for each leaf. above: (grp, subroot, root, way) from each group's root."""
    found = None
    for t in reversed(tiers):
        here = t.where(F.col("n") <= BUILD).alias("b").join(above.alias("a"), F.col("b.grp").eqNullSafe(F.col("a.grp"))).select("b.*", "a.subroot", "a.root", "a.way")
        if found is not None:
            up = found.select("grp", F.col("idx").alias("block"), "subroot", "root", "way")
            same = F.col("b.grp").eqNullSafe(F.col("u.grp")) & (F.col("b.block") == F.col("u.block"))
            here = here.unionByName(t.where(F.col("n") > BUILD).alias("b").join(up.alias("u"), same).select("b.*", "u.subroot", "u.root", "u.way"))
        found = led(here)
    return found


def manifest(leaves: DataFrame, *order: str) -> tuple[DataFrame, list[DataFrame]]:
    """The proof of each leaf, and the builders, from leaves (grp, digest, row) that are to ascend by `order` in their group.

    The proof: (grp, subroot, root, idx, digest, row, way), with one way through the group's tree and that of the groups' roots.
    """
    # written before it is dealt: finding the ranges would make every digest once more
    tiers = trees(numbered(saved(leaves, "leaves"), "grp", *order).select("grp", "idx", "digest", "row"))
    tops = subroots(tiers).select(F.lit(0).alias("all"), F.col("digest"), F.struct("grp").alias("row"))
    tops = numbered(tops.withColumn("_k", F.col("row.grp")), "all", "_k").select(F.col("all").alias("grp"), "idx", "digest", "row")
    top = trees(tops)
    nothing = subroots(top).select("grp", F.lit("").alias("subroot"), F.col("digest").alias("root"), F.array().cast(WAY).alias("way"))
    above = proved(top, nothing).select("row.grp", F.col("digest").alias("subroot"), "root", "way")
    return proved(tiers, saved(above, "subroots")), tiers


def folded(digest: Column, way: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(way, digest, lambda up, w: F.sha2(F.concat(w["left"], up, w["right"]).cast("binary"), 256))


def siblings_hash(way: Column) -> Column:
    return F.sha2(F.array_join(F.transform(way, lambda w: F.concat(w["left"], w["right"])), "").cast("binary"), 256)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    digest, low = leaf([*fields, F.col("text")]), leaf([*fields, F.translate("text", UPPER, LOWER)])
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, low)
    # the salt only deals rows that are equal throughout to several ranges
    salt = F.xxhash64(F.monotonically_increasing_id())
    leaves = docs.select(F.col("lang").cast("string").alias("grp"), digest.alias("digest"), F.struct("doc_id", changed.alias("changed")).alias("row"), "doc_id", salt.alias("_salt"))
    proofs, _ = manifest(leaves, "doc_id", "digest", "_salt")
    out = proofs.withColumn("folded_root", folded(F.coalesce("row.changed", "digest"), F.col("way")))
    return out.select("row.doc_id", F.col("digest").alias("leaf"), "subroot", "root", siblings_hash(F.col("way")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _value_sql(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


OP12_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
         sha256({" || ".join(map(_value_sql, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
         sha256({" || ".join(map(_value_sql, ("doc_id", "source", "lang", "n_chars", f"translate(text, '{UPPER}', '{LOWER}')")))}) AS low,
         coalesce({CRC32_SQL.format("doc_id")} % 3 = 0, false) AS changed
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx FROM docs),
tree AS (
  SELECT g, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT g, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM tree WHERE n > 1 GROUP BY g, level, idx // 8, n),
subs AS (SELECT g, h AS subroot, level FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, g AS idx, subroot AS h, (SELECT count(*) FROM subs) AS n FROM subs
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY level, idx // 8, n),
sides AS (
  SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY g, level, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (PARTITION BY g, level, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT g, level, idx, h FROM tree WHERE n > 1 UNION ALL SELECT -1, level, idx, h FROM top WHERE n > 1)),
climb AS (
  SELECT rid, g, idx, 0 AS level, CASE WHEN changed THEN low ELSE leaf END AS cur, '' AS proof FROM leaves
  UNION ALL
  SELECT c.rid, c.g, c.idx // 8, c.level + 1, sha256(s.l || c.cur || s.r), c.proof || s.l || s.r
  FROM climb c JOIN sides s ON s.g = c.g AND s.level = c.level AND s.idx = c.idx),
over AS (
  SELECT c.rid, c.g AS idx, 0 AS level, c.cur, c.proof FROM climb c JOIN subs s ON s.g = c.g AND s.level = c.level
  UNION ALL
  SELECT o.rid, o.idx // 8, o.level + 1, sha256(s.l || o.cur || s.r), o.proof || s.l || s.r
  FROM over o JOIN sides s ON s.g = -1 AND s.level = o.level AND s.idx = o.idx),
done AS (SELECT rid, arg_max(cur, level) AS folded_root, arg_max(proof, level) AS proof FROM over GROUP BY rid)
SELECT d.doc_id, d.leaf, s.subroot, t.h AS root, sha256(x.proof) AS proof_sha256, x.folded_root, x.folded_root = t.h AS verified
FROM docs d JOIN subs s ON s.g = d.g JOIN done x ON x.rid = d.rid CROSS JOIN (SELECT h FROM top WHERE n = 1) t
"""
