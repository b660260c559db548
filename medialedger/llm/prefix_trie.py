"""The prefix trie of conversations, by collapsing whole sequences.

Conversations are rebuilt (their first turns come from the first conversation of their block of ids) and read as chains of
digests: the digest of the first d turns is that of the first d - 1 and of turn d. Conversations with the same last digest are one
weighted sequence with a list of those that end there; one of them stands for all. A sequence whose digest stands within
another is a proper prefix of it, and an anti-join leaves the leaves. Every node lies on the path of a leaf, so sums over subtrees
are sums over sequences: a sequence gives each of its prefixes its weight times the words from there on, and a leaf takes off
the words of the nodes that it owns, as the smallest leaf below them, which are the end of its path. The work is in proportion to
the turns of distinct sequences, however deep the trie is; no text is shuffled, only digests.

A node that many sequences share is grouped with partial sums; such nodes come to the leaves' rows by broadcast (each holds more
than one part in HOT_SHARE of the rows, so they are fewer than HOT_SHARE), others by a shuffle. A list of ends is put together in
runs by many tasks, and hashed from runs as a stream. A conversation's turns are chained as a stream by one task.

Defined cases: rows without a conv_id belong to no conversation and are left out; of turns with the same number the smaller
role comes first, then the smaller digest; null roles and texts are empty; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CRC32_SQL, saved, table
from .mixing import size_of

#: Conversations of a block of ids, and the number of turns they can take from its first.
BLOCK, HEADS = 20, 4
HOT_SHARE = 1000
#: Ends of a node that make one run.
RUN = 4096
ROOT = hashlib.sha256(b"").digest()[:16]


def head_turns(conv_id: Column) -> Column:
    """How many turns come from the block's first conversation."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def positions(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, digest, words): turns in order, from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    # the role's length tells role and text apart
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    turns = turns.withColumns({"digest": digest, "words": size_of(F.col("text"))})
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return turns.withColumn("pos", F.row_number().over(order))


def rebuilt(turns: DataFrame, *columns: str) -> DataFrame:
    """(conv_id, part, pos, columns) from `positions`: part 0 comes from the block's first conversation, part 1 is a conversation's
    own; part -1 is one row without values for each conversation, also for those that have no turn left.
    """
    h = head_turns(F.col("conv_id"))
    ids = turns.where("pos = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    heads = turns.where((F.col("pos") < HEADS) & (F.col("conv_id") % BLOCK == 0)).select(F.col("conv_id").alias("base"), "pos", *columns)
    given = ids.join(heads, "base").where("pos <= h").select("conv_id", F.lit(0).alias("part"), "pos", *columns)
    own = turns.where(F.col("pos") > h).select("conv_id", F.lit(1).alias("part"), "pos", *columns)
    start = ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("pos"), *(F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in columns))
    return start.unionByName(given).unionByName(own)


def chained(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node, words, upto, ends) for each prefix of each conversation: its digest, the words of its last turn and of
    all its turns, and whether the conversation ends there.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "depth", "node", "words", "upto", "ends"]
        held: tuple | None = None
        for batch in batches:
            ids, parts, digests, words = (batch.column(c).to_pylist() for c in ("conv_id", "part", "digest", "words"))
            out = []
            for c, part, digest, n in zip(ids, parts, digests, words, strict=True):
                if held is not None:
                    out.append((*held, part < 0))
                if part < 0:
                    held = (c, 0, ROOT, 0, 0)
                else:
                    held = (c, held[1] + 1, hashlib.sha256(held[2] + digest).digest()[:16], n, held[4] + n)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*held, True)], names)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos").select("conv_id", "part", "digest", "words")
    return ordered.mapInArrow(go, "conv_id long, depth long, node binary, words long, upto long, ends boolean")


def ends_of(steps: DataFrame) -> DataFrame:
    """(node, ends_sha256): the hash of the comma-joined ids of the conversations that end at a node, in ascending order."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()
            at = [k for k in range(len(node)) if not k or node[k] != node[k - 1] or k % RUN == 0]
            text = [",".join(map(str, ids[a:z])) for a, z in zip(at, [*at[1:], len(node)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([node[k] for k in at], pa.binary()), pa.array([ids[k] for k in at], pa.int64()), pa.array(text, pa.string())], ["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state = None, None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node == before:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    done.append((before, state.hexdigest()))
                before, state = node, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([before]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    ends = steps.where("ends").select("node", "conv_id")
    joined = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(runs, "node binary, first long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(hashed, "node binary, ends_sha256 string")


def sequences(steps: DataFrame) -> DataFrame:
    """(conv_id, node, weight, total, leaf): the distinct whole sequences, with the smallest conversation that is one, how many are, its
    words, and whether no other goes on from it.
    """
    whole = steps.where("ends").groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.max("upto").alias("total"))
    whole = saved(whole, "sequences")
    inner = saved(steps.where("not ends").select("node").distinct(), "inner-nodes")
    leaves = whole.join(inner, "node", "left_anti").withColumn("leaf", F.lit(True))
    return leaves.unionByName(whole.join(inner, "node", "left_semi").withColumn("leaf", F.lit(False)))


def with_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with the columns of their node. Nodes that over one in HOT_SHARE of the rows have are broadcast: `n_leaves` counts rows."""
    total = nodes.agg(F.coalesce(F.sum("n_leaves"), F.lit(0))).first()[0]
    hot = nodes.where(F.col("n_leaves") * HOT_SHARE > total)
    few = rows.join(F.broadcast(hot), "node")
    rest = rows.join(F.broadcast(hot.select("node")), "node", "left_anti")
    return few.unionByName(rest.join(nodes.where(F.col("n_leaves") * HOT_SHARE <= total), "node"))


def trie(rows: DataFrame) -> DataFrame:
    """One row for each node, from rebuilt turns with digest and words: node (the digest of its turns), conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    steps = saved(chained(rows), "steps")
    whole = sequences(steps).select("conv_id", "weight", "total", "leaf")
    paths = saved(steps.join(whole, "conv_id").select("conv_id", "depth", "node", "words", "upto", "weight", "total", "leaf"), "paths")
    nodes = paths.groupBy("node").agg(
        F.min("conv_id").alias("first_conv"),
        F.sum("weight").alias("n_convs"),
        F.sum(F.col("weight") * (F.col("total") - F.col("upto") + F.col("words"))).alias("with_copies"),
        F.count_if("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf"), F.col("conv_id"))).alias("owner"),
    )
    along = with_nodes(paths.where("leaf").select("conv_id", "depth", "node", "words"), saved(nodes, "nodes"))
    up = W.partitionBy("conv_id").orderBy(F.col("depth").desc())
    along = along.withColumn("owned", F.col("owner") == F.col("conv_id"))
    along = along.withColumns({
        "parent": F.lead("first_conv").over(up),
        "child": F.lag("owned", 1, False).over(up),
        "own_words": F.sum(F.when(F.col("owned"), F.col("words")).otherwise(0)).over(up.rowsBetween(W.unboundedPreceding, 0)),
    })
    made = along.groupBy("node").agg(
        F.min("first_conv").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("parent").alias("parent_conv_id"),
        F.min("n_convs").alias("n_convs"),
        F.count_if("child").alias("n_children"),
        F.min("n_leaves").alias("n_leaves"),
        (F.min("with_copies") - F.sum("own_words")).alias("saved_tokens"),
    )
    out = made.join(ends_of(steps), "node", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """nodes with the role and text of their last turn (null at the root): each text once, for training on shared prefixes."""
    turns = rebuilt(positions(conversations), "role", "text").where("part >= 0")
    depth = F.row_number().over(W.partitionBy("conv_id").orderBy("part", "pos")).cast("long")
    return nodes.join(turns.select("conv_id", depth.alias("depth"), "role", "text"), ["conv_id", "depth"], "left")


def op11_conversation_trie(spark, sf_dir: str) -> DataFrame:
    out = trie(rebuilt(positions(table(spark, sf_dir, "conversations")), "digest", "words"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP11_SQL = rf"""
WITH own AS (
  SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS pos
  FROM (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role,
               sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32_SQL.format("conv_id")} % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT i.conv_id, 0 AS part, o.pos, o.digest, o.words FROM ids i JOIN own o ON o.conv_id = i.base AND o.pos <= i.h
  UNION ALL
  SELECT i.conv_id, 1, o.pos, o.digest, o.words FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.pos > i.h),
lists AS (
  SELECT i.conv_id, coalesce(list(t.digest ORDER BY part, pos) FILTER (t.pos IS NOT NULL), []) AS ds,
         coalesce(list(t.words ORDER BY part, pos) FILTER (t.pos IS NOT NULL), []) AS ws
  FROM ids i LEFT JOIN turns t ON t.conv_id = i.conv_id GROUP BY i.conv_id),
prefixes AS (
  SELECT conv_id, d, ds, array_to_string(ds[1:d], ' ') AS node, CASE WHEN d > 0 THEN array_to_string(ds[1:d - 1], ' ') END AS up,
         CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words, d = len(ds) AS ends
  FROM (SELECT *, unnest(range(0, len(ds) + 1)) AS d FROM lists)),
nodes AS (
  SELECT node, any_value(up) AS up, min(conv_id) AS conv_id, any_value(d) AS depth, any_value(words) AS words, count(*) AS n_convs,
         any_value(ds[1:d]) AS ds
  FROM prefixes GROUP BY node),
children AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
above AS (
  SELECT array_to_string(ds[1:k], ' ') AS node, words * (n_convs - 1) AS saved, leaf
  FROM (SELECT n.*, c.node IS NULL AS leaf, unnest(range(0, depth + 1)) AS k FROM nodes n LEFT JOIN children c ON c.node = n.node)),
sums AS (SELECT node, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY node),
ends AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM prefixes WHERE ends GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
       s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.up LEFT JOIN children c ON c.node = n.node JOIN sums s ON s.node = n.node
LEFT JOIN ends e ON e.node = n.node
"""
