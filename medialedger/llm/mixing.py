"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id. A source may be passed more than once; each copy of a document
finishes at the virtual time at which its source has sent it: the words of the source up to and with it, divided by the
source's target. The copies of all sources, sorted by finish time, are taken until the budget is spent; the copy at the
edge is taken in part. All sources then come to their targets together.

Every running sum is dealt by ranges of the sort key: the ranges' sums are few and summed first, then each range adds up its
own rows. So neither a source with most documents nor the global order needs one task.

Defined cases: a null source is a source of its own and the last; a null or blank text has size 0 and takes nothing; an
empty table gives an empty result; rows with equal ids are ordered by their size and count each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import running_sums, saved, table

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Ranges of finish time in which words are counted, for the one range at the budget's edge.
TIME_BINS = 1 << 16
#: Ranges into which each source's shuffled documents are dealt.
SOURCE_BINS = 256


def size_of(text: Column) -> Column:
    """Words between ASCII white space."""
    clean = F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))
    return F.when(text.isNull() | (clean == ""), 0).otherwise(F.size(F.split(clean, " "))).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Water filling in one pass: in the order of most * size / weight, sources at the front stop at their most, and the rest
    share what is left by weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, map(float, weights)))
    s = sizes.withColumn("w", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1))
    up = W.orderBy((F.col("source_size") * most / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = up.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    s = s.withColumns({"budget": F.lit(float(share)) * F.sum("source_size").over(everything), "capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * float(most), "w_left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    s = s.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("w_left"))
    s = s.withColumn("full", F.col("level") * F.col("w") > F.col("source_size") * float(most))
    cap = F.col("source_size") * float(most) / F.col("w")
    s = s.withColumn("open_level", F.min_by("level", F.when(~F.col("full"), cap)).over(everything))
    return s.select("source", "source_size", F.when(F.col("full"), F.col("source_size") * float(most)).otherwise(F.col("w") * F.coalesce("open_level", F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs.

    weights go to the sources in code point order, repeating; the mix has share times all words, a source at most `most`
    times its own, and a document at most that often.
    """
    own = docs.select("doc_id", F.col("source").cast("string"), size_of(F.col("text").cast("string")).alias("size"))
    own = own.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    own = saved(own, "sizes")
    sizes = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    target = saved(targets(sizes, weights, share, most), "targets")
    queued = running_sums(own, ["source"], ["_h", "doc_id", "size"], "size", SOURCE_BINS, "sent")
    queued = queued.alias("q").join(target.alias("t"), F.col("q.source").eqNullSafe(F.col("t.source"))).select("q.*", "t.source_size", "t.target")
    queued = queued.where("target > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    queued = queued.withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("sent")) / F.col("target"))
    # by time 1 and one more document of each source all targets are sent, so nothing that finishes later is taken
    longest = own.groupBy("source").agg(F.max("size").alias("longest")).alias("l").join(target.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source")))
    end = 1.0 + float(longest.where("target > 0").agg(F.coalesce(F.max(F.col("longest") / F.col("target")), F.lit(0.0))).first()[0]) + 1e-6
    queued = queued.where(F.col("finish") <= end).withColumn("bin", F.floor(F.col("finish") / end * TIME_BINS).cast("int"))
    queued = saved(queued.select("doc_id", "_h", "source", "size", "pass", "finish", "bin"), "queue")
    bins = queued.groupBy("bin").agg(F.sum("size").alias("words"))
    bins = bins.withColumn("before", F.sum("words").over(W.orderBy("bin")) - F.col("words"))
    budget = target.agg(F.coalesce(F.floor(F.sum("target") + 1e-6), F.lit(0)).cast("long")).first()[0]
    bins = saved(bins.withColumn("budget", F.lit(budget).cast("long")), "time-bins")
    edge = queued.join(bins.where("before < budget and before + words > budget"), "bin")
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("_h"), F.col("doc_id"), F.col("pass")]
    upto = F.col("before") + F.sum("size").over(W.partitionBy("bin").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    cut = edge.withColumn("upto", upto).select("doc_id", "_h", "source", "size", F.greatest(F.lit(0), F.least("size", F.col("budget") - F.col("upto") + F.col("size"))).cast("long").alias("words"))
    whole = queued.join(bins.where("before + words <= budget").select("bin"), "bin").select("doc_id", "_h", "source", "size", F.col("size").alias("words"))
    taken = whole.unionByName(cut).where("words > 0").groupBy("doc_id", "_h", "source", "size").agg(F.sum("words").alias("words"))
    # rows that are equal throughout share what their copies take
    same = own.groupBy("doc_id", "_h", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    keys = ["_h", "doc_id", "source", "size"]
    match = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys]
    per = same.alias("s").join(taken.alias("t"), match("s", "t"), "left").join(target.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.*", F.coalesce("t.words", F.lit(0)).alias("words"), "g.source_size", "g.target")
    nth = F.explode(F.sequence(F.lit(0), F.col("rows") - 1))
    share_of = F.floor(F.col("words") / F.col("rows")) + F.when(F.col("nth") < F.col("words") % F.col("rows"), 1).otherwise(0)
    return per.withColumn("nth", nth).select("doc_id", "source", "size", "source_size", "target", share_of.cast("long").alias("taken"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH own AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w
  FROM own GROUP BY source),
l AS (
  SELECT *, source_size * 2.0 / w AS k, 1.5 * sum(source_size) OVER () AS budget,
         coalesce(sum(source_size) OVER o, 0) * 2.0 AS capped,
         sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left
  FROM s WINDOW o AS (ORDER BY source_size * 2.0 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CAST((budget - capped) / w_left AS DOUBLE) AS lev FROM l),
o AS (SELECT arg_min(lev, k) AS open_level FROM f WHERE NOT (lev * w > source_size * 2.0)),
t AS (
  SELECT source, source_size,
         CAST(CASE WHEN lev * w > source_size * 2.0 THEN source_size * 2.0 ELSE w * coalesce(open_level, 0) END AS DOUBLE) AS target
  FROM f, o),
q AS (
  SELECT own.*, source_size, target, pass,
         (pass * source_size + sum(size) OVER (PARTITION BY own.source, pass ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)) / target AS finish
  FROM own JOIN t ON own.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) AS p(pass) WHERE target > 0),
r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, h, doc_id, pass ROWS UNBOUNDED PRECEDING) AS upto,
         (SELECT floor(sum(target) + 1e-6) FROM t) AS budget FROM q)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(sum(greatest(0, least(size, budget - upto + size))) AS BIGINT) AS taken
FROM r GROUP BY ALL
"""
