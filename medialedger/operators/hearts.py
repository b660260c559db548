"""Hearts: validated requests, a rolling limit for each voter, current state, counts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions.paths import voter_hash

#: Steps of time in a window, in which gaps are looked for.
STEPS = 8
PHOTO_ID, TOKEN = "^[0-9a-f]{16}$", "^[A-Za-z0-9-]{16,64}$"


def validate(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """reject_reason in the order of the checks, or NULL."""
    known = allowed.select("photo_id").distinct().withColumn("_known", F.lit(True))
    out = requests.join(known, "photo_id", "left")
    bad = lambda c, p: ~F.coalesce(F.col(c).rlike(p), F.lit(False))
    reason = F.when(bad("photo_id", PHOTO_ID), "malformed photo_id").when(bad("token", TOKEN), "missing token").when(F.col("_known").isNull(), "unknown photo_id")
    return out.withColumn("reject_reason", reason).drop("_known")


def known_only(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    return requests.join(allowed.select("photo_id").distinct(), "photo_id", "left_semi")


def with_voters(requests: DataFrame, salt: str) -> DataFrame:
    """The token becomes a salted hash and is dropped."""
    return requests.withColumn("voter", voter_hash(F.col("token"), salt)).drop("token")


def accept_in_order(times: list[int], limit: int, window: int, state: deque[int]) -> list[bool]:
    """Which writes are accepted, given those accepted before: fewer than limit within the window; rejected ones don't count."""
    out = []
    for t in times:
        while state and state[0] < t - window:
            state.popleft()
        ok = len(state) < limit
        if ok:
            state.append(t)
        out.append(ok)
    return out


def limited_seconds(seconds: DataFrame, limit: int, window: int) -> DataFrame:
    """(voter, ts, most) from (voter, ts, n): how many of the n writes of a second are accepted.

    A voter's seconds are cut where nothing was written for longer than the window, as nothing before counts there; each piece is
    decided on its own. Such gaps are found in steps of time, of which a voter has no more for writing more.
    """
    step = max(1, window // STEPS)
    seconds = seconds.withColumn("_step", F.floor(F.col("ts") / step))
    order = W.partitionBy("voter").orderBy("_step")
    free = (F.col("_step") - F.lag("_step").over(order) - 1) * step
    begins = F.coalesce(free >= window, F.lit(False)).cast("int")
    pieces = seconds.select("voter", "_step").distinct().withColumn("_begins", begins).withColumn("_piece", F.sum("_begins").over(order))
    same = F.col("s.voter").eqNullSafe(F.col("p.voter")) & (F.col("s._step") == F.col("p._step"))
    cut = seconds.alias("s").join(pieces.alias("p"), same).select("s.voter", "p._piece", "s.ts", "s.n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, state = None, deque()
        for b in batches:
            most = []
            for voter, piece, t, n in zip(b["voter"], b["_piece"], b["ts"], b["n"], strict=True):
                if before != (voter, piece):
                    before, state = (voter, piece), deque()
                while state and state[0] < t - window:
                    state.popleft()
                most.append(min(n, limit - len(state)))
                state.extend([t] * most[-1])
            yield b[["voter", "ts"]].assign(most=most)

    kinds = ", ".join(f"{c} {seconds.schema[c].dataType.simpleString()}" for c in ("voter", "ts"))
    return cut.repartition("voter", "_piece").sortWithinPartitions("voter", "_piece", "ts").mapInPandas(run, f"{kinds}, most long")


def rate_limit(requests: DataFrame, config: Config) -> DataFrame:
    """requests (voter, ts, seq ...) with `accepted`: fewer than the limit accepted within the window before; ties by seq.

    Acceptance depends on earlier acceptances, but only on how many there were in each second: these are decided first, from
    counts, and the first writes of each second then get what it has. So a voter with most of the writes is dealt to many
    tasks. A write without a time is never accepted.
    """
    seconds = requests.where("ts is not null").groupBy("voter", "ts").agg(F.count(F.lit(1)).alias("n"))
    most = limited_seconds(seconds, config.heart_limit, config.heart_window)
    both = requests.unionByName(most.withColumnRenamed("most", "_most"), allowMissingColumns=True)
    # the row of a second's decision comes first, then its writes in order
    order = W.partitionBy("voter", "ts").orderBy(F.col("_most").isNull(), "seq")
    nth = F.row_number().over(order) - 1
    ranked = both.withColumns({"_nth": nth, "_of": F.max("_most").over(order.rowsBetween(W.unboundedPreceding, 0))})
    return ranked.where("_most is null").select(*requests.columns, F.coalesce(F.col("_nth") <= F.col("_of"), F.lit(False)).alias("accepted"))


def fold(accepted: DataFrame) -> DataFrame:
    """(photo_id, voter, created_at) of the hearts that stand: the last write of each pair decides, and an unbroken run of
    adds keeps its first time.
    """
    last = accepted.groupBy("photo_id", "voter").agg(F.max_by("action", F.struct("ts", "seq")).alias("action"), F.max(F.when(F.col("action") != "add", F.struct("ts", "seq"))).alias("gone"))
    standing = last.where("action = 'add'").select("photo_id", "voter", "gone")
    adds = accepted.where("action = 'add'").join(standing, ["photo_id", "voter"])
    since = adds.where(F.col("gone").isNull() | (F.struct("ts", "seq") > F.col("gone")))
    return since.groupBy("photo_id", "voter").agg(F.min("ts").alias("created_at"))


def heart_counts(hearts: DataFrame) -> DataFrame:
    return hearts.groupBy("photo_id").agg(F.count(F.lit(1)).alias("hearts"))


def hearts_of(hearts: DataFrame, voter: str) -> DataFrame:
    return hearts.where(F.col("voter") == voter).select("photo_id")


def hearts_with_paths(counts: DataFrame, allowed: DataFrame) -> DataFrame:
    paths = allowed.groupBy("photo_id").agg(F.max("rel_path").alias("rel_path"))
    return counts.join(paths, "photo_id", "left").withColumn("rel_path", F.coalesce("rel_path", F.lit("")))


def top_hearts(counts: DataFrame, allowed: DataFrame, limit: int = 50) -> DataFrame:
    """The most liked, ties by id; 1 to 1000 of them."""
    best = counts.orderBy(F.desc("hearts"), "photo_id").limit(min(1000, max(1, limit)))
    return hearts_with_paths(best, allowed)


def register_photos(allowed: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(allow list with new (photo_id, rel_path, pos), counts of registered, rejected and known).

    Ids that aren't 16 hex digits are rejected; paths are cut to 500; times of known ids stay; the last of equal ids wins.
    """
    good = F.coalesce(F.col("photo_id").rlike(PHOTO_ID), F.lit(False))
    latest = new.where(good).groupBy("photo_id").agg(F.max_by(F.substring("rel_path", 1, 500), "pos").alias("_path"))
    both = allowed.join(latest, "photo_id", "full").select("photo_id", F.coalesce("_path", "rel_path").alias("rel_path"), F.coalesce("added_at", F.lit(now).cast("long")).alias("added_at"))
    counts = new.agg(F.count_if(good).alias("registered"), F.count_if(~good).alias("rejected")).withColumn("_k", F.lit(1)).join(both.agg(F.count(F.lit(1)).alias("known")).withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both, counts
