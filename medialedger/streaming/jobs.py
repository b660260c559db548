"""Incremental scans and the stream of hearts."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..config import Config
from ..operators.catalog import evolve
from ..operators.hearts import accept_in_order, fold, heart_counts
from ..schema import CATALOG, KEPT_ON_UPSERT

REQUESTS = "photo_id string, voter string, action string, ts long, seq long"
REQUEST_COLUMNS = ["photo_id", "voter", "action", "ts", "seq"]
CHANGES = "photo_id string, change long, run string, batch int"


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """New files as they come."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)


def _table(spark: SparkSession, path: str, empty: str) -> DataFrame:
    """A Parquet table that may not have been written yet."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], empty)


def _next_version(rows: DataFrame) -> int:
    """After the newest version; only names of partitions are read."""
    return int(rows.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]) + 1


def measured_rows(spark: SparkSession, catalog: str) -> DataFrame:
    return _table(spark, catalog, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CATALOG) + ", version long")


def incremental_scan(files: DataFrame, measure: Callable[[DataFrame], DataFrame], catalog: str, checkpoint: str) -> StreamingQuery:
    """Measures only new files and adds them to the catalog as a version of their own; ends when all are in.

    Versions follow the newest one of the catalog, not the stream's batches, so a fresh checkpoint adds to what is there. A
    batch that is run again adds its rows again, which the catalog takes as the same.
    """

    def add(batch: DataFrame, number: int) -> None:
        version = _next_version(measured_rows(batch.sparkSession, catalog))
        measure(batch).write.mode("overwrite").parquet(f"{catalog}/version={version}")  # holds no row yet

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_catalog(spark: SparkSession, catalog: str) -> DataFrame:
    """One row for each path: the newest, but for the names and the extracted file, which stay as first written."""
    rows = measured_rows(spark, catalog)
    kept = [c for c in rows.columns if c in KEPT_ON_UPSERT]
    rest = [c for c in rows.columns if c not in (*kept, "path", "version")]
    both = rows.groupBy("path").agg(F.max_by(F.struct(*rest), "version").alias("new"), F.min_by(F.struct(*kept), "version").alias("old"))
    return evolve(both.select("path", *(f"new.{c}" for c in rest), *(f"old.{c}" for c in kept)))


def compact(spark: SparkSession, catalog: str, into: str) -> None:
    """The current catalog as the only version of a new folder, sorted within files by path."""
    current_catalog(spark, catalog).sortWithinPartitions("path").write.parquet(f"{into}/version=1")


class RateLimiter(StatefulProcessor):
    """Accepts a voter's writes in order of (ts, seq), however they come.

    Writes wait in chunks until the watermark has passed them; no earlier one can come then, and a timer decides all that it has
    passed. Only times and numbers are sorted, chunks are read one by one. The accepted times within the window are a list, one
    entry each; a timer clears it when the window has passed.
    """

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "ts long")
        self.waiting = [handle.getListState(f"waiting{k}", "chunk binary") for k in (0, 1)]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        store = self.waiting[1 if self.waiting[1].exists() else 0]
        for frame in rows:
            if len(frame):
                store.appendValue((packed(frame[REQUEST_COLUMNS]),))
                self.handle.registerTimer(1000 * int(frame["ts"].min()))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        times = deque(t for (t,) in self.times.get()) if self.times.exists() else deque()
        here, there = self.waiting if self.waiting[0].exists() else reversed(self.waiting)
        if here.exists():
            order = [np.zeros((2, 0), np.int64)]
            for (chunk,) in here.get():
                at = unpacked(chunk, ["ts", "seq"])
                order.append(at[:, at[0] <= passed])
            ts, seq = np.concatenate(order, axis=1)
            by_time = np.lexsort((seq, ts))
            accepted = np.zeros(len(ts), bool)
            accepted[by_time] = accept_in_order(ts[by_time].tolist(), self.limit, self.window, times)
            done, least = 0, None
            for (chunk,) in here.get():
                frame = pa.ipc.open_stream(chunk).read_pandas()
                now = frame["ts"] <= passed
                n = int(now.sum())
                if n:
                    yield frame[now].assign(accepted=accepted[done : done + n])
                    done += n
                if n < len(frame):
                    there.appendValue((packed(frame[~now]),))
                    left = int(frame["ts"][~now].min())
                    least = left if least is None else min(least, left)
            here.clear()
            if least is not None:
                self.handle.registerTimer(1000 * least)
        while times and times[0] < passed - self.window:
            times.popleft()
        if times:
            self.times.put([(t,) for t in times])
            self.handle.registerTimer(1000 * (times[-1] + self.window + 1))
        else:
            self.times.clear()

    def close(self) -> None:
        pass


def packed(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(chunk: bytes, columns: list[str]) -> np.ndarray:
    table = pa.ipc.open_stream(chunk).read_all()
    return np.stack([table.column(c).to_numpy() for c in columns])


def limited_stream(requests: DataFrame, config: Config, late: str = "1 minute") -> DataFrame:
    """requests with `accepted`, as `rate_limit` would decide over all of them, once no earlier write can come.

    `late` is how far a write may come behind the newest one; later ones are dropped. Decisions wait for it.
    """
    timed = requests.select(*REQUEST_COLUMNS, F.timestamp_seconds("ts").alias("at")).withWatermark("at", late)
    limiter = RateLimiter(config.heart_limit, config.heart_window)
    return timed.groupBy("voter").transformWithStateInPandas(limiter, f"{REQUESTS}, accepted boolean", "append", "eventTime")


class HeartState(StatefulProcessor):
    """Whether a voter hearts a photo: the write with the latest (ts, seq) decides, in whatever order they come.

    All writes come out again with `change`: on a batch's last one 1 or -1 if the heart came or went with the batch, else 0.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts long, seq long, hearted boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = tuple(self.last.get()) if self.last.exists() else (-(1 << 62), -1, False)
        last, held = before, None
        for frame in rows:
            if not len(frame):
                continue
            i = frame.sort_values(["ts", "seq"]).iloc[-1]
            last = max(last, (int(i["ts"]), int(i["seq"]), i["action"] == "add"))
            if held is not None:
                yield held
            held = frame[REQUEST_COLUMNS].assign(change=0)
        self.last.update(last)
        if held is not None:
            held.iloc[-1, held.columns.get_loc("change")] = int(last[2]) - int(before[2])
            yield held

    def close(self) -> None:
        pass


def heart_changes(accepted: DataFrame) -> DataFrame:
    """accepted writes with `change`, what each adds to its photo's hearts."""
    return accepted.groupBy("photo_id", "voter").transformWithStateInPandas(HeartState(), f"{REQUESTS}, change int", "append", "none")


def _log_folder(path: str, checkpoint: str) -> str:
    """Each checkpoint has a folder of its own, as its batches are numbered from 0."""
    return f"{path}/run=r{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"


def heart_log(requests: DataFrame, config: Config, path: str, checkpoint: str, counts: str | None = None, late: str = "1 minute", roll: int = 100) -> StreamingQuery:
    """Appends accepted writes to a log; with `counts`, also what each batch adds to each photo's hearts.

    A batch is written under its number and overwritten when it is run again, so a replay can't count twice. Only the batch
    itself is read for its changes, never the log. Every `roll` batches, changes are summed once, so that readers of the counts
    have few of them to add.
    """

    def put(batch: DataFrame, number: int) -> None:
        own = f"{_log_folder(path, checkpoint)}/batch={number}"
        batch.write.mode("overwrite").parquet(own)
        if counts is None:
            return
        spark = batch.sparkSession
        changes = spark.read.schema(f"{REQUESTS}, change int").parquet(own).groupBy("photo_id").agg(F.sum("change").cast("long").alias("change"))
        changes.where("change <> 0").write.mode("overwrite").parquet(f"{_log_folder(f'{counts}/changes', checkpoint)}/batch={number}")
        if (number + 1) % roll == 0:
            run = _log_folder("", checkpoint).removeprefix("/run=")
            summed = _changes(spark, counts, number).where(F.col("run") == run).groupBy("photo_id").agg(F.sum("change").alias("change"))
            summed.write.mode("overwrite").parquet(f"{counts}/sums/run={run}/batch={number}")

    accepted = limited_stream(requests, config, late).where("accepted")
    return heart_changes(accepted).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def _changes(spark: SparkSession, counts: str, before: int | None = None) -> DataFrame:
    """(run, batch, photo_id, change): of each run the newest sum, and the changes since; of batches before a number only."""
    sums, changes = (_table(spark, f"{counts}/{t}", CHANGES) for t in ("sums", "changes"))
    if before is not None:
        sums = sums.where(F.col("batch") < before)
    # a row for each run
    newest = {r["run"]: r["batch"] for r in sums.groupBy("run").agg(F.max("batch").alias("batch")).collect()}
    since = F.lit(True)
    for run, batch in newest.items():
        sums = sums.where((F.col("run") != run) | (F.col("batch") == batch))
        since = since & ((F.col("run") != run) | (F.col("batch") > batch))
    return sums.unionByName(changes.where(since))


def logged(spark: SparkSession, path: str) -> DataFrame:
    """The log's writes; what several runs accepted alike counts once."""
    return spark.read.schema(REQUESTS).option("recursiveFileLookup", True).parquet(path).dropDuplicates(["voter", "photo_id", "ts", "seq"])


def counts_from_log(spark: SparkSession, path: str) -> DataFrame:
    """Hearts of all photos, from all that was accepted."""
    return heart_counts(fold(logged(spark, path)))


def running_counts(spark: SparkSession, counts: str) -> DataFrame:
    """(photo_id, hearts): the sum of each photo's changes."""
    return _changes(spark, counts).groupBy("photo_id").agg(F.sum("change").alias("hearts")).where("hearts > 0")


def windowed_hearts(requests: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Accepted adds for each photo and window, with a bound on late ones."""
    timed = requests.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.where("action = 'add'").groupBy(F.window("at", width), "photo_id").agg(F.count(F.lit(1)).alias("adds"))
